"""FCS 2.0, 3.0 and 3.1 files as tables: one task a file, events out in batches.

The layout follows the public standard: the header gives the places of the text and data
segments; the text segment is keyword, delimiter, value; data are integers of 8, 16 or 32
bits, masked to the parameter's range, or 32- or 64-bit floats, in the stated byte order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudfork.config import Options
from cloudfork.functions.scalar import arcsinh
from cloudfork.session import cut

EVENTS_AT_ONCE = 50_000
PACKED_AT_ONCE = 4_000_000  # bytes of small files in a batch
HEADER_SCHEMA = (
    "path string, fcstype string, total_events long, num_of_par int, datatype string, byteorder string, keywords map<string,string>, "
    "par array<struct<par_no:int,par_name:string,par_name2:string,par_bit:int,par_range:long,par_decade:double,par_logzero:double,par_gain:double>>, "
    "comp_labels array<string>, comp array<array<double>>"
)


_PAR = pa.struct([
    ("par_no", pa.int32()), ("par_name", pa.string()), ("par_name2", pa.string()), ("par_bit", pa.int32()), ("par_range", pa.int64()),
    ("par_decade", pa.float64()), ("par_logzero", pa.float64()), ("par_gain", pa.float64()),
])
_HEADER = pa.schema([
    ("path", pa.string()), ("fcstype", pa.string()), ("total_events", pa.int64()), ("num_of_par", pa.int32()), ("datatype", pa.string()), ("byteorder", pa.string()),
    ("keywords", pa.map_(pa.string(), pa.string())), ("par", pa.list_(_PAR)), ("comp_labels", pa.list_(pa.string())), ("comp", pa.list_(pa.list_(pa.float64()))),
])


def keywords(text: bytes) -> dict[str, str]:
    """Keyword -> value of a text segment; its first byte is the delimiter, doubled inside values. Keys in upper case."""
    body = text.decode("utf-8", errors="replace")
    mark, body = body[:1], body[1:]
    hidden = "\x00\x00"
    parts = body.replace(mark * 2, hidden).split(mark)
    parts = [p.replace(hidden, mark) for p in parts]
    return {k.strip().upper(): v.strip() for k, v in zip(parts[::2], parts[1::2])}


def _number(text: str | None, default: float = 0.0) -> float:
    try:
        return float(text)
    except (TypeError, ValueError):
        return default


def parse(content: bytes) -> dict:
    """The header of a file as a dict, with ``begin`` and ``end`` of its data; ValueError for anything that is no FCS file."""
    version = content[:6].decode("ascii", errors="replace")
    if version not in ("FCS2.0", "FCS3.0", "FCS3.1"):
        raise ValueError(f"not an FCS 2.0, 3.0 or 3.1 file: {version!r}")
    places = tuple(int(content[i : i + 8].strip() or b"0") for i in (10, 18, 26, 34))
    return _parsed(version, places, content[places[0] : places[0] + 1], content[places[0] : places[1] + 1])


@lru_cache(512)
def _parsed(version: str, places: tuple[int, ...], mark: bytes, text: bytes) -> dict:
    """``parse`` of a text segment; many small files have the same, and then share one dict."""
    words = keywords(text)
    begin, end = places[2] or int(_number(words.get("$BEGINDATA"))), places[3] or int(_number(words.get("$ENDDATA")))
    par = []
    for i in range(1, int(_number(words.get("$PAR"))) + 1):
        decade, zero = (_number(x) for x in ((words.get(f"$P{i}E") or "0,0").split(",") + ["0"])[:2])
        par.append({
            "par_no": i, "par_name": words.get(f"$P{i}N"), "par_name2": words.get(f"$P{i}S"), "par_bit": int(_number(words.get(f"$P{i}B"))),
            "par_range": int(_number(words.get(f"$P{i}R"))), "par_decade": decade, "par_logzero": zero or (1.0 if decade else 0.0), "par_gain": _number(words.get(f"$P{i}G"), 1.0) or 1.0,
        })
    labels, matrix = spillover(words.get("$SPILLOVER") or words.get("SPILL") or words.get("SPILLOVER"))
    return {
        "fcstype": version, "total_events": int(_number(words.get("$TOT"))), "num_of_par": len(par), "datatype": words.get("$DATATYPE", "").upper(), "byteorder": words.get("$BYTEORD", "4,3,2,1"),
        "delimiter": chr(mark[0]) if mark else "", "keywords": words, "par": par, "comp_labels": labels, "comp": matrix, "begin": begin, "end": end,
    }


def spillover(text: str | None) -> tuple[list[str] | None, list[list[float]] | None]:
    """(labels, matrix) of a spillover keyword: n, n labels, n x n numbers; nothing if it is absent or incomplete."""
    parts = [p.strip() for p in (text or "").split(",")]
    n = int(_number(parts[0]))
    if n < 1 or len(parts) < 1 + n + n * n:
        return None, None
    values = [_number(p) for p in parts[1 + n : 1 + n + n * n]]
    return parts[1 : 1 + n], [values[i * n : (i + 1) * n] for i in range(n)]


#: How some instruments' integers differ from the standard's. Storage type, bits that count, divisor of a
#: remainder, and the range above which a channel is rescaled to 0 .. 1024 (None: as the standard has it).
CONVENTIONS = {
    "standard": {},
    "ten_bit": {"kind": "u2", "order": "<", "bits": 10},
    "wide_to_1024": {"rescale_above": 4096},
    "all_to_1024": {"kind": "u2", "rescale_above": 0},
    "signed_32": {"kind": "i4"},
    "remainder_1024": {"kind": "i4", "remainder": 1024},
    "unsigned_16": {"kind": "u2"},
}


def convention_of(head: dict) -> str:
    """The convention that version, delimiter and cytometer of a file with integer data point to."""
    cytometer, mark = head.get("keywords", {}).get("$CYT", "").lower(), head.get("delimiter", "")
    if head["datatype"] != "I":
        return "standard"
    if head.get("fcstype") == "FCS2.0":
        return "ten_bit" if mark == "!" else "wide_to_1024" if head["par"] and head["par"][0]["par_bit"] == 16 else "standard"
    if mark == "|":
        return "all_to_1024"
    known = {"accuri": "signed_32", "partec": "unsigned_16", "lx": "remainder_1024"} if mark == "/" else {}
    return next((c for name, c in known.items() if name in cytometer), "standard")


def _event_type(head: dict, rule: dict) -> np.dtype:
    """How an event is stored."""
    order = rule.get("order") or ("<" if head["byteorder"].startswith("1,2") else ">")
    bits = [p["par_bit"] for p in head["par"]]
    by_type = {"F": lambda b: "f4", "D": lambda b: "f8", "I": lambda b: rule.get("kind") or {8: "u1", 16: "u2", 32: "u4"}.get(b)}.get(head["datatype"])
    if by_type is None or any(by_type(b) is None for b in bits):
        raise ValueError(f"data type {head['datatype']!r} with {bits} bits is not supported")
    return np.dtype([(str(i), order + by_type(b)) for i, b in enumerate(bits)])


def decode(content: bytes, head: dict, convention: str | None = None) -> np.ndarray:
    """Events x parameters; integers by ``convention``, or by the one that the header points to."""
    rule = CONVENTIONS[convention or convention_of(head)]
    row, n = _event_type(head, rule), head["num_of_par"]
    body = content[head["begin"] : head["end"] + 1]
    events = np.frombuffer(body, row, count=min(head["total_events"] or 1 << 62, len(body) // row.itemsize if n else 0))
    out = np.empty((len(events), n))
    for i, p in enumerate(head["par"]):
        x, limit = events[str(i)], p["par_range"]
        if "bits" in rule:
            x = x & (2 ** rule["bits"] - 1)
        elif "remainder" in rule:
            x = x % rule["remainder"]
        elif "rescale_above" in rule and limit > rule["rescale_above"]:
            x = x * (1024 / limit)
        elif head["datatype"] == "I" and not rule.get("kind") and 1 < limit < 2 ** p["par_bit"]:
            x = x & (2 ** math.ceil(math.log2(limit)) - 1)
        out[:, i] = x
    return out


def _decoded(paths: list[str], contents: Iterator[bytes], convention: str | None = None) -> Iterator[tuple[dict, list[str], int, np.ndarray]]:
    """(head, paths, n, events) of files: those with one header are decoded together, n events of each file after those of the one before."""
    alike: dict[tuple[int, int], tuple[dict, list[str], list[bytes]]] = {}

    def together(head: dict, names: list[str], bodies: list[bytes]) -> tuple[dict, list[str], int, np.ndarray]:
        wide = _event_type(head, CONVENTIONS[convention or convention_of(head)]).itemsize
        n = min(head["total_events"] or 1 << 62, len(bodies[0]) // wide if wide else 0)
        body = b"".join(b[: n * wide] for b in bodies)
        whole = head | {"begin": 0, "end": len(body) - 1, "total_events": n * len(bodies)}
        return head, names, n, decode(body, whole, convention)

    for p, content in zip(paths, contents):
        head = parse(content)
        body = content[head["begin"] : head["end"] + 1]
        at = (id(head), len(body))
        same = alike.setdefault(at, (head, [], []))
        same[1].append(p)
        same[2].append(body)
        if len(same[2]) * max(1, len(body)) >= EVENTS_AT_ONCE * 8 * max(1, head["num_of_par"]):
            yield together(*alike.pop(at))
    for same in alike.values():
        yield together(*same)


def _event_rows(paths: list[str], n: int, values: pa.Array, width: int) -> Iterator[pa.RecordBatch]:
    """(path, event_no, values) of n events of each of some files, EVENTS_AT_ONCE rows at a time; values are flat."""
    names = pa.array(paths, pa.string())
    for lo in range(0, n * len(paths), EVENTS_AT_ONCE):
        at = np.arange(lo, min(lo + EVENTS_AT_ONCE, n * len(paths)))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), values.slice(lo * width, len(at) * width))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(at // n)), pa.array(at % n + 1), rows], names=["path", "event_no", "values"])


def _contents(b: pa.RecordBatch) -> tuple[list[str], Iterator[bytes]]:
    return b.column(0).to_pylist(), (c.as_py() for c in b.column(1))


def file_head(count: int, par: list[dict], words: dict[str, str] | None = None) -> bytes:
    """What comes before ``count`` events in ``file_bytes``."""
    length = 8 * count * len(par)
    text = {"$MODE": "L", "$DATATYPE": "D", "$BYTEORD": "1,2,3,4", "$TOT": count, "$PAR": len(par), "$NEXTDATA": 0}
    for i, p in enumerate(par, start=1):
        text |= {f"$P{i}N": p["par_name"], f"$P{i}B": 64, f"$P{i}R": p.get("par_range", 262144), f"$P{i}E": f"{p.get('par_decade', 0)},{p.get('par_logzero', 0)}", f"$P{i}G": p.get("par_gain", 1)}
        text |= {f"$P{i}S": p["par_name2"]} if p.get("par_name2") else {}
    body = "|" + "".join(f"{str(k).replace('|', '||')}|{str(v).replace('|', '||')}|" for k, v in (text | (words or {})).items() if str(v) != "")
    fill = lambda begin: (body + f"$BEGINDATA|{begin:020d}|$ENDDATA|{max(begin, begin + length - 1):020d}|").encode()
    begin = 58 + len(fill(0))
    places = [58, begin - 1, *((begin, begin + length - 1) if begin + length < 10**8 else (0, 0)), 0, 0]
    return b"FCS3.1    " + b"".join(b"%8d" % p for p in places) + fill(begin)


def file_bytes(events: np.ndarray, par: list[dict], words: dict[str, str] | None = None) -> bytes:
    """A 3.1 file of 64-bit floats: events x parameters, each parameter a dict with par_name, par_name2 and what else ``parse`` gives."""
    if events.ndim != 2 or events.shape[1] != len(par):
        raise ValueError(f"{events.shape} events for {len(par)} parameters")
    return file_head(len(events), par, words) + np.ascontiguousarray(events, "<f8").tobytes()


def pack_files(cells: DataFrame, path: Column, par: list[dict], words: dict[str, str] | None = None, order: str = "cell_id", values: str = "values") -> DataFrame:
    """(path, content): the rows of each path as an FCS file, in the order given. A file is made by one task, so a path names as many rows as a file may have."""

    width, heads = 8 * len(par), {}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes]]:
        """Each file's path and events; rows come file by file, a file's first one with the number 1."""
        path, held = None, []
        for b in batches:
            events = b.column("events")
            if b.num_rows and (events.null_count or (events.value_lengths().to_numpy() != len(par)).any()):
                raise ValueError(f"events that have not {len(par)} values")
            data = np.ascontiguousarray(events.flatten().to_numpy(zero_copy_only=False), "<f8").tobytes()
            starts = np.flatnonzero(b.column("no").to_numpy() == 1)
            ends = [*(starts * width).tolist(), len(data)]
            held.append(data[: ends[0]])
            for name, lo, hi in zip(b.column("path").take(pa.array(starts)).to_pylist(), ends, ends[1:]):
                if lo or any(held):
                    yield path, b"".join(held)
                path, held = name, [data[lo:hi]]
        if any(held):
            yield path, b"".join(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for name, data in whole(batches):
            n = len(data) // width
            if n not in heads:
                heads[n] = file_head(n, par, words)
            rows.append((name, heads[n] + data))
            size += len(rows[-1][1])
            if size >= PACKED_AT_ONCE:
                yield packed(rows)
                rows, size = [], 0
        if rows:
            yield packed(rows)

    def packed(rows: list[tuple[str | None, bytes]]) -> pa.RecordBatch:
        names, contents = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    # the window brings a path's rows together, in their order
    no = F.row_number().over(Window.partitionBy("path").orderBy(F.asc_nulls_last(order)))
    rows = cells.select(path.alias("path"), order, F.col(values).cast("array<double>").alias("events"))
    return rows.select("path", "events", no.alias("no")).mapInArrow(run, "path string, content binary")


def cells_from_files(spark: SparkSession, path: str | list[str] | DataFrame, used: list[str], extra: list[str] | None = None, options: Options | None = None, compensate: bool = False) -> DataFrame:
    """(cell_id, label, features, extra) of all events of all files: scaled, if asked compensated, the markers picked
    by name (long name, else short) in every file, transformed by their cofactors.

    label is the path; cell_id counts through the files in the order of their paths. A marker that a file lacks,
    or has twice, is an error that names the files.
    """
    wanted = [*used, *(extra or [])]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, contents = _contents(b)
            heads = [parse(c) for c in contents]
            whole = {id(h): all(_names(h).count(m) == 1 for m in wanted) for h in {id(h): h for h in heads}.values()}
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array([h["total_events"] for h in heads], pa.int64()), pa.array([whole[id(h)] for h in heads], pa.bool_())], names=["path", "total_events", "whole"]
            )

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for head, paths, n, events in _decoded(*_contents(b)):
                x, missing = _scaled(events, head)
                if compensate:
                    x, missing = _compensated(x, head), np.zeros_like(missing)
                at = [_names(head).index(m) for m in wanted]
                flat = x[:, at].ravel()
                yield from _event_rows(paths, n, pa.array(flat, mask=np.tile(missing[at], len(x)) if missing[at].any() else None), len(at))

    # the whole headers stay in the tasks: of many small files they are far more than the events
    files = cut(_files(spark, path).mapInArrow(counts, "path string, total_events long, whole boolean"))
    bad = files.filter("not whole").select("path").limit(5).collect()
    if bad:
        raise ValueError(f"markers of {wanted} are missing or doubled in {[r[0] for r in bad]}")
    before = F.coalesce(F.sum("total_events").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over files
    starts = files.select("path", before.alias("start"))
    events = _files(spark, path).mapInArrow(picked, "path string, event_no long, values array<double>").join(starts.hint("merge"), "path")  # any number of files: no broadcast

    def array(markers: list[str], start: int) -> Column:
        factor = {m: (options.cofactors.get(m, options.default_cofactor) if options else 0) for m in markers}
        return F.array(*[arcsinh(F.col("values")[i], factor[m]) for i, m in enumerate(markers, start)]).cast("array<double>")

    return events.select((F.col("start") + F.col("event_no")).alias("cell_id"), F.col("path").alias("label"), array(used, 0).alias("features"), array(extra or [], len(used)).alias("extra"))


def _names(head: dict) -> list[str | None]:
    """A file's markers: the long name, or the short one where that is blank."""
    return [(p["par_name2"] or "").strip() or p["par_name"] for p in head["par"]]


def _scaled(events: np.ndarray, head: dict) -> tuple[np.ndarray, np.ndarray]:
    """``scaled`` of the events of files with this header, and which parameters have no value, as a logarithmic one without a range."""
    x, missing = events, np.zeros(len(head["par"]), bool)
    for i, p in enumerate(head["par"]):
        if p["par_gain"] != 1:
            x[:, i] /= p["par_gain"]
        elif p["par_decade"] != 0:
            missing[i] = p["par_range"] == 0
            x[:, i] = np.nan if missing[i] else p["par_logzero"] * 10.0 ** (x[:, i] / p["par_range"] * p["par_decade"])
    return x, missing


def _compensated(values: np.ndarray, head: dict) -> np.ndarray:
    """The events with their spillover columns multiplied by the inverse of the matrix, if there is one for parameters of the file."""
    names, labels = [p["par_name"] for p in head["par"]], head["comp_labels"]
    if labels and all(x in names for x in labels):
        at = [names.index(x) for x in labels]
        values[:, at] = np.linalg.solve(np.array(head["comp"], float).T, values[:, at].T).T
    return values


def read_headers(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    """One row a file: version, counts, parameters, all keywords, spillover. ``path`` may be a table (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": p, **parse(c)} for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            for r in rows:
                r["keywords"] = list(r["keywords"].items())
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in _HEADER.names} for r in rows], schema=_HEADER)

    return _files(spark, path).mapInArrow(run, HEADER_SCHEMA)


def _files(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    if isinstance(path, DataFrame):
        return path.select("path", "content")
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_events(spark: SparkSession, path: str | list[str] | DataFrame, convention: str | None = None) -> DataFrame:
    """(path, event_no, values): every event of every file; event_no counts from 1 within the file.

    ``convention``: one of CONVENTIONS, by default the one that a file's header points to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, paths, n, events in _decoded(*_contents(b), convention):
                yield from _event_rows(paths, n, pa.array(events.ravel()), events.shape[1])

    return _files(spark, path).mapInArrow(run, "path string, event_no long, values array<double>")


def scaled(value: Column, par: Column) -> Column:
    """A channel value by its parameter: divided by a gain other than 1, else on the logarithmic scale if it has decades, else as it is."""
    log = par["par_logzero"] * F.pow(F.lit(10.0), value / F.nullif(par["par_range"].cast("double"), F.lit(0.0)) * par["par_decade"])
    return F.when(par["par_gain"] != 1, value / par["par_gain"]).when(par["par_decade"] != 0, log).otherwise(value)


def scaled_events(events: DataFrame, headers: DataFrame) -> DataFrame:
    """Events with every value scaled by its parameter; one header row a file."""
    joined = events.join(headers.select("path", "par"), "path")
    return joined.select("path", "event_no", F.zip_with("values", "par", scaled).alias("values"))


def compensated(events: DataFrame, headers: DataFrame) -> DataFrame:
    """Events whose spillover columns are multiplied by the inverse of their file's spillover matrix;
    files without one, or whose labels are no parameters, stay as they are."""
    heads = headers.select("path", F.transform("par", lambda p: p["par_name"]).alias("names"), "comp_labels", "comp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, of = np.unique(np.array(b.column("path").to_pylist(), object), return_inverse=True)
            out = [None] * b.num_rows
            for f in range(len(files)):
                rows = np.flatnonzero(of == f)
                values = np.array(b.column("values").take(pa.array(rows)).to_pylist(), float)
                names, labels, comp = (b.column(c)[int(rows[0])].as_py() for c in ("names", "comp_labels", "comp"))
                values = _compensated(values, {"par": [{"par_name": x} for x in names], "comp_labels": labels, "comp": comp})
                for r, v in zip(rows, values):
                    out[r] = v
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("event_no"), pa.array(out, pa.list_(pa.float64()))], names=["path", "event_no", "values"])

    return events.join(heads, "path").mapInArrow(run, "path string, event_no long, values array<double>")
