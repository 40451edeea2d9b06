import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudfork.sources import drift, fcs, tables


def fcs_bytes(version, kind, bits, events, sep="/", order="1,2,3,4", extra=None, in_text=False):
    n = events.shape[1]
    end = "<" if order.startswith("1") else ">"
    code = {"F": "f4", "D": "f8", "I": f"u{bits // 8}"}[kind]
    data = events.astype(end + code).tobytes()
    words = {"$TOT": len(events), "$PAR": n, "$DATATYPE": kind, "$BYTEORD": order, "$MODE": "L"}
    for i in range(1, n + 1):
        words |= {f"$P{i}N": f"CH{i}", f"$P{i}S": f"marker {i}", f"$P{i}B": bits, f"$P{i}R": 1024, f"$P{i}E": "0,0"}
    words |= extra or {}
    make = lambda w: (sep + sep.join(f"{k}{sep}{v}" for k, v in w.items()) + sep).encode()
    text = make(words | ({"$BEGINDATA": "00000000", "$ENDDATA": "00000000"} if in_text else {}))
    begin = 64 + len(text)
    if in_text:
        text = make(words | {"$BEGINDATA": f"{begin:08d}", "$ENDDATA": f"{begin + len(data) - 1:08d}"})
    places = (64, begin - 1, *((0, 0) if in_text else (begin, begin + len(data) - 1)), 0, 0)
    return version.encode() + b"    " + b"".join(f"{p:>8d}".encode() for p in places).ljust(54) + text


@pytest.mark.parametrize(
    "version,kind,bits,sep,order,in_text",
    [("FCS2.0", "I", 16, "/", "4,3,2,1", False), ("FCS3.0", "F", 32, "|", "1,2,3,4", True), ("FCS3.1", "D", 64, "\\", "4,3,2,1", False), ("FCS3.0", "I", 32, "\t", "1,2,3,4", False), ("FCS3.1", "F", 32, "\n", "1,2,3,4", False)],
)
def test_files_come_back(spark, tmp_path, version, kind, bits, sep, order, in_text):
    events = np.arange(12, dtype=float).reshape(4, 3)
    head = fcs_bytes(version, kind, bits, events, sep, order, in_text=in_text)
    end = "<" if order.startswith("1") else ">"
    code = {"F": "f4", "D": "f8", "I": f"u{bits // 8}"}[kind]
    (tmp_path / "a.fcs").write_bytes(head + events.astype(end + code).tobytes())
    got = fcs.read_events(spark, str(tmp_path)).orderBy("event_no").collect()
    assert [r["values"] for r in got] == events.tolist()
    h = fcs.read_headers(spark, str(tmp_path)).first()
    assert (h["fcstype"], h["total_events"], h["num_of_par"], h["par"][1]["par_name2"]) == (version, 4, 3, "marker 2")


def test_scaling_and_compensation(spark, tmp_path):
    events = np.array([[100.0, 50.0], [10.0, 1000.0]])
    extra = {"$P1G": "2", "$P2E": "4,1", "SPILL": "2,CH1,CH2,1,0.5,0,1"}
    head = fcs_bytes("FCS3.0", "F", 32, events, extra=extra)
    (tmp_path / "a.fcs").write_bytes(head + events.astype("<f4").tobytes())
    e, h = fcs.read_events(spark, str(tmp_path)), fcs.read_headers(spark, str(tmp_path))
    rows = [r["values"] for r in fcs.scaled_events(e, h).orderBy("event_no").collect()]
    assert rows[0][0] == 50 and rows[1][1] == pytest.approx(10 ** (1000 / 1024 * 4))
    comp = [r["values"] for r in fcs.compensated(e, h).orderBy("event_no").collect()]
    assert np.allclose(comp, events @ np.linalg.inv([[1, 0.5], [0, 1]]))
    with pytest.raises(ValueError):
        fcs.parse(b"PNG" + b" " * 80)


def test_range_mask():
    assert fcs.decode(struct.pack("<2H", 0xFC01, 1023), {"byteorder": "1,2,3,4", "par": [{"par_bit": 16, "par_range": 1024}], "num_of_par": 1, "begin": 0, "end": 3, "datatype": "I", "total_events": 2}).tolist() == [[1], [1023]]


@pytest.mark.parametrize(
    "convention,raw,expected",
    [("ten_bit", 0xFC01, 1), ("wide_to_1024", 32768, 512), ("all_to_1024", 32768, 512), ("unsigned_16", 65535, 65535), ("standard", 32768, 32768)],
)
def test_conventions_of_instruments(convention, raw, expected):
    head = {"byteorder": "1,2,3,4", "par": [{"par_bit": 16, "par_range": 65536}], "num_of_par": 1, "begin": 0, "end": 1, "datatype": "I", "total_events": 1}
    assert fcs.decode(struct.pack("<H", raw), head, convention).tolist() == [[expected]]
    long = head | {"par": [{"par_bit": 32, "par_range": 0}], "end": 3}
    assert fcs.decode(struct.pack("<i", 2050), long, "remainder_1024").tolist() == [[2]]
    assert fcs.decode(struct.pack("<i", -7), long, "signed_32").tolist() == [[-7]]


def test_convention_follows_the_header():
    head = {"datatype": "I", "fcstype": "FCS3.0", "delimiter": "/", "keywords": {"$CYT": "Accuri C6"}, "par": [{"par_bit": 32}]}
    assert fcs.convention_of(head) == "signed_32"
    assert fcs.convention_of(head | {"keywords": {"$CYT": "LX200"}}) == "remainder_1024"
    assert fcs.convention_of(head | {"delimiter": "|"}) == "all_to_1024"
    assert fcs.convention_of(head | {"delimiter": "!", "fcstype": "FCS2.0"}) == "ten_bit"
    assert fcs.convention_of(head | {"datatype": "F"}) == fcs.convention_of(head | {"keywords": {}}) == "standard"


def test_many_small_files_without_broadcast(spark):
    """Files over several Arrow batches, of other headers and lengths, come back whole; their headers stay in the tasks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(600).selectExpr("concat('f', cast(sqrt(id) as int)) as file", "id as cell_id", "array(double(id), id * 2.0, id / 4.0) as values")
        par = [{"par_name": "CH1", "par_name2": "a", "par_gain": 2}, {"par_name": "b"}, {"par_name": "CH3", "par_name2": "c", "par_decade": 4, "par_logzero": 1, "par_range": 0}]
        files = fcs.pack_files(rows, F.col("file"), par, {"$SPILLOVER": "2,CH1,b,1,0.5,0,1"}).cache()
        assert files.count() == 25
        cells = fcs.cells_from_files(spark, files, ["b", "a"], ["c"])
        got = sorted((r["label"], r["cell_id"], *r["features"], r["extra"][0]) for r in cells.collect())
        order = sorted(range(600), key=lambda i: (f"f{int(i ** 0.5)}", i))
        assert got == [(f"f{int(i ** 0.5)}", n, i * 2.0, i / 2.0, None) for n, i in enumerate(order, start=1)]
        assert "Broadcast" not in cells._jdf.queryExecution().executedPlan().toString()
        solved = fcs.cells_from_files(spark, files, ["b"], compensate=True).orderBy("cell_id").collect()
        assert [r["features"][0] for r in solved] == [i * 2.0 - i / 4 for i in order]
        with pytest.raises(ValueError, match="missing or doubled"):
            fcs.cells_from_files(spark, files, ["a", "CH1"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cells_by_name(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", 5.0, 2.0)], "id int, lab string, b double, a double")
    row = tables.cells_from_wide(df, "id", "lab", ["a", "b"]).first()
    assert row["features"] == [2.0, 5.0]
    with pytest.raises(ValueError):
        tables.resolve(["a"], ["c"])
    with pytest.raises(ValueError):
        tables.union_files({"x": df, "y": df.drop("a")})
    assert tables.union_files({"x": df, "y": df.select(*reversed(df.columns))}).count() == 2
    tables.write_text(df, str(tmp_path / "t"))
    assert "5.0000\t2.0000" in "".join(p.read_text() for p in (tmp_path / "t").glob("part*"))


CATALOG = [(1, "KD3"), (2, "IgV-s"), (3, "KD79b"), (4, "KD235-6")]


@pytest.mark.parametrize("name", ["IgV-s", "igv-s ", " 175Lu IgV-s", "175Lu_IgV-s", "Lu175Di-IgV-s", "IgV-s(Lu175)Di", "IgV-s_Lu175", "IgVs", "IGV-S"])
def test_spellings(spark, name):
    row = spark.createDataFrame([(name,)], "n string").select(drift.spelling_key(F.col("n"))).first()
    assert row[0] == "igvs"


def test_changes(spark):
    par = spark.createDataFrame(
        [(1, 1, "A", "KD3", "F", 32), (1, 2, "B", "IgV-s", "F", 32), (1, 3, "T", None, "F", 32), (1, 3, "T", None, "F", 32),
         (2, 1, "A", "kd3", "F", 32), (2, 2, "B", " ", "I", 16), (2, 3, "KD79b", "", "F", 32), (3, 1, "B", "IgV-s", None, None)],
        "file_id long, par_no int, par_name string, par_name2 string, par_datatype string, par_bit int",
    )
    header = spark.createDataFrame([(1, 7, 3, 1, 1), (2, 7, 9, 2, 1), (2, 7, 9, 2, 5), (3, 8, 1, 1, 1), (4, 8, None, 2, 1)], "file_id long, run_id long, num_of_par int, acquired_at int, loaded_at int")
    runs = spark.createDataFrame([(7, ["KD3", "KD79b_Nd146", "unknown"]), (8, None)], "run_id long, used_markers array<string>")
    catalog = spark.createDataFrame(CATALOG, "marker_no int, marker string")
    got = {tuple(r) for r in drift.schema_changes(par, header, runs, catalog).collect()}
    assert got == {(2, "KD3", "renamed"), (2, "IgV-s", "removed"), (2, "KD79b", "added"), (2, "*", "count"), (1, "KD79b", "missing"), (4, "IgV-s", "removed"), (4, "*", "count")}
    assert drift.schema_changes(par.limit(0), header.limit(0), runs, catalog).count() == 0


def test_changes_of_a_path_with_gaps(spark):
    """A marker in files 1, 2 and 4 of a run of five, with another type in file 2."""
    order = [(i, 7, i, i + 1 if i < 5 else None) for i in range(1, 6)]
    files = spark.createDataFrame(order, "file_id long, run_id long, seq int, next_id long")
    alternatives = spark.createDataFrame([(1, ("a", "F", 32)), (2, ("a", "I", 32)), (4, ("a", "I", 32))], "file_id long, alternative struct<name string, datatype string, bit int>")
    fused = alternatives.withColumn("marker", F.lit("m")).join(files, "file_id")
    assert {tuple(r) for r in drift.alternative_changes(fused).collect()} == {(2, "m", "retyped"), (3, "m", "removed"), (4, "m", "added"), (5, "m", "removed")}


def test_tables_of_files_are_never_broadcast(spark, tmp_path):
    """Their Parquet files are small for the rows that they hold; only the catalog may be broadcast."""
    par = spark.range(4000).selectExpr("id div 4 as file_id", "cast(id % 4 as int) + 1 as par_no", "'A' as par_name", "'KD3' as par_name2", "'F' as par_datatype", "32 as par_bit")
    header = spark.range(1000).selectExpr("id as file_id", "id % 10 as run_id", "5 as num_of_par", "cast(id as int) as acquired_at", "1 as loaded_at")
    runs = spark.range(10).selectExpr("id as run_id", "array('KD3', 'IgV-s', 'unknown') as used_markers")
    raw = spark.range(1000).selectExpr("id as raw_id", "id as file_id", "1 as row_no", "array('KD3') as all_markers", "array(if(id % 20 < 10, '1', '1,5')) as all_data")
    saved = {}
    for name, df in (("par", par), ("header", header), ("runs", runs), ("raw", raw)):
        df.write.parquet(str(tmp_path / name))
        saved[name] = spark.read.parquet(str(tmp_path / name))
    catalog = spark.createDataFrame(CATALOG, "marker_no int, marker string")
    changes = drift.schema_changes(saved["par"], saved["header"], saved["runs"], catalog)
    later = drift.appearing_alternatives(saved["raw"], saved["header"])
    for df in (changes, later):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        by = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
        assert all("[key#" in line for line in by), by
    assert sorted({(r["marker"], r["change_kind"]) for r in changes.collect()}) == [("*", "count"), ("IgV-s", "missing")] and changes.count() == 2000
    assert later.count() == 10


def test_tagged_values(spark):
    raw = spark.createDataFrame(
        [(1, 1, 1, ["KD3", "x", "IgV-s", "n", "e", "s", "w"], ["1,5", "NaN", "abc", None, " ", "1e2", " 7.5"], "L"), (2, 1, 2, ["KD3"], None, None), (3, 1, 3, ["a", "b"], ["1"], "l")],
        "raw_id long, file_id long, row_no int, all_markers array<string>, all_data array<string>, all_labels string",
    )
    rows = [(r["kind"], r["number"], r["text"]) for r in drift.tagged_values(raw).filter("raw_id = 1").orderBy("position").collect()]
    assert [r[0] for r in rows] == ["decimal_comma", "nan", "text", "null", "empty", "scientific", "decimal"]
    assert rows[0][1] == 1.5 and np.isnan(rows[1][1]) and rows[2][2] == "abc" and rows[5][1] == 100 and rows[6][1] == 7.5
    assert drift.tagged_values(raw).filter("raw_id = 3").count() == 2
    twice = raw.union(spark.createDataFrame([(4, 1, 4, ["KD3", "IgV-s", "kd3", "k(Lu175)Di"], ["7", "99999999999999999999", "8.5", "1"], "L")], raw.schema))
    catalog = spark.createDataFrame([(1, "KD3"), (2, "Lu175Di-IgV-s")], "marker_no int, marker string")  # a catalog name may have its channel too
    table = drift.consistent_table(twice, catalog).orderBy("raw_id").collect()
    assert table[0]["KD3"][0]["number"] == 1.5 and table[0]["Lu175Di-IgV-s"][0]["text"] == "abc" and len(table[0]["others"]) == 5
    assert table[1]["KD3"] is None and table[2]["KD3"] is None
    assert [(v["integer"], v["real"], v["number"]) for v in table[3]["KD3"]] == [(7, None, 7.0), (None, 8.5, 8.5)]
    assert (table[3]["Lu175Di-IgV-s"][0]["integer"], table[3]["Lu175Di-IgV-s"][0]["real"]) == (None, 1e20)
    assert twice.count() == len(table) and drift.consistent_table(raw.limit(0), catalog).count() == 0
