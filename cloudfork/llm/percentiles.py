"""Percentiles of very large numeric columns.

Method: randomized compactor hierarchies. Level h holds values that stand for 2^h values
each. A full level is sorted and every second value, from a random first one, moves a
level up. Two sketches merge level by level. With ``k`` values in the top compactor and
capacities that shrink by 2/3 a level downwards, the rank error of a percentile is at most
about 3.3 / k of the count with a probability of 99 % (k = 512: 0.65 %).

A sketch row is (group columns, position, n, least, greatest, levels): rows of separate
partitions, days or runs combine by ``merge_sketches``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 512
SHRINK = 2 / 3
FAN_IN = 512
_SKETCH = "position int, n long, least double, greatest double, levels array<array<double>>"


def capacity(level: int, levels: int, k: int = K) -> int:
    return max(8, int(np.ceil(k * SHRINK ** (levels - 1 - level))))


def compress(levels: list[np.ndarray], rng: np.random.Generator, k: int = K) -> list[np.ndarray]:
    """Compact, from the lowest level up, until the values fit the capacities."""
    levels = list(levels)
    while sum(map(len, levels)) > sum(capacity(h, len(levels), k) for h in range(len(levels))):
        for h in range(len(levels)):
            if len(levels[h]) > capacity(h, len(levels), k):
                break
        values = np.sort(levels[h])
        odd = len(values) % 2  # one value stays, so that the weights keep their sum
        kept, values = values[:odd], values[odd:]
        up = values[int(rng.integers(2)) :: 2]
        if h + 1 == len(levels):
            levels.append(up)
        else:
            levels[h + 1] = np.concatenate([levels[h + 1], up])
        levels[h] = kept
    return levels


def merge(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Level by level, not compressed yet."""
    if len(a) < len(b):
        a, b = b, a
    return [np.concatenate([x, b[h]]) if h < len(b) else x for h, x in enumerate(a)]


def quantile(levels: list[np.ndarray], q: float) -> float:
    """The smallest value whose weighted rank reaches q of the weight; NaN if there is none."""
    values = np.concatenate(levels) if levels else np.empty(0)
    if not len(values):
        return float("nan")
    weights = np.repeat(2.0 ** np.arange(len(levels)), [len(x) for x in levels])
    order = np.argsort(values, kind="stable")
    rank = np.cumsum(weights[order])
    return float(values[order][min(np.searchsorted(rank, q * rank[-1]), len(values) - 1)])


def _seeded(*parts) -> np.random.Generator:
    """Coins that depend on the values sketched only, so that a task that runs again throws the same."""
    return np.random.default_rng([zlib.crc32(p if isinstance(p, bytes) else repr(p).encode()) for p in parts])


def _column(sketches: list[list[np.ndarray]]) -> pa.Array:
    flat = [x for s in sketches for x in s]
    inner = pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum([len(x) for x in flat])].astype(np.int32)), pa.array(np.concatenate(flat) if flat else np.empty(0))
    )
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in sketches])].astype(np.int32)), inner)


def _levels(cell: pa.Scalar) -> list[np.ndarray]:
    inner = cell.values
    return [inner[h].values.to_numpy(zero_copy_only=False) for h in range(len(inner))]


def _rows(groups: pa.Table | None, key_rows, positions, counts, sketches, ends, names, types) -> pa.RecordBatch:
    keys = [groups.column(c).combine_chunks().take(pa.array(key_rows, pa.int64())) for c in names]
    return pa.RecordBatch.from_arrays(
        [*keys, pa.array(positions, pa.int32()), pa.array(counts, pa.int64()), pa.array(ends[0], pa.float64()), pa.array(ends[1], pa.float64()), _column(sketches)],
        names=[*names, "position", "n", "least", "greatest", "levels"],
    )


def _sketch(names: list[str], k: int, flush_rows: int):
    """Sketches of each group and position over the rows of a partition, ``flush_rows`` at a time."""

    def fold(t: pa.Table, part: int) -> pa.RecordBatch:
        code = np.zeros(t.num_rows, np.int64)
        for c in names:
            d = t.column(c).combine_chunks().dictionary_encode("encode")
            code = code * (len(d.dictionary) + 1) + d.indices.to_numpy()
            code = np.unique(code, return_inverse=True)[1]
        vec = t.column("vec").combine_chunks()
        flat, offsets = vec.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False), vec.offsets.to_numpy()
        offsets = offsets - offsets[0]
        length = np.diff(offsets)
        row = np.repeat(np.arange(t.num_rows), length)
        position = np.arange(len(flat)) - offsets[row]
        good = ~np.isnan(flat)
        row, position, flat = row[good], position[good], flat[good]
        key = code[row] * (int(length.max(initial=0)) + 1) + position
        order = np.argsort(key, kind="stable")
        key, row, position, flat = key[order], row[order], position[order], flat[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
        rng, sketches, ends = _seeded(part, flat.tobytes()), [], ([], [])  # coins of its own for every partition
        for x in np.split(flat, start[1:]) if len(start) else []:
            ends[0].append(x.min()), ends[1].append(x.max())
            sketches.append(compress([x], rng, k))
        return _rows(t, row[start], position[start] + 1, np.diff(np.r_[start, len(flat)]), sketches, ends, names, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, part = [], 0, 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= flush_rows:
                yield fold(pa.Table.from_batches(held), part)
                held, rows, part = [], 0, part + 1
        if rows:
            yield fold(pa.Table.from_batches(held), part)

    return run


def _merged(names: list[str], k: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        positions, counts = t.column("position").to_numpy(), t.column("n").to_numpy()
        ends = t.column("least").to_numpy(), t.column("greatest").to_numpy()
        levels = t.column("levels").combine_chunks()
        order = np.lexsort((ends[1], ends[0], counts, positions))
        rng = _seeded([repr(x.as_py()) for x in key], *(x[order].tobytes() for x in (counts, *ends)))
        out = [], [], [], ([], [])
        for rows in np.split(order, np.flatnonzero(np.diff(positions[order])) + 1):
            sketch: list[np.ndarray] = []
            for r in rows:
                sketch = merge(sketch, _levels(levels[int(r)]))
                if sum(map(len, sketch)) > 16 * k:
                    sketch = compress(sketch, rng, k)
            out[0].append(positions[rows[0]]), out[1].append(counts[rows].sum()), out[2].append(compress(sketch, rng, k))
            out[3][0].append(ends[0][rows].min()), out[3][1].append(ends[1][rows].max())
        return pa.Table.from_batches([_rows(t, np.zeros(len(out[0]), int), *out, names, None)])

    return run


def _schema(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in names) + _SKETCH


def quantile_sketches(df: DataFrame, vec_col: str, by: list[str], *, k: int = K, flush_rows: int = 262_144) -> DataFrame:
    """(by..., position, n, least, greatest, levels): one sketch for each group and position of ``vec_col``.

    Positions count from 1. Null and NaN values are left out, infinities count; a position
    without values has no row; null group values form their own group. Each partition sketches
    its rows first, so what is shuffled does not grow with a hot group's rows. Infinite or
    repeated values and vectors of different lengths are fine; an empty table gives no rows.
    """
    names = list(by)
    rows = df.filter(F.col(vec_col).isNotNull()).select(*names, F.col(vec_col).cast("array<double>").alias("vec"))
    schema = _schema(rows, names)
    return merge_sketches(rows.mapInArrow(_sketch(names, k, flush_rows), schema), names, k=k)


def merge_sketches(sketches: DataFrame, by: list[str], *, k: int = K, fan_in: int = FAN_IN) -> DataFrame:
    """Sketches combined to the groups ``by``, for instance days to labels.

    Those of ``fan_in`` neighbouring partitions are combined first, so that no task gets all of
    the sketches of a hot group, however many partitions there are.
    """
    names, parts = list(by), [*by, "part"]
    sketches = sketches.select(*names, "position", "n", "least", "greatest", "levels")
    near = sketches.withColumn("part", F.floor(F.spark_partition_id() / fan_in).cast("int"))
    first = near.groupBy(*parts).applyInArrow(_merged(parts, k), _schema(near, parts)).drop("part")
    return first.groupBy(*names).applyInArrow(_merged(names, k), _schema(sketches, names))


def _answer(levels, q: list[float]):
    import pandas as pd

    return pd.Series([[quantile([np.asarray(x, float) for x in v], p) for p in q] for v in levels])


def sketch_quantiles(sketches: DataFrame, q_pct: list[int]) -> DataFrame:
    """(group columns, position, n, q_pct, value): the percentiles that the sketches answer.

    0 and 100 are the exact extremes.
    """
    q = [p / 100 for p in q_pct]
    answer = F.pandas_udf(lambda levels: _answer(levels, q), "array<double>")
    points = F.arrays_zip(F.array(*map(F.lit, q_pct)).alias("q_pct"), answer("levels").alias("value"))
    keep = [c for c in sketches.columns if c not in ("levels", "least", "greatest")]
    return sketches.select(*keep, "least", "greatest", F.inline(points).alias("q_pct", "value")).select(
        *keep, "q_pct", F.when(F.col("q_pct") == 0, F.col("least")).when(F.col("q_pct") == 100, F.col("greatest")).otherwise(F.col("value")).alias("value")
    )
