"""Choosing a varied subset.

Method: distributed farthest-first k-center. Every partition picks its own representatives
greedily, each time the record farthest from those picked, CHUNK rows at a time; the picks are
pooled, brought together by region, and farthest-first runs again on each region of the pool.
In the order of these picks by radius (the distance to the nearest earlier pick), each pick
then learns its distance to the earlier ones of other regions, so that the radii hold over the
whole pool; the ``size`` picks of largest radius are the subset, so that a region gets as many
as its variety asks for, however many records it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudfork.llm.vectors import DIM, complete_cells, copies_rank, fit_router, gathered, lists, matrix
from cloudfork.session import cut, drop_cut

BINS = 2048  # of the histogram of radii in which the cut is found
CHUNK = 32_768  # rows of a partition among which the first selection runs
LEAST = 64  # picks of a chunk, so that small partitions cover their variety too


def farthest_first(x: np.ndarray, picks: int, start: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in the order picked, and each one's distance to the earlier picks.

    It starts at the record farthest from the mean; that one's radius counts as infinite.
    """
    n, picks = len(x), min(picks, len(x))
    if not n:
        return np.empty(0, int), np.empty(0)
    square = np.einsum("ij,ij->i", x, x)
    at = int(np.argmax(square - 2 * x @ x.mean(axis=0))) if start is None else start
    near, order, radius = np.full(n, np.inf), np.empty(picks, int), np.empty(picks)
    for i in range(picks):
        order[i], radius[i] = at, near[at]
        np.minimum(near, square + (square[at] - 2 * (x @ x[at])), out=near)
        near[at] = -1.0
        at = int(np.argmax(near))
    return order, np.sqrt(np.maximum(radius, 0))


def _local(dim: int, share: float):
    """Of each CHUNK rows of a partition, as many picks of their farthest-first selection as are its share by rows, LEAST at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, CHUNK):
            ids, x = t.column("id").to_numpy(), matrix(t.column("vec"), dim)
            rows, rank, _ = copies_rank(ids, x)
            rows = rows[rank == 0]
            ids, x = ids[rows], x[rows]
            order, _ = farthest_first(x, max(LEAST, int(np.ceil(share * t.num_rows))))
            yield pa.RecordBatch.from_arrays([pa.array(ids[order], pa.int64()), lists(x[order])], names=["id", "vec"])

    return run


def _place(router, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home = router.home(matrix(b.column("vec"), dim))
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), b.column("id"), b.column("vec")], names=["region", "id", "vec"])

    return run


def _rerun(dim: int):
    """Farthest-first over the pooled picks of a region, to the end; copies of a vector count once."""

    def run(t: pa.Table) -> pa.Table:
        ids, x = t.column("id").to_numpy(), matrix(t.column("vec"), dim)
        rows, rank, _ = copies_rank(ids, x)
        rows = rows[rank == 0]
        ids, x = ids[rows], x[rows]
        order, radius = farthest_first(x, len(x))
        return pa.table({"region": t.column("region").slice(0, 1).take(pa.array(np.zeros(len(ids), int))), "id": pa.array(ids[order], pa.int64()), "radius": pa.array(radius, pa.float64()), "vec": lists(x[order])})

    return run


def _visit(router, dim: int, most: float):
    """Each pick to its region, and as a visitor to the others that lie within its radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, x = b.column("region").to_numpy(), matrix(b.column("vec"), dim)
            row, to = router.visits(x, np.minimum(b.column("radius").to_numpy(), most))
            away = to != home[row]
            row, to = np.r_[np.arange(len(x)), row[away]], np.r_[home, to[away]]
            own = np.arange(len(row)) < len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), *(b.column(c).take(pa.array(row)) for c in ("id", "radius")), pa.array(own), lists(x[row])], names=["region", "id", "radius", "own", "vec"]
            )

    return run


def _border(dim: int, block: int = 512):
    """(cell_id, apart): each visitor's distance to the nearest pick of the region that comes before it, by radius, then id."""

    def run(t: pa.Table) -> pa.Table:
        own, ids, radius, x = (t.column("own").to_numpy(), t.column("id").to_numpy(), t.column("radius").to_numpy(), matrix(t.column("vec"), dim))
        order = np.lexsort((ids, -radius))
        place = np.empty(len(ids), int)
        place[order] = np.arange(len(ids))
        here, there = order[own[order]], order[~own[order]]
        y, apart = x[here], np.full(len(there), np.inf)
        square = np.einsum("ij,ij->i", y, y)
        for i in range(0, len(there), block):
            some = there[i : i + block]
            before = np.searchsorted(place[here], place[some])
            if n := int(before.max(initial=0)):
                d = np.einsum("ij,ij->i", x[some], x[some])[:, None] + square[None, :n] - 2 * (x[some] @ y[:n].T)
                d[np.arange(n)[None] >= before[:, None]] = np.inf
                apart[i : i + block] = np.sqrt(np.maximum(d.min(axis=1), 0))
        near = apart < radius[there]
        return pa.table({"cell_id": pa.array(ids[there][near], pa.int64()), "apart": pa.array(apart[near], pa.float64())})

    return run


def varied_subset(
    cells: DataFrame,
    size: int | None = None,
    fraction: float = 0.01,
    *,
    oversample: float = 4.0,
    id_col: str = "cell_id",
    vec_col: str = "all_data",
    dim: int = DIM,
    region_rows: int = 4_000,
) -> DataFrame:
    """(cell_id, radius): ``size`` records (or ``fraction`` of the distinct complete ones) that cover the variety.

    Partitions pick ``oversample`` times their share, more if too few distinct vectors come out.
    Regions hold about ``region_rows`` pooled picks, so the work grows with the records; no task or
    driver holds the pool. Ties at the cut go to the smaller id. Equal vectors count once, whatever
    their number; if fewer exist than asked for, all of them come out.

    Rows without id or complete vector take no part; a repeated id counts once; an empty
    table gives no rows; extra columns are ignored.
    """
    points = complete_cells(cells, id_col, vec_col, dim)
    total = points.agg(F.approx_count_distinct("id", 0.01) if size is not None else F.countDistinct("id")).first()[0]
    wanted = size if size is not None else int(np.ceil(fraction * total))
    share = oversample * wanted / max(1, total)
    while True:
        share = min(1.0, share)
        pool = cut(points.mapInArrow(_local(dim, share), "id long, vec array<double>"))
        pooled = pool.count()
        router = fit_router(pool, pooled, max(0, int(np.ceil(np.log2(max(1, pooled / region_rows))))), dim)
        placed = pool.mapInArrow(_place(router, dim), "region int, id long, vec array<double>")
        ranked = cut(placed.groupBy("region").applyInArrow(_rerun(dim), "region int, id long, radius double, vec array<double>"))
        drop_cut(pool)
        if share == 1 or ranked.count() >= wanted:
            break
        drop_cut(ranked)
        share *= 4
    if router.depth == 0:
        return _largest(ranked.select(F.col("id").alias("cell_id"), "radius"), wanted)
    finite = F.max(F.when(F.col("radius") < float("inf"), F.col("radius")))
    most = ranked.agg(finite).first()[0] or 0.0
    met = ranked.mapInArrow(_visit(router, dim, most), "region int, id long, radius double, own boolean, vec array<double>")
    apart = met.groupBy("region").applyInArrow(_border(dim), "cell_id long, apart double").groupBy("cell_id").agg(F.min("apart").alias("apart"))
    whole = cut(ranked.join(apart, F.col("id") == F.col("cell_id"), "left").select(F.col("id").alias("cell_id"), F.least("radius", "apart").alias("radius")))
    drop_cut(ranked)
    return _largest(whole, wanted)


def _largest(ranked: DataFrame, wanted: int) -> DataFrame:
    """The ``wanted`` rows of largest radius, ties by smaller id, by a histogram and one ranked bin."""
    top = ranked.filter("radius < double('infinity')").agg(F.max("radius")).first()[0] or 1.0
    bin_of = F.when(F.col("radius") > top, BINS).otherwise(F.least(F.floor(F.col("radius") / top * BINS), F.lit(BINS - 1))).cast("int")
    binned = ranked.withColumn("bin", bin_of)
    counts = {r["bin"]: r["count"] for r in binned.groupBy("bin").count().collect()}  # at most BINS + 1 rows
    above, at = 0, BINS
    while at >= 0 and above + counts.get(at, 0) <= wanted:
        above += counts.get(at, 0)
        at -= 1
    tie = Window.partitionBy("bin").orderBy(F.desc("radius"), "cell_id")
    edge = binned.filter(F.col("bin") == at).withColumn("r", F.row_number().over(tie)).filter(F.col("r") <= wanted - above)
    return binned.filter(F.col("bin") > at).select("cell_id", "radius").unionByName(edge.select("cell_id", "radius"))
