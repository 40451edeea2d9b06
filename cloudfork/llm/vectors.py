"""Shared steps of the vector operators: complete cells, routing to shards, Arrow helpers.

A routed row is (shard, role, id, of, size, reach, vec). A router, fitted to a bounded sample,
gives every vector its home shard and the shards that it visits; a shard that still gets too
many points is routed again by a router of its own, so shards stay small however many rows there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudfork.llm.vptree import Router
from cloudfork.session import cut

DIM = 12
SHARD_ROWS = 131_072  # points that a shard should hold
LEAST_ROWS = 2_000  # fewer aren't worth a shard of their own, even if cores are idle
SAMPLE_ROWS = 131_072  # bound of a sample from which a router is fitted
GATHERED = 131_072  # rows of a partition that are looked at together
POINT, QUERY, HOME, COPY = 1, 2, 4, 8  # roles: is searched; searches within its reach; searches in its own shard; only says of which row it is a copy
ROUTED = "shard long, role int, id long, of long, size long, reach double, vec array<double>"
_ROUTER = "shard long, depth int, centres array<double>, radii array<double>"


def complete_cells(cells: DataFrame, id_col: str = "cell_id", vec_col: str = "all_data", dim: int = DIM) -> DataFrame:
    """(id BIGINT, vec ARRAY<DOUBLE>) of the rows with an id and ``dim`` finite values.

    Null ids, null or short vectors, null, NaN and infinite elements drop the row.
    Re-delivered rows stay; every operator counts an id once.
    """
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return cells.filter(F.col(id_col).isNotNull() & (F.size(v) == dim) & ~bad).select(
        F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec")
    )


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of a matrix."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [p.flatten().to_numpy(zero_copy_only=False) for p in parts]
    return (np.concatenate(flat) if flat else np.empty(0)).reshape(-1, dim)


def lists(x: np.ndarray) -> pa.ListArray:
    n, dim = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(x.ravel()))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = GATHERED) -> Iterator[pa.Table]:
    """The rows of a partition in tables of about ``rows`` rows, none of them empty."""
    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def copies_rank(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Among some rows, without repeats of an id with the same vector: the row numbers kept,
    the rank of each by id among equal vectors, and the smallest such id."""
    keys = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, group = np.unique(keys, return_inverse=True)
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])] if len(g) else np.empty(0, bool)
    order, g, i = order[new], g[new], i[new]
    first = np.searchsorted(g, g)
    return order, np.arange(len(g)) - first, i[first]


def depth_for(points: DataFrame, rows: int, shard_rows: int) -> int:
    """Of a router: shards of ``shard_rows``, or smaller ones while there are fewer than two for each core."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    return max(0, math.ceil(math.log2(max(1, rows / shard_rows, min(2 * cores, rows / LEAST_ROWS)))))


def fit_router(points: DataFrame, rows: int, depth: int, dim: int, sample_rows: int = SAMPLE_ROWS, reach: float = math.inf) -> Router:
    """A router with 2 ** ``depth`` shards, or as many as have 16 rows in the largest sample.

    ``rows`` may be an upper estimate. The sample is chosen by hash of the id and is all that
    reaches the driver; every row is routed.
    """
    depth = min(depth, int(math.log2(max(1, sample_rows // 16))))
    if depth == 0:
        return Router(0, np.zeros((0, dim)), np.zeros(0))
    wanted = min(sample_rows, max(2048, 64 * 2**depth))
    sample = points.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // wanted))) == 0).select("vec").limit(sample_rows).toArrow()
    return Router.fit(matrix(sample.column("vec"), dim), depth, reach)


def routed_rows(shard, role, ids, of, size, reach, x) -> pa.RecordBatch:
    """Routed rows as a batch; a number stands for that number in every row."""
    n = len(ids)
    whole = lambda v, kind: pa.array(np.broadcast_to(v, n), kind)
    return pa.RecordBatch.from_arrays(
        [whole(shard, pa.int64()), whole(role, pa.int32()), pa.array(ids, pa.int64()), whole(of, pa.int64()), whole(size, pa.int64()), whole(reach, pa.float64()), lists(x)],
        names=["shard", "role", "id", "of", "size", "reach", "vec"],
    )


def by_shard(routed: DataFrame, router: Router):
    """The rows grouped by shard, spread over so many tasks that few get two shards."""
    spark = routed.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * 2**router.depth)
    return routed.repartition(tasks, "shard").groupBy("shard")


def inner_routers(routed: DataFrame, dim: int, shard_rows: int, reach: float, sample_rows: int = SAMPLE_ROWS) -> DataFrame | None:
    """(shard, depth, centres, radii, n) for the shards that got over four times ``shard_rows`` points; None if none did."""
    points = routed.filter(F.col("role").bitwiseAND(POINT) > 0)
    large = points.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * shard_rows).collect()  # a row a shard
    if not large:
        return None
    sizes = routed.sparkSession.createDataFrame([tuple(r) for r in large], "shard long, n long")
    depth = F.least(F.ceil(F.log2(F.col("n") / shard_rows)), F.lit(int(math.log2(max(2, sample_rows // 16))))).cast("int")
    every = F.greatest(F.lit(1), F.floor(F.col("n") / F.least(F.lit(sample_rows), F.greatest(F.lit(2048), 64 * F.pow(F.lit(2), "depth")))).cast("long"))
    sample = points.join(sizes.withColumn("depth", depth).withColumn("every", every), "shard").filter(F.pmod(F.xxhash64("id"), F.col("every")) == 0)

    def fit(t: pa.Table) -> pa.Table:
        r = Router.fit(matrix(t.column("vec"), dim), t.column("depth")[0].as_py(), reach)
        return pa.table({"shard": t.column("shard").slice(0, 1), "depth": pa.array([r.depth], pa.int32()), "centres": lists(r.centres.reshape(1, -1)), "radii": lists(r.radii.reshape(1, -1))})

    return cut(sample.select("shard", "depth", "vec").groupBy("shard").applyInArrow(fit, _ROUTER).join(sizes, "shard"))


def route_again(routed: DataFrame, inner: DataFrame | None, dim: int, shard_rows: int, factor: float = 1.0) -> DataFrame:
    """The rows of the shards that have an inner router, placed by it; the others as they are.

    The rows of a shard are dealt to as many tasks as it needs, each with a copy of the router.
    """
    if inner is None:
        return routed
    parts = F.ceil(F.col("n") / shard_rows)
    dealt = inner.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n")
    rows = routed.join(inner.select("shard", "n"), "shard").withColumn("part", F.pmod(F.xxhash64("id", "role"), parts)).drop("n")

    def place(t: pa.Table, r: pa.Table) -> pa.Table:
        router = Router(r.column("depth")[0].as_py(), matrix(r.column("centres"), dim), matrix(r.column("radii"), 1).ravel())
        role, x, reach = t.column("role").to_numpy(), matrix(t.column("vec"), dim), t.column("reach").to_numpy()
        home = router.home(x)
        settled, roams = (role & (POINT | HOME)) > 0, np.flatnonzero(role & QUERY)
        row, to = router.visits(x[roams], reach[roams] / factor)
        row = roams[row]
        away = ~settled[row] | (to != home[row])
        row, to = np.r_[np.flatnonzero(settled), row[away]], np.r_[home[settled], to[away]]
        role = np.r_[role[settled], np.full(away.sum(), QUERY)]
        ids, of, size = (t.column(c).to_numpy()[row] for c in ("id", "of", "size"))
        shard = t.column("shard")[0].as_py() if t.num_rows else 0
        return pa.Table.from_batches([routed_rows((shard + 1) * 2**32 + to, role, ids, of, size, reach[row], x[row])])

    both = rows.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(place, ROUTED)
    return routed.join(inner.select("shard"), "shard", "left_anti").unionByName(both)
