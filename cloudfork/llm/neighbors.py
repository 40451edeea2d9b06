"""Most similar vectors for every vector.

Method: vantage-point trees per shard, with triangle-inequality pruning relaxed by a
factor. A router (a vantage-point tree over a bounded sample) gives every vector its
shard, so one shuffle brings the vectors of a region together; a query travels only to
the shards whose region can hold something nearer than what it has. Factor 1 is exact.

Equal vectors ask once for as many neighbours as any of them needs, and share the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudfork.llm.vectors import (
    COPY, DIM, HOME, POINT, QUERY, ROUTED, SHARD_ROWS, by_shard, complete_cells, copies_rank, depth_for, fit_router, gathered, inner_routers, matrix, route_again, routed_rows,
)
from cloudfork.llm.vptree import Router, Tree
from cloudfork.session import cut, drop_cut

FACTOR = 1.6  # of the approximate search; its recall is measured in tests and README
_FOUND = "query_id long, neighbor_id long, distance double"


def _route(router: Router, dim: int, k: int, reach: float, points: bool, asks: int, factor: float):
    """Vectors to their home shard: as points (of equal vectors the k + 1 with the lowest ids, as no
    list holds another one), and as queries (of equal ones the lowest id) in the role ``asks``, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            ids, x = t.column("id").to_numpy(), matrix(t.column("vec"), dim)
            rows, rank, first = copies_rank(ids, x)
            if asks:
                copy = rank > 0
                yield routed_rows(-1, COPY, ids[rows[copy]], first[copy], 1, 0.0, np.empty((copy.sum(), 0)))
            start = np.flatnonzero(rank == 0)
            size = np.repeat(np.diff(np.r_[start, len(rank)]), np.diff(np.r_[start, len(rank)]))
            travel = rank <= (k if points else 0)
            rows, rank, size = rows[travel], rank[travel], size[travel]
            ids, x = ids[rows], x[rows]
            home = router.home(x)
            yield routed_rows(home, POINT * points | np.where(rank == 0, asks, 0), ids, ids, size, reach, x)
            if asks & QUERY and router.depth:
                one = np.flatnonzero(rank == 0)
                row, shard = router.visits(x[one], np.full(len(one), reach / factor))
                away = shard != home[one[row]]
                row, shard = one[row[away]], shard[away]
                yield routed_rows(shard, QUERY, ids[row], ids[row], size[row], reach, x[row])

    return run


def _roam(router: Router, dim: int, factor: float, again: list[int]):
    """Queries to every shard but their own (unless that is one of ``again``) that may hold something within their reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x, reach = b.column("id").to_numpy(), matrix(b.column("vec"), dim), b.column("reach").to_numpy()
            row, shard = router.visits(x, reach / factor)
            away = (shard != router.home(x)[row]) | np.isin(shard, again)
            row, shard = row[away], shard[away]
            yield routed_rows(shard, QUERY, ids[row], ids[row], 1, reach[row], x[row])

    return run


def _search(dim: int, k: int, factor: float, once: bool):
    """The k nearest points of a shard for each of its queries; an id counts once. With ``once``,
    a vector without copies isn't listed under itself: no other would share that answer."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending")])  # of a query that came more than once, the row that stands for most
        role, ids, reach = (t.column(c).to_numpy() for c in ("role", "id", "reach"))
        x = matrix(t.column("vec"), dim)
        at, ask = (r[np.unique(ids[r], return_index=True)[1]] for r in (np.flatnonzero(role & POINT), np.flatnonzero(role & (QUERY | HOME))))
        a, b, d = np.empty(0, int), np.empty(0, int), np.empty(0)
        if len(at) and len(ask):
            a, b, d = Tree(x[at]).nearest(x[ask], None, ids[at], k, reach[ask], factor)
            use = (ids[ask[a]] != ids[at[b]]) | (t.column("size").to_numpy()[ask[a]] > 1) | (not once)
            a, b, d = a[use], b[use], d[use]
        return pa.table({"query_id": pa.array(ids[ask[a]], pa.int64()), "neighbor_id": pa.array(ids[at[b]], pa.int64()), "distance": pa.array(d, pa.float64())})

    return run


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """At most one row a pair, then the k nearest of each query, ties by smaller neighbour id."""
    pairs = pairs.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_vectors(
    cells: DataFrame,
    k: int = 10,
    *,
    queries: DataFrame | None = None,
    max_distance: float = float("inf"),
    factor: float = 1.0,
    id_col: str = "cell_id",
    vec_col: str = "all_data",
    dim: int = DIM,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, neighbor_id, distance, rank): the ``k`` most similar vectors of each query.

    L2 distance; ties go to the smaller id; rank counts from 1. ``queries`` defaults to
    every vector of ``cells``. ``max_distance`` leaves out farther neighbours (and then
    one pass is enough); ``factor`` >= 1 visits a region only if the triangle inequality
    leaves room for something nearer than distance / factor; 1 is exact.

    Defined cases: rows without id or with an incomplete or infinite vector take no part;
    a repeated id counts once; a vector is not its own neighbour, a copy with another id is
    one at distance 0; every copy has its list. An empty table gives no rows. Extra columns are ignored.
    """
    rows = cells.count()
    points = complete_cells(cells, id_col, vec_col, dim)
    router = fit_router(points, rows, depth_for(points, rows, shard_rows), dim, reach=max_distance)
    once = np.isfinite(max_distance)
    asks = QUERY if once else HOME
    routed = points.mapInArrow(_route(router, dim, k, max_distance, True, asks if queries is None else 0, factor), ROUTED)
    if queries is not None:
        asked = complete_cells(queries, id_col, vec_col, dim)
        routed = routed.unionByName(asked.mapInArrow(_route(router, dim, k, max_distance, False, asks, factor), ROUTED))
    routed = cut(routed)
    copies = cut(routed.filter(F.col("role") == COPY).select("id", "of"))
    placed = routed.filter(F.col("role") != COPY)
    inner = inner_routers(placed, dim, shard_rows, max_distance)
    search = lambda df: by_shard(df, router).applyInArrow(_search(dim, k + 1, factor, once), _FOUND)
    near = cut(search(route_again(placed, inner, dim, shard_rows, factor)))
    if not once and (router.depth or inner is not None):
        known = near.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("worst"))
        own = placed.filter(F.col("role").bitwiseAND(HOME) > 0).select("id", "vec").dropDuplicates(["id"])
        bounded = own.join(known, F.col("id") == F.col("query_id"), "left").select("id", "vec", F.when(F.col("n") > k, F.col("worst")).otherwise(float("inf")).alias("reach"))
        again = [] if inner is None else [r[0] for r in inner.select("shard").collect()]  # some of the router's shards
        later = bounded.mapInArrow(_roam(router, dim, factor, again), ROUTED)
        searched = placed.filter(F.col("role").bitwiseAND(POINT) > 0).withColumn("role", F.lit(POINT))
        near = cut(near.unionByName(search(route_again(searched.unionByName(later), inner, dim, shard_rows, factor))))
    drop_cut(routed)
    shared = near.join(copies, F.col("query_id") == F.col("of")).select(F.col("id").alias("query_id"), "neighbor_id", "distance")
    return _top(near.unionByName(shared).filter("query_id <> neighbor_id"), k)


def mutual_pairs(nearest: DataFrame) -> DataFrame:
    """(cell_a, cell_b) with cell_a < cell_b: each is in the other's list."""
    return (
        nearest.groupBy(F.least("query_id", "neighbor_id").alias("cell_a"), F.greatest("query_id", "neighbor_id").alias("cell_b"))
        .agg(F.countDistinct("query_id").alias("n"))
        .filter("n = 2")
        .select("cell_a", "cell_b")
    )
