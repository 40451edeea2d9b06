"""Grouping records into similarity clusters.

Method: reciprocal-nearest-neighbour average linkage. A sparse graph holds every link no
longer than the threshold; each round merges, in parallel, every pair of clusters that
are each other's best, and averages the links that then run in parallel; it stops when
no link is left within the threshold.

The links come from the sharded vantage-point trees, and the first rounds run where they are
found: a shard sees all links of its own vectors, those to vectors of other shards included, so
it merges its reciprocal pairs until all that are left have their best link outside. (Merging
others can't bring a third cluster nearer, so such a pair would merge in any order of rounds.)
What leaves the shard is one summed link for each two parts, not the pairs within them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudfork.llm.vectors import (
    COPY, DIM, POINT, QUERY, ROUTED, SHARD_ROWS, by_shard, complete_cells, copies_rank, depth_for, fit_router, gathered, inner_routers, matrix, route_again, routed_rows,
)
from cloudfork.llm.vptree import SEARCHED, Router, Tree
from cloudfork.session import cut, cut_counted, drop_cut

HELD = 2_000_000  # links that a shard holds at a time
_PARTS = "a long, b long, w double, n long, member boolean"


def _route(router: Router, dim: int, reach: float):
    """Of equal vectors the one with the smallest id goes, with their number, to its shard and to those within ``reach``; the others say that they are copies of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            ids, x = t.column("id").to_numpy(), matrix(t.column("vec"), dim)
            rows, rank, first = copies_rank(ids, x)
            copy = rank > 0
            yield routed_rows(-1, COPY, ids[rows[copy]], first[copy], 1, 0.0, np.empty((copy.sum(), 0)))
            size = np.diff(np.r_[np.flatnonzero(~copy), len(rows)])
            rows = rows[~copy]
            ids, x = ids[rows], x[rows]
            home = router.home(x)
            yield routed_rows(home, POINT | QUERY, ids, ids, size, reach, x)
            row, shard = router.visits(x, np.full(len(x), reach))
            away = shard != home[row]
            row, shard = row[away], shard[away]
            if len(row):
                yield routed_rows(shard, QUERY, ids[row], ids[row], size[row], reach, x[row])

    return run


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class _Graph:
    """The links between the vectors of a shard and its visitors, summed between the clusters that they form.

    Nodes are numbered by id; ``own`` ones may merge. Of each two nodes a < b: the summed distance
    w over n pairs of vectors, and the part (ew, en) of it that this shard passes on: every link
    is passed on by the shard of its larger id.
    """

    def __init__(self, size: np.ndarray, own: np.ndarray, threshold: float, missing: float | None):
        self.vectors, self.size, self.own, self.threshold, self.missing = size, size.copy(), own, threshold, missing
        self.label, self.linked, self.new, self.waiting = np.arange(len(size)), np.zeros(len(size), bool), [], 0
        self.clear()

    def clear(self) -> None:
        self.a = self.b = self.n = self.en = np.empty(0, int)
        self.w = self.ew = np.empty(0)

    def add(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> int:
        """Takes links between single vectors, each once, a < b; gives how many links are held."""
        self.linked[a] = self.linked[b] = True
        self.new.append((a, b, d))
        self.waiting += len(a)
        return len(self.a) + self.waiting

    def settle(self) -> None:
        if self.new:
            a, b, d = (np.concatenate(x) for x in zip(*self.new))
            n, passed = self.vectors[a] * self.vectors[b], self.own[b]
            self.new, self.waiting = [], 0
            fresh = self.label[a], self.label[b], d * n, n, d * n * passed, n * passed
            self._sum(*(np.concatenate(x) for x in zip((self.a, self.b, self.w, self.n, self.ew, self.en), fresh)))

    def _sum(self, a, b, w, n, ew, en) -> None:
        apart = a != b
        key, at = np.unique((np.minimum(a, b) * len(self.size) + np.maximum(a, b))[apart], return_inverse=True)
        self.a, self.b = key // len(self.size), key % len(self.size)
        self.w, self.ew = (np.bincount(at, x[apart], len(key)) for x in (w, ew))
        self.n, self.en = (np.bincount(at, x[apart], len(key)).astype(int) for x in (n, en))

    def merge(self) -> None:
        """Rounds of reciprocal best pairs among the own nodes, until there is none."""
        while True:
            pairs = self.size[self.a] * self.size[self.b]
            mean = self.w / self.n if self.missing is None else (self.w + self.missing * (pairs - self.n)) / pairs
            live = np.flatnonzero(mean <= self.threshold)
            live = live[np.lexsort((self.b[live], self.a[live], mean[live]))]
            a, b, place = self.a[live], self.b[live], np.arange(len(live))
            best = np.full(len(self.size), len(live))
            np.minimum.at(best, a, place)
            np.minimum.at(best, b, place)
            both = (best[a] == place) & (best[b] == place) & self.own[a] & self.own[b]
            if not both.any():
                return
            to = np.arange(len(self.size))
            to[b[both]] = a[both]
            self.size[a[both]] += self.size[b[both]]
            self.label = to[self.label]
            self._sum(to[self.a], to[self.b], self.w, self.n, self.ew, self.en)

    def reaching(self) -> np.ndarray:
        """Which links belong to parts that reach into another shard."""
        part = _components(len(self.size), self.a, self.b)
        reaches = np.zeros(len(self.size), bool)
        reaches[part[~self.own]] = True
        return reaches[part[self.a]]


def _rows(a, b, w, n, member: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.float64()), pa.array(n, pa.int64()), pa.array(np.full(len(a), member))],
        names=["a", "b", "w", "n", "member"],
    )


def _parts(dim: int, threshold: float, missing: float | None):
    """The clusters that a shard's own vectors form by themselves (member rows: cell a belongs to
    node b), and the summed links from these to one another and to vectors of other shards.

    Equal vectors have one home and visit the same shards, so the smallest id among them is the
    same everywhere. With ``missing``, more than HELD links are passed on as they are, block by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        role, ids, sizes = (t.column(c).to_numpy() for c in ("role", "id", "size"))
        x = matrix(t.column("vec"), dim)
        rows, rank, first = copies_rank(ids, x)
        home = (role[rows] & POINT) > 0
        start = np.flatnonzero(rank == 0)
        size = np.add.reduceat(sizes[rows], start) if len(start) else np.empty(0, int)
        order = np.argsort(ids[rows[start]])
        node, own, size = rows[start][order], home[start][order], size[order]  # nodes by id
        name = ids[node]
        same = home & (rank > 0)
        at = np.flatnonzero(own)
        if not len(at):
            return
        graph, most = _Graph(size, own, threshold, missing), HELD

        def passed(keep: np.ndarray) -> pa.RecordBatch:
            keep = keep & (graph.en > 0)
            return _rows(name[graph.a[keep]], name[graph.b[keep]], graph.ew[keep], graph.en[keep], False)

        tree, queries, whole = Tree(x[node[at]]), x[node], True
        asked = np.concatenate([some for _, _, some in tree._home(queries)])
        after = np.full(len(node), -1)
        after[at[tree.order]] = np.arange(len(at))  # a link between own vectors is found once, by the earlier of them
        for i in range(0, len(asked), SEARCHED):
            some = asked[i : i + SEARCHED]
            for q, p, d in tree.within(queries[some], np.full(len(some), threshold), after=after[some]):
                q, p = some[q], at[p]
                if not len(q) or graph.add(np.minimum(q, p), np.maximum(q, p), d) <= most:
                    continue
                graph.settle()
                if missing is None:  # means of existing links only: any order of merging ends alike
                    graph.merge()
                    most = max(HELD, 2 * len(graph.a))
                else:
                    whole = False
                    yield passed(np.ones(len(graph.a), bool))
                    graph.clear()
        graph.settle()
        if whole:
            graph.merge()
        yield passed(graph.reaching() if whole else np.ones(len(graph.a), bool))
        member = at[graph.linked[at] | (size[at] > 1)]
        a = np.r_[name[member], ids[rows[same]]]
        b = name[graph.label[np.r_[member, np.searchsorted(name, first[same])]]]
        yield _rows(a, b, np.zeros(len(a)), np.zeros(len(a), int), True)

    return run


def similarity_parts(
    cells: DataFrame, threshold: float, *, missing: float | None = None, id_col: str = "cell_id", vec_col: str = "all_data", dim: int = DIM, shard_rows: int = SHARD_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(cell_id, node) of the cells that have a link or a copy, and the links (a, b, w, n) of at most ``threshold`` between nodes.

    A node is a cluster that could be formed within one shard, under its smallest id; w is the
    sum of the distances of n linked pairs of cells.
    """
    rows = cells.count()
    # an id counts once, with the smallest of its vectors
    points = complete_cells(cells, id_col, vec_col, dim).groupBy("id").agg(F.min("vec").alias("vec"))
    router = fit_router(points, rows, depth_for(points, rows, shard_rows), dim, reach=threshold)
    routed = cut(points.mapInArrow(_route(router, dim, threshold), ROUTED))
    placed = routed.filter(F.col("role") != COPY)
    placed = route_again(placed, inner_routers(placed, dim, shard_rows, threshold), dim, shard_rows)
    found = cut(by_shard(placed, router).applyInArrow(_parts(dim, threshold, missing), _PARTS))
    own = found.filter("member").select(F.col("a").alias("cell_id"), F.col("b").alias("node"))
    of = own.select(F.col("cell_id").alias("rep"), "node")
    copies = routed.filter(F.col("role") == COPY).select("id", "of").join(of, F.col("of") == F.col("rep"), "left").select(F.col("id").alias("cell_id"), F.coalesce("node", "of").alias("node"))
    members = cut(own.unionByName(copies))
    drop_cut(routed)
    links = found.filter("not member").select("a", "b", "w", "n")
    for side in ("a", "b"):
        links = links.join(of, F.col(side) == F.col("rep"), "left").withColumn(side, F.coalesce("node", side)).drop("rep", "node")
    return members, links


def reciprocal_linkage(links: DataFrame, threshold: float, missing: float | None = None, max_rounds: int = 100_000, sizes: DataFrame | None = None) -> DataFrame:
    """(node, cluster_id): average linkage on a sparse graph (a, b, distance), by reciprocal best pairs.

    The distance of two clusters is the mean over their links; with ``missing``, pairs of
    members without a link count with that distance. ``sizes`` (node, size): a node that stands
    for several cells counts as so many. Every round merges each pair of
    clusters that are each other's nearest (ties by the smaller ids) within the threshold.
    cluster_id is the smallest node of a cluster; nodes without a link do not appear.
    """
    pairs = (
        links.filter((F.col("a") != F.col("b")) & (F.col("distance") <= threshold))
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.min("distance").alias("w"))
    )
    weighted = _with_sizes(pairs, sizes)
    return _linkage(weighted.withColumn("n", F.col("sa") * F.col("sb")).withColumn("w", F.col("w") * F.col("n")), threshold, missing, max_rounds)


def _with_sizes(links: DataFrame, sizes: DataFrame | None) -> DataFrame:
    for side, size in (("a", "sa"), ("b", "sb")):
        one = F.lit(1).cast("long")
        if sizes is None:
            links = links.withColumn(size, one)
        else:
            of = sizes.select(F.col("node").alias("of"), F.col("size").alias(size))
            links = links.join(of, F.col(side) == F.col("of"), "left").withColumn(size, F.coalesce(size, one)).drop("of")
    return links


def _linkage(start: DataFrame, threshold: float, missing: float | None, max_rounds: int = 100_000) -> DataFrame:
    """``reciprocal_linkage`` of summed links (a, b, w, n, sa, sb), a < b."""
    start = cut(start.select("a", "b", "w", "n", "sa", "sb"))
    pairs = F.col("sa") * F.col("sb")
    mean = F.col("w") / F.col("n") if missing is None else (F.col("w") + missing * (pairs - F.col("n"))) / pairs
    edges, rounds = start, []
    for _ in range(max_rounds):
        live = edges.withColumn("d", mean).filter(F.col("d") <= threshold)
        half = live.select(F.explode(F.array("a", "b")).alias("c"), F.struct("d", "a", "b", "sa", "sb").alias("pair"))
        best = half.groupBy("c").agg(F.min("pair").alias("pair"))
        both = best.groupBy("pair").count().filter("count = 2")
        merges, merged = cut_counted(both.select(F.col("pair.b").alias("old"), F.col("pair.a").alias("new"), (F.col("pair.sa") + F.col("pair.sb")).alias("size")))
        if not merged:
            break
        rounds.append(merges)
        # both clusters of a pair get the smaller id and the common size
        into = merges.select(F.inline(F.array(F.struct(F.col("old").alias("was"), "new", "size"), F.struct(F.col("new").alias("was"), "new", "size"))))
        moved = edges
        for side, size in (("a", "sa"), ("b", "sb")):
            moved = moved.join(into, F.col(side) == F.col("was"), "left").withColumns({side: F.coalesce("new", side), size: F.coalesce("size", size)}).drop("was", "new", "size")
        flip = F.col("a") > F.col("b")
        ordered = moved.filter(F.col("a") != F.col("b")).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", "n",
            F.when(flip, F.col("sb")).otherwise(F.col("sa")).alias("sa"), F.when(flip, F.col("sa")).otherwise(F.col("sb")).alias("sb"),
        )
        old = edges
        edges = cut(ordered.groupBy("a", "b", "sa", "sb").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).select("a", "b", "w", "n", "sa", "sb"))
        if old is not start:
            drop_cut(old)
    else:
        raise RuntimeError(f"linkage did not end in {max_rounds} rounds")
    labels = start.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("cluster_id", F.col("node"))
    for i, merges in enumerate(rounds, start=1):
        step = merges.select("old", "new")
        labels = labels.join(step, F.col("cluster_id") == F.col("old"), "left").select("node", F.coalesce("new", "cluster_id").alias("cluster_id"))
        if i % 6 == 0:
            labels = cut(labels)
    return labels


def similarity_clusters(cells: DataFrame, threshold: float, *, missing: float | None = None, **graph) -> DataFrame:
    """(cluster_id, cell_id) of every complete cell that has a link or a copy; cluster_id is the smallest cell_id of the cluster.

    ``missing`` None: the mean over the links that exist, which never exceeds the threshold,
    so that linked clusters merge until each is a whole transitively linked set. A number above
    the threshold: average linkage in which unlinked members count with that distance and hold
    clusters apart. Every link within the threshold counts, however many a cell has; equal means
    go to the smaller ids. Copies of a vector count each for itself and belong together.

    Cells without id or complete vector take no part; a repeated id counts once, with the
    smallest of its vectors; an empty table gives no rows; extra columns are ignored.
    """
    members, links = similarity_parts(cells, threshold, missing=missing, **graph)
    between = links.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    sizes = None if missing is None else members.groupBy("node").agg(F.count("*").alias("size"))
    labels = _linkage(_with_sizes(between, sizes), threshold, missing).withColumnRenamed("node", "part")
    return members.join(labels, F.col("node") == F.col("part"), "left").select(F.coalesce("cluster_id", "node").alias("cluster_id"), "cell_id")


def cluster_profiles(
    members: DataFrame, cells: DataFrame, typical: int = 3, id_col: str = "cell_id", vec_col: str = "all_data", dim: int = DIM
) -> DataFrame:
    """(cluster_id, size, spread, typical): the size of each cluster, the mean distance to its
    mean vector, and its ``typical`` members nearest to that mean (ties by smaller id).

    The most typical members are kept by a bounded per-group minimum, not by collecting the group.
    """
    points = complete_cells(cells, id_col, vec_col, dim)
    # an id counts once, with the vector by which it was placed
    inside = members.join(points, members["cell_id"] == points["id"]).groupBy("cluster_id", "cell_id").agg(F.min("vec").alias("vec"))
    mean = inside.groupBy("cluster_id").agg(F.array(*[F.avg(F.col("vec")[i]) for i in range(dim)]).alias("mean"), F.count("*").alias("size"))
    apart = F.sqrt(F.aggregate(F.zip_with("vec", "mean", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = inside.join(mean, "cluster_id").select("cluster_id", "cell_id", "size", apart.alias("d"))
    # rank within salted parts first, then among the few that are left
    part = Window.partitionBy("cluster_id", F.pmod(F.xxhash64("cell_id"), F.lit(64))).orderBy("d", "cell_id")
    kept = near.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= typical)
    whole = Window.partitionBy("cluster_id").orderBy("d", "cell_id")
    tops = kept.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= typical)
    return (
        near.groupBy("cluster_id").agg(F.first("size").alias("size"), F.avg("d").alias("spread"))
        .join(tops.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "cell_id"))), lambda x: x["cell_id"]).alias("typical")), "cluster_id")
    )
