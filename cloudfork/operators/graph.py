"""Trees over reference nodes, their ensemble, and the branches on which the ensemble agrees.

Spark spreads the work by tree or by cut node; inside a task small numpy helpers handle one
tree or one block of nodes x nodes. All trees together are n_trees x (n_nodes - 1) edges, a
size that the options bound (checked: MAX_EDGES); they are broadcast once, and what is computed
from them runs in tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudfork.operators.distance import METRICS
from cloudfork.session import cut, drop_cut

MAX_EDGES = 5_000_000
FAN_IN = 8  # partitions whose spanning forests are joined at a time
SMALL_SHARE = 0.01  # of the nodes; parts up to that size are no branches
THRESHOLDS = tuple(range(99, 0, -1))  # percent of the trees


def minimum_spanning_edges(x: np.ndarray, metric: str = "L1") -> list[tuple[int, int, float]]:
    """(i, j, length) with i < j of a minimum spanning tree of the rows; ties by length, i, j. Zero lengths are edges too."""
    n = len(x)
    if n < 2:
        return []
    measure = METRICS[metric]
    best, parent, out = measure(x[:1], x)[0], np.zeros(n, int), []
    done = np.zeros(n, bool)
    done[0] = True
    for _ in range(n - 1):
        open_ = np.flatnonzero(~done)
        lo, hi = np.minimum(parent[open_], open_), np.maximum(parent[open_], open_)
        j = int(open_[np.lexsort((hi, lo, best[open_]))[0]])
        i = int(parent[j])
        out.append((min(i, j), max(i, j), float(best[j])))
        done[j] = True
        d = measure(x[j : j + 1], x)[0]
        closer = (d < best) | ((d == best) & (j < parent))
        closer &= ~done
        best[closer], parent[closer] = d[closer], j
    return sorted(out)


def tree_ensemble(samples: DataFrame, metric: str = "L1") -> DataFrame:
    """(tree_id, src, dst, dist): the minimum spanning tree of each tree's sampled rows (tree_id, node_id, features)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        ids = pdf["node_id"].to_numpy()
        rows = minimum_spanning_edges(np.stack(pdf["features"].to_numpy()).astype(float), metric)
        return pd.DataFrame([(pdf["tree_id"].iloc[0], ids[i], ids[j], d) for i, j, d in rows], columns=["tree_id", "src", "dst", "dist"])

    return samples.select("tree_id", "node_id", "features").groupBy("tree_id").applyInPandas(one, "tree_id long, src long, dst long, dist double")


def ensemble_graph(edges: DataFrame) -> DataFrame:
    """(src, dst, freq, mean_len, inv_freq) of each edge over all trees that have it."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("freq"), F.avg("dist").alias("mean_len")).withColumn("inv_freq", F.lit(1.0) / F.col("freq"))


def spanning_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The rows of a minimum spanning forest of some edges; ties by position. Every round each part takes its least edge outward."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    order = np.argsort(w, kind="stable")
    place = np.empty(len(w), int)
    place[order] = np.arange(len(w))
    label, taken, open_ = np.arange(len(nodes)), [], np.flatnonzero(a != b)
    while len(open_):
        la, lb = label[a[open_]], label[b[open_]]
        least = np.full(len(nodes), len(w))
        np.minimum.at(least, la, place[open_])
        np.minimum.at(least, lb, place[open_])
        chosen = order[np.unique(least[least < len(w)])]
        taken.append(chosen)
        label = part_labels(len(nodes), label[a[chosen]], label[b[chosen]])[label]
        open_ = open_[label[a[open_]] != label[b[open_]]]
    return np.concatenate(taken) if taken else np.empty(0, int)


def minimum_forest(graph: DataFrame, weight: str) -> DataFrame:
    """(src, dst, w): a minimum spanning forest of a graph that may have any number of edges.

    Each partition keeps a forest of its own edges, FAN_IN forests are joined and thinned again,
    and so on to one; no edge outside such a forest can be in that of the whole. A forest has fewer edges than
    there are nodes, which is what the last task holds. Loops and edges without weight drop out.
    """

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for i, batch in enumerate(itertools.chain(batches, [None])):
            held += [] if batch is None else [batch]
            if held and (batch is None or i % 64 == 63):
                t = pa.Table.from_batches(held).combine_chunks()
                rows = spanning_forest(*(t.column(c).to_numpy() for c in ("src", "dst", "w")))
                held = t.take(pa.array(rows)).combine_chunks().to_batches()
        yield from held

    forest = graph.filter(F.col(weight).isNotNull()).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col(weight).cast("double").alias("w"))
    parts = max(1, int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    forest = cut(forest.mapInArrow(thin, forest.schema))
    while parts > 1:
        parts, old = -(-parts // FAN_IN), forest
        forest = cut(forest.repartition(parts).mapInArrow(thin, forest.schema))
        drop_cut(old)
    return forest


def bottleneck(graph: DataFrame, weight: str = "inv_freq") -> float | None:
    """The smallest threshold at which the edges not above it still connect all nodes; None if they never do.

    It is the heaviest edge of a minimum spanning tree.
    """
    nodes = graph.select(F.explode(F.array("src", "dst")).alias("node")).distinct().count()
    row = minimum_forest(graph, weight).agg(F.max("w").alias("w"), F.count("*").alias("n")).first()
    return row["w"] if nodes and row["n"] == nodes - 1 else None


def part_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's part, of n nodes linked by a-b."""
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


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node of each node's component, by spreading minima over
    the edges and jumping along them; each round is two small joins and is written out."""
    both = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct())
    label = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")).select(F.col("a").alias("node"), F.col("low").alias("component"))
    step = None
    for _ in range(max_rounds):
        label = cut(label)
        if step is not None:
            drop_cut(step)
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        hop = label.select(F.col("node").alias("via"), F.col("component").alias("up"))
        step = (
            label.join(near, F.col("node") == F.col("a")).join(hop, F.col("component") == F.col("via"), "left")
            .select("node", "component", F.least("component", "near", "up").alias("new"))
        )
        old, step = label, cut(step)
        if step.filter("component <> new").isEmpty():
            drop_cut(step)
            drop_cut(both)
            return label
        drop_cut(old)
        label = step.select("node", F.col("new").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def graph_variants(graph: DataFrame) -> DataFrame:
    """(graph_id, name, src, dst, weight, inverse, boolean): full, tenth and sparsest graph, by length and by frequency.

    tenth drops the least frequent edges up to the first tenth of the distribution (empty if that
    disconnects the nodes); sparsest keeps the edges that the connecting threshold needs.
    """
    from cloudfork.operators.contingency import distribution

    graph = cut(graph)
    cutoff = bottleneck(graph)
    ecdf = distribution(graph, "inv_freq", [])
    level = ecdf.filter("ecdf >= 0.9").agg(F.min("inv_freq")).first()[0]
    tenth = graph.filter(F.col("inv_freq") <= F.lit(level)) if cutoff is not None and level is not None and level >= cutoff else graph.limit(0)
    sparse = graph.filter(F.col("inv_freq") <= F.lit(cutoff)) if cutoff is not None else graph.limit(0)
    out = None
    for i, (name, g, w) in enumerate(
        (("full_dist", graph, "mean_len"), ("full_freq", graph, "inv_freq"), ("tenth_dist", tenth, "mean_len"), ("tenth_freq", tenth, "inv_freq"), ("sparse_dist", sparse, "mean_len"), ("sparse_freq", sparse, "inv_freq")), start=1
    ):
        part = g.select(F.lit(i).alias("graph_id"), F.lit(name).alias("name"), "src", "dst", F.col(w).alias("weight"), F.try_divide(F.lit(1.0), F.col(w)).alias("inverse"), F.lit(1).alias("boolean"))
        out = part if out is None else out.unionByName(part)
    return out


def _tree_arrays(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    rows = edges.select("tree_id", "src", "dst").limit(MAX_EDGES + 1).toPandas()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} tree edges")
    nodes = np.unique(rows[["src", "dst"]].to_numpy())
    trees = np.unique(rows["tree_id"].to_numpy())
    packed = np.stack([np.searchsorted(trees, rows["tree_id"]), np.searchsorted(nodes, rows["src"]), np.searchsorted(nodes, rows["dst"])], axis=1).astype(np.int32)
    return nodes, packed[np.argsort(packed[:, 0], kind="stable")], len(trees)


def consistency_block(packed: np.ndarray, n: int, n_trees: int, cut_node: int) -> np.ndarray:
    """How many trees keep i and j connected after ``cut_node`` is taken out, for all i, j."""
    keep = packed[(packed[:, 1] != cut_node) & (packed[:, 2] != cut_node)]
    a, b = keep[:, 0].astype(np.int64) * n + keep[:, 1], keep[:, 0].astype(np.int64) * n + keep[:, 2]
    label = part_labels(n_trees * n, a, b)  # of all trees at once
    label = label.reshape(n_trees, n) % n
    counts = np.zeros((n, n), np.float32)
    for row in label:
        onehot = np.zeros((n, n), np.float32)
        onehot[np.arange(n), row] = 1
        counts += onehot @ onehot.T
    counts[cut_node, :] = counts[:, cut_node] = -1
    return counts.astype(np.int64)


def linkage_parts(counts: np.ndarray, nodes: np.ndarray, level: int) -> np.ndarray:
    """Smallest member of each node's part when nodes with at least ``level`` common trees are linked."""
    a, b = np.nonzero(np.triu(counts >= level, 1))
    keep = np.isin(a, nodes) & np.isin(b, nodes)
    return part_labels(len(counts), a[keep], b[keep])


def branch_sizes(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node_id, threshold, rank, size): for each node taken out, and each threshold in percent of the
    trees, the sizes of the parts of at least two nodes that stay together, largest first.

    One task a group of cut nodes; no tensor over all nodes is ever built.
    """
    nodes, trees, n_trees = _tree_arrays(edges)
    shared = spark.sparkContext.broadcast(trees)

    def cut_all(batches):
        packed = shared.value
        for pdf in batches:
            rows = []
            for c in pdf["id"]:
                counts = consistency_block(packed, len(nodes), n_trees, int(c))
                others = np.delete(np.arange(len(nodes)), c)
                for thr in THRESHOLDS:
                    level = -(-thr * n_trees // 100)  # connected in at least thr percent of the trees
                    sizes = np.sort(np.bincount(linkage_parts(counts, others, level)[others]))[::-1]
                    rows += [(int(nodes[c]), thr, r, int(s)) for r, s in enumerate(sizes[sizes >= 2], start=1)]
            yield pd.DataFrame(rows, columns=["node_id", "threshold", "rank", "size"])

    return spark.range(0, len(nodes), 1, min(len(nodes), 200) or 1).mapInPandas(cut_all, "node_id long, threshold int, rank int, size int")


def branching_scores(sizes: DataFrame, nodes: DataFrame, n_nodes: int) -> DataFrame:
    """(node_id, score): the mean over thresholds of the percentage of nodes in the third and smaller parts; 0 without any."""
    third = sizes.filter("rank >= 3").groupBy("node_id").agg((F.sum("size") * 100 / F.lit(n_nodes) / F.lit(len(THRESHOLDS))).alias("score"))
    return nodes.select("node_id").join(third, "node_id", "left").na.fill(0.0, ["score"])


def best_branches(spark: SparkSession, edges: DataFrame, sizes: DataFrame, scores: DataFrame, three: bool = False) -> DataFrame:
    """(node_id, branch): the branches around the best-scoring node; it is branch 0, the others 1, 2, ... by size.

    The threshold is the highest at which the third part is largest. Parts of one node, or of no
    more than SMALL_SHARE of the nodes, join the branch of the node with which each of theirs stays
    together most often; ``three`` keeps the largest three only. Without a third part every node is branch 1.
    """
    nodes, trees, n_trees = _tree_arrays(edges)
    top = scores.orderBy(F.desc("score"), "node_id").first()
    third = None if top is None else sizes.filter((F.col("node_id") == top["node_id"]) & (F.col("rank") == 3)).orderBy(F.desc("size"), F.desc("threshold")).first()
    if third is None:
        return spark.createDataFrame([(int(n), 1) for n in nodes], "node_id long, branch int")
    shared, at, level = spark.sparkContext.broadcast(trees), int(np.searchsorted(nodes, top["node_id"])), -(-third["threshold"] * n_trees // 100)

    def branches(batches):
        for _ in batches:
            label = _branch_labels(consistency_block(shared.value, len(nodes), n_trees, at), at, level, three)
            yield pd.DataFrame({"node_id": nodes, "branch": label})

    return spark.range(0, 1, 1, 1).mapInPandas(branches, "node_id long, branch int")


def _branch_labels(counts: np.ndarray, at: int, level: int, three: bool) -> np.ndarray:
    """Of every node its branch, 0 at the branch point, from how often two nodes stay together without that."""
    others = np.delete(np.arange(len(counts)), at)
    label = linkage_parts(counts, others, level)
    parts, size = np.unique(label[others], return_counts=True)
    order = np.lexsort((parts, -size))
    large = parts[order][:3] if three else parts[size > max(1, SMALL_SHARE * len(counts))]
    inside, whole = others[np.isin(label[others], large)], label.copy()
    for n in others[~np.isin(label[others], large)]:
        label[n] = whole[inside[int(np.argmax(counts[n, inside]))]]
    parts, size = np.unique(label[others], return_counts=True)
    rank = {p: i for i, p in enumerate(parts[np.lexsort((parts, -size))], start=1)}
    return np.array([0 if i == at else rank[label[i]] for i in range(len(counts))])


def tree_hops(edges: DataFrame, source: int) -> DataFrame:
    """(tree_id, node_id, hops) from the source node, in every tree; unreachable nodes have no row."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in zip(pdf["src"], pdf["dst"]):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        hops, front = {source: 0}, [source]
        while front:
            front = [b for a in front for b in near.get(a, ()) if b not in hops and not hops.update({b: hops[a] + 1})]
        return pd.DataFrame({"tree_id": pdf["tree_id"].iloc[0], "node_id": list(hops), "hops": list(hops.values())})

    return edges.select("tree_id", "src", "dst").groupBy("tree_id").applyInPandas(one, "tree_id long, node_id long, hops int")


def signed_distance(hops: DataFrame, branches: DataFrame) -> DataFrame:
    """(node_id, branch, signed_dist): mean hops over the trees, scaled to at most 1, negative on branch 1."""
    mean = hops.groupBy("node_id").agg(F.avg("hops").alias("m"))
    largest = mean.agg(F.max("m").alias("largest"))
    joined = mean.join(branches, "node_id").crossJoin(largest)  # one row
    scaled = F.coalesce(F.try_divide(F.col("m"), F.col("largest")), F.lit(0.0))
    return joined.select("node_id", "branch", F.when(F.col("branch") == 1, -scaled).otherwise(scaled).alias("signed_dist"))


def shortest_paths(edges: DataFrame, source: int, max_rounds: int = 10_000) -> DataFrame:
    """(node, dist): weighted shortest distance from the source over an undirected graph (src, dst, weight >= 0).

    Each round relaxes the edges of all nodes at once and is written out; it ends when nothing gets nearer.
    """
    both = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight").union(edges.select("dst", "src", "weight")))
    known = both.sparkSession.createDataFrame([(source, 0.0)], "node long, dist double")
    known = cut(known)
    for _ in range(max_rounds):
        step = both.join(known, F.col("a") == F.col("node")).select(F.col("b").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"))
        new = cut(known.union(step).groupBy("node").agg(F.min("dist").alias("dist")))
        if new.join(known, ["node", "dist"], "left_anti").isEmpty():
            drop_cut(known)
            return new
        drop_cut(known)
        known = new
    raise RuntimeError(f"no end of relaxation in {max_rounds} rounds")
