"""Layouts of the node graph, and smooth marker profiles along branches."""

from __future__ import annotations

from collections import deque
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudfork.config import Options
from cloudfork.operators.graph import MAX_EDGES, graph_variants
from cloudfork.session import cut


def hop_matrix(n: int, edges: list[tuple[int, int]]) -> np.ndarray:
    near = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    out = np.full((n, n), float(n))
    for s in range(n):
        out[s, s], queue = 0, deque([s])
        while queue:
            a = queue.popleft()
            for b in near[a]:
                if out[s, b] == n and b != s:
                    out[s, b] = out[s, a] + 1
                    queue.append(b)
    return out


def spring_layout(hops: np.ndarray, seed: int, rounds: int = 150) -> tuple[np.ndarray, float]:
    """(xy in [0.1, 0.9], energy): distances pulled towards the hop counts by stress majorisation."""
    n = len(hops)
    xy = np.random.default_rng(seed).normal(size=(n, 2))
    with np.errstate(divide="ignore"):
        w = np.where(hops > 0, 1 / hops**2, 0)
    laplace = np.diag(w.sum(1)) - w
    inverse = np.linalg.pinv(laplace)
    for _ in range(rounds):
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
        ratio = np.where(d > 0, w * hops / np.maximum(d, 1e-12), 0)
        xy = inverse @ ((np.diag(ratio.sum(1)) - ratio) @ xy)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    energy = float((w * (d - hops) ** 2).sum() / 2)
    span = np.where(np.ptp(xy, axis=0) > 0, np.ptp(xy, axis=0), 1)
    return (xy - xy.min(axis=0)) / span * 0.8 + 0.1, energy


def best_layout(spark: SparkSession, graph: DataFrame, tries: int = 16, seed: int = 73) -> DataFrame:
    """(node_id, x, y): of ``tries`` random starts, each its own task, the layout of least energy."""
    rows = graph.select("src", "dst").limit(MAX_EDGES + 1).toPandas()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges")
    nodes = np.unique(rows.to_numpy())
    shared = spark.sparkContext.broadcast((np.searchsorted(nodes, rows["src"]), np.searchsorted(nodes, rows["dst"])))

    def run(batches):
        hops = hop_matrix(len(nodes), list(zip(*shared.value)))
        for pdf in batches:
            for i in pdf["id"]:
                xy, energy = spring_layout(hops, seed + int(i))
                yield pd.DataFrame({"attempt": int(i), "energy": energy, "node_id": nodes, "x": xy[:, 0], "y": xy[:, 1]})

    every = spark.range(0, tries, 1, tries).mapInPandas(run, "attempt long, energy double, node_id long, x double, y double")
    best = F.min(F.struct("energy", "attempt", "x", "y")).alias("b")
    return every.groupBy("node_id").agg(best).select("node_id", "b.x", "b.y")


def chosen_layout(spark: SparkSession, graph: DataFrame, options: Options, tries: int = 16) -> DataFrame:
    """(graph_id, node_id, x, y): the best layout of each of the six graphs that has edges, or of the one that
    ``options.layout_graph`` names, from the starts of ``options.layout_seed`` (else those of ``options.seed``)."""
    variants = cut(graph_variants(graph))
    seed = options.seed if options.layout_seed is None else options.layout_seed
    ids = [r[0] for r in variants.select("graph_id").distinct().orderBy("graph_id").collect()]  # at most six
    if options.layout_graph is not None:
        if options.layout_graph not in ids:
            raise ValueError(f"graph {options.layout_graph} has no edges; there are {ids}")
        ids = [options.layout_graph]
    parts = [best_layout(spark, variants.filter(F.col("graph_id") == i), tries, seed).select(F.lit(i).alias("graph_id"), "*") for i in ids]
    return reduce(DataFrame.unionByName, parts)


def gp_fit(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation at ``at`` of a Gaussian process with a squared-exponential kernel;
    length scale and noise by the marginal likelihood over a grid."""
    mean, scale = y.mean(), y.std() or 1.0
    t, best = (y - mean) / scale, None
    for length in np.geomspace(0.05, 2, 9):
        k = np.exp(-((x[:, None] - x[None]) ** 2) / (2 * length**2))
        for noise in (0.03, 0.1, 0.3, 1.0):
            low = np.linalg.cholesky(k + (noise**2 + 1e-8) * np.eye(len(x)))
            a = np.linalg.solve(low, t)
            score = -0.5 * a @ a - np.log(np.diag(low)).sum()
            if best is None or score > best[0]:
                best = score, length, noise, low, a
    _, length, noise, low, a = best
    v = np.linalg.solve(low, np.exp(-((x[:, None] - at[None]) ** 2) / (2 * length**2)))
    return mean + scale * (v.T @ a), scale * np.sqrt(np.maximum(1 + noise**2 - (v**2).sum(0), 0))


def branch_profiles(values: DataFrame) -> DataFrame:
    """(marker, branch, node_id, signed_dist, mean, sd): for each marker and each branch from the second on,
    a smooth profile over branch 1, the branch point and that branch. values: (marker, node_id, branch, signed_dist, value)."""
    others = values.filter("branch >= 2").select("marker", F.col("branch").alias("path")).distinct()
    paths = values.join(others, "marker").filter((F.col("branch") <= 1) | (F.col("branch") == F.col("path")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["signed_dist", "node_id"])
        x, y = pdf["signed_dist"].to_numpy(float), pdf["value"].to_numpy(float)
        mean, sd = gp_fit(x, y, x)
        return pd.DataFrame({"marker": pdf["marker"], "branch": pdf["path"], "node_id": pdf["node_id"], "signed_dist": x, "mean": mean, "sd": sd})

    return paths.groupBy("marker", "path").applyInPandas(one, "marker string, branch int, node_id long, signed_dist double, mean double, sd double")
