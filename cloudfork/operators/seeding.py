"""Reference nodes: scalable k-means++ seeding of medoids, and the partition of rows by them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudfork.operators.distance import METRICS, nearest_node, squared_to_nearest
from cloudfork.operators.sampling import uniform
from cloudfork.session import cut, drop_cut


def k_medoids(distance: np.ndarray, k: int, seed: int = 73, max_rounds: int = 100) -> np.ndarray:
    """Row numbers of k medoids of a small distance matrix: each round takes, for every cluster,
    the point of least total distance to its members, until the assignment stays."""
    rng = np.random.default_rng(seed)
    medoids = np.sort(rng.choice(len(distance), k, replace=False))
    for _ in range(max_rounds):
        label = distance[:, medoids].argmin(axis=1)
        member = np.zeros((len(distance), k))
        member[np.arange(len(distance)), label] = 1
        new = np.sort((distance @ member).argmin(axis=0))
        if (new == medoids).all():
            break
        medoids = new
    return np.unique(medoids)


def seed_nodes(cells: DataFrame, k: int, metric: str = "L1", *, key: str = "vec_id", features: str = "features", rounds: int = 3, seed: int = 73, most_rounds: int = 12) -> DataFrame:
    """(node_id, key, features): k representative rows, numbered by key.

    Scalable k-means++: from one row on, every round adds each row with probability
    k phi / sum phi (phi: squared distance to the nearest candidate), at least ``rounds`` times and
    until there are k; the some 3 k candidates are then grouped by k-medoids. Draws depend on
    key and seed only. Fewer than k distinct rows: an error.
    """
    cells = cells.select(key, features)
    first = cells.orderBy(uniform(F.col(key), seed=seed), key).limit(1)
    chosen = cut(first)
    for r in range(most_rounds):
        if r >= rounds and chosen.count() >= k:
            break
        names = dict(key=key, features=features, node="node_id")
        phi = cut(squared_to_nearest(cells, chosen.select(F.col(key).alias("node_id"), features), metric, **names))
        total = phi.agg(F.sum("phi")).first()[0] or 0.0
        if total == 0:
            break
        picked, old = phi.filter(uniform(F.col(key), seed=seed + r + 1) < F.col("phi") * k / total).select(key), chosen
        chosen = cut(chosen.unionByName(cells.join(picked, key, "left_semi")).dropDuplicates([key]))
        drop_cut(phi)
        drop_cut(old)
    kind, distinct = dict(cells.dtypes)[key], chosen.select(features).distinct().count()
    if distinct < k:
        raise ValueError(f"only {distinct} distinct candidates for {k} nodes")

    def group(batches):
        """Some rounds * k candidates, in one task."""
        pdf = pd.concat(list(batches)).sort_values(key, ignore_index=True)
        points = np.stack(pdf[features].to_numpy()).astype(float) if len(pdf) else np.empty((0, 1))
        pdf = pdf.iloc[np.sort(np.unique(points, axis=0, return_index=True)[1])].reset_index(drop=True)
        points = np.stack(pdf[features].to_numpy()).astype(float)
        medoids = k_medoids(METRICS[metric](points, points), k, seed)
        spare = [i for i in np.random.default_rng(seed).permutation(len(pdf)) if i not in set(medoids)]
        picked = pdf.iloc[sorted([*medoids.tolist(), *spare[: k - len(medoids)]])]
        yield pd.DataFrame({"node_id": np.arange(1, k + 1), key: picked[key].to_numpy(), features: picked[features].to_numpy()})

    return cut(chosen.select(key, F.col(features).cast("array<double>").alias(features)).repartition(1).mapInPandas(group, f"node_id long, {key} {kind}, {features} array<double>"))


def partition_rows(cells: DataFrame, nodes: DataFrame, outlier_keys: DataFrame | None, metric: str = "L1", *, key: str = "vec_id", features: str = "features") -> DataFrame:
    """(key, node_id) of every row: its nearest node, 0 for outliers."""
    near = nearest_node(cells, nodes, metric, key=key, features=features).select(key, "node_id")
    if outlier_keys is None:
        return near
    flagged = outlier_keys.select(F.col(key).alias("_out")).distinct()
    return near.join(flagged, F.col(key) == F.col("_out"), "left").select(key, F.when(F.col("_out").isNotNull(), 0).otherwise(F.col("node_id")).alias("node_id"))
