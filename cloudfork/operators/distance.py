"""Distances of rows to a bounded set of reference nodes, and what follows from them.

A node set has at most MAX_NODES rows, which is checked when it is fetched; each task then
meets its rows with the node matrix, batch by batch. References of densities may be more; they
are met in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_NODES = 10_000
CELLS_AT_ONCE = 1_000_000  # entries of a distance block


def _l1(x, y):
    return np.abs(x[:, None, :] - y[None, :, :]).sum(axis=2)


def _l2(x, y):
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))


def _cosine(x, y):
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.clip((x @ y.T) / np.sqrt((x**2).sum(1))[:, None] / np.sqrt((y**2).sum(1))[None], -1, 1)


def _angle(x, y):
    return np.arccos(_cosine(x, y)) / np.pi


#: L1, L2, angle (arccos / pi) and cosine distance. A zero vector has no angle: NaN.
METRICS: dict[str, Callable] = {"L1": _l1, "L2": _l2, "angle": _angle, "cosine": lambda x, y: 1 - _cosine(x, y)}


def fetch_nodes(nodes: DataFrame, node: str, features: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) ordered by id; an error beyond MAX_NODES rows."""
    rows = nodes.select(F.col(node).cast("long"), F.col(features).cast("array<double>")).limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes")
    rows.sort(key=lambda r: r[0])
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)


def column_centre(cells: DataFrame, features: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and length of the centred values of every position."""
    v = F.col(features).cast("array<double>")
    row = cells.agg(*[F.avg(v[i]) for i in range(dim)], *[F.var_pop(v[i]) for i in range(dim)], F.count("*")).first()
    return np.array(row[:dim], float), np.sqrt(np.array(row[dim : 2 * dim], float) * row[2 * dim])


def correlation_metric(absolute: bool, x_stats, y_stats) -> Callable:
    """1 - the product of vectors whose columns are centred and scaled to length 1 over their own table
    (1 - its absolute value with ``absolute``)."""

    def run(x, y):
        a, b = (x - x_stats[0]) / x_stats[1], (y - y_stats[0]) / y_stats[1]
        product = a @ b.T
        return 1 - (np.abs(product) if absolute else product)

    return run


def per_batch(cells: DataFrame, key: str, features: str, nodes, metric: str | Callable, reduce: Callable, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``reduce(ids, distances, node_ids, extras) -> columns`` over blocks of rows times all nodes."""
    ids, matrix = nodes
    measure = METRICS[metric] if isinstance(metric, str) else metric
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, CELLS_AT_ONCE // max(1, len(ids)) // max(1, matrix.shape[1] if matrix.ndim == 2 else 1) * 8)
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                columns = reduce(part.column(0).to_numpy(), measure(x, matrix), ids, [part.column(2 + i) for i in range(len(extra))])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    chosen = cells.filter(F.col(features).isNotNull()).select(F.col(key).cast("long"), F.col(features).cast("array<double>"), *extra)
    return chosen.mapInArrow(run, schema)


def node_distances(cells: DataFrame, nodes: DataFrame, metric: str | Callable = "L1", *, key: str = "vec_id", node: str = "node_id", features: str = "features") -> DataFrame:
    """(key, node, distance): every row against every node. Rows without vector drop out."""

    def rows(ids, d, node_ids, _):
        return np.repeat(ids, d.shape[1]), np.tile(node_ids, d.shape[0]), d.ravel()

    return per_batch(cells, key, features, fetch_nodes(nodes, node, features), metric, rows, f"{key} long, {node} long, distance double")


def nearest_node(
    cells: DataFrame, nodes: DataFrame, metric: str | Callable = "L1", *, key: str = "vec_id", node: str = "node_id", features: str = "features", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, node, distance, keep...): the nearest node of each row, ties by the smaller id; ``keep`` names columns that stay beside it."""

    def rows(ids, d, node_ids, kept):
        at = d.argmin(axis=1)
        return ids, node_ids[at], d[np.arange(len(d)), at], *kept

    kinds = dict(cells.dtypes)
    schema = f"{key} long, {node} long, distance double" + "".join(f", {c} {kinds[c]}" for c in keep)
    return per_batch(cells, key, features, fetch_nodes(nodes, node, features), metric, rows, schema, keep)


def squared_to_nearest(cells: DataFrame, nodes: DataFrame, metric: str = "L1", **names) -> DataFrame:
    """(key, node, phi): squared distance to the nearest node. Only L1, L2 and angle."""
    if metric not in ("L1", "L2", "angle"):
        raise ValueError(f"no squared distance for {metric!r}")
    return nearest_node(cells, nodes, metric, **names).withColumn("phi", F.col("distance") * F.col("distance")).drop("distance")


def _in_blocks(references: DataFrame, key: str) -> list[DataFrame]:
    """The references in parts of at most about half MAX_NODES rows, by hash of the key."""
    blocks = max(1, -(-references.count() * 2 // MAX_NODES))
    return [references.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == i) for i in range(blocks)] if blocks > 1 else [references]


def kernel_density(cells: DataFrame, references: DataFrame, sigma: float, metric: str = "L1", *, key: str = "vec_id", features: str = "features") -> DataFrame:
    """(key, density): the Gaussian kernel sum over the reference rows, without the row itself. Any number of references, block by block."""

    def rows(ids, d, node_ids, _):
        return ids, np.exp(-((d / sigma) ** 2) / 2).sum(axis=1) - np.isin(ids, node_ids)

    parts = [per_batch(cells, key, features, fetch_nodes(r, key, features), metric, rows, f"{key} long, density double") for r in _in_blocks(references, key)]
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("density").alias("density"))


def knn_distance(cells: DataFrame, references: DataFrame, k: int = 100, metric: str = "L1", *, key: str = "vec_id", features: str = "features") -> DataFrame:
    """(key, kth): the k-th smallest distance to the reference rows; the largest if there are fewer. Any number of references, block by block."""

    def rows(ids, d, node_ids, _):
        near = np.sort(np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k], axis=1)
        return ids, list(near)

    parts = [per_batch(cells, key, features, fetch_nodes(r, key, features), metric, rows, f"{key} long, near array<double>") for r in _in_blocks(references, key)]
    near = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))  # k a block
    return near.select(key, F.element_at("near", F.least(F.lit(k), F.size("near"))).alias("kth"))
