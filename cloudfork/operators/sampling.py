"""Filters and samples whose draws are a function of ids and a seed, so that they repeat on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudfork.functions.quantiles import quantile_value
from cloudfork.functions.scalar import magnitude


def uniform(*keys: Column, seed: int = 73) -> Column:
    """A number in [0, 1) for each combination of the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(2**53))


def portable_uniform(key: Column, seed: int = 73) -> Column:
    """As ``uniform``, by a linear congruence that any SQL engine can repeat; weaker."""
    return F.pmod(key.cast("long") * F.lit(1103515245).cast("long") + F.lit(seed * 12345).cast("long"), F.lit(2147483648).cast("long")) / F.lit(2147483648.0)


def remove_zero_ball(cells: DataFrame, features: str, metric: str = "L1", p: float = 0.01) -> DataFrame:
    """Rows whose magnitude exceeds its ``p`` quantile; all columns stay."""
    sized = cells.withColumn("_size", magnitude(F.col(features), metric))
    return sized.filter(F.col("_size") > F.lit(quantile_value(sized, "_size", p))).drop("_size")


def outliers(cells: DataFrame, density: str, p: float) -> DataFrame:
    """Rows of a density strictly below its ``p`` quantile; none for p = 0."""
    if p == 0:
        return cells.limit(0)
    return cells.filter(F.col(density) < F.lit(quantile_value(cells, density, p)))


def density_downsample(cells: DataFrame, density: str, outlier: float, threshold: float, draw: Column) -> DataFrame:
    """Rows that stay when dense regions are thinned to the ``threshold`` quantile of density.

    Outliers drop; a row stays with probability min(1, quantile / density), 1 at density 0.
    threshold 1 drops only the outliers. ``draw`` is the row's uniform number.
    """
    low = quantile_value(cells, density, outlier) if outlier else None
    kept = cells if low is None else cells.filter(F.col(density) >= F.lit(low))
    if threshold >= 1:
        return kept
    target = quantile_value(cells, density, threshold)
    return kept.filter(F.coalesce(draw <= F.try_divide(F.lit(target), F.col(density)), F.lit(True)))


def exact_sample(df: DataFrame, key: str, size: int, draw: Column) -> DataFrame:
    """``size`` rows of smallest draw, ties by key; all rows if there are no more. For sizes that a driver may hold."""
    return df.orderBy(draw, key).limit(size)


def one_per_node(cells: DataFrame, node: str, key: str, n_trees: int, seed: int = 73, draw: Column | None = None) -> DataFrame:
    """(tree_id, node, key): for every tree one random row of each node.

    Each row draws for every tree and the smallest draw wins; the minimum is partly
    aggregated before the shuffle, so a node with a third of all rows meets no single task.
    ``draw`` may be any number made of tree_id and the row's columns.
    """
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree_id")
    drawn = cells.select(F.col(node), F.col(key), trees).withColumn("draw", F.xxhash64(F.lit(seed), "tree_id", node, key) if draw is None else draw)
    best = drawn.groupBy("tree_id", node).agg(F.min(F.struct("draw", key)).alias("b"))
    return best.select("tree_id", node, F.col(f"b.{key}").alias(key))


def portable_tree_draw(key: Column, tree: Column, seed: int = 73) -> Column:
    """A draw for ``one_per_node`` by products of whole numbers, which any SQL engine can repeat."""
    start = F.pmod(key.cast("long") * F.lit(1103515245).cast("long") + F.lit(seed * 12345).cast("long"), F.lit(2147483648).cast("long"))
    return F.pmod((start + 1) * (tree.cast("long") * 7919 + 1), F.lit(2147483647).cast("long"))


def above_share(df: DataFrame, group: list[str], share: float = 0.01, least: int = 2) -> DataFrame:
    """(group..., count) of the groups with at least ``least`` rows and more than ``share`` of all rows."""
    counts = df.groupBy(*group).count()
    total = counts.agg(F.sum("count").alias("_all"))
    return counts.crossJoin(total).filter((F.col("count") >= least) & (F.col("count") > share * F.col("_all"))).drop("_all")  # one row
