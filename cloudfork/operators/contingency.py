"""Group tables: cross-tabulation, shares, votes, histograms, distribution functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudfork.session import cut


def crosstab(df: DataFrame, row: str, column: str, values: list | None = None) -> DataFrame:
    """One row for each value of ``row``, one count column for each of ``column``, zeros filled in."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def full_counts(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, count) of every combination of the values seen, also those with no row."""
    counts = df.groupBy(row, column).count()
    every = counts.select(row).distinct().crossJoin(counts.select(column).distinct())  # of the two value lists
    return every.join(counts, [row, column], "left").na.fill(0, ["count"])


def shares(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, count, row_share, column_share). Null is a value like others."""
    counts = df.groupBy(row, column).count()
    out = counts
    for side, name in ((row, "row_share"), (column, "column_share")):
        total = counts.groupBy(F.col(side).alias("_side")).agg(F.sum("count").alias("_total"))
        out = out.join(total, F.col(side).eqNullSafe(F.col("_side"))).withColumn(name, F.col("count") / F.col("_total")).drop("_side", "_total")
    return out


def majority(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label, count): the most frequent label of each group, ties by the smaller label."""
    counts = df.groupBy(group, label).count()
    best = F.min(F.struct((-F.col("count")).alias("_less"), F.col(label).alias("_label")))
    return counts.groupBy(group).agg(best.alias("_b")).select(group, F.col("_b._label").alias(label), (-F.col("_b._less")).alias("count"))


def largest_share(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label, share): the label of which the group holds the largest part, ties by the smaller label."""
    part = shares(df, group, label)
    best = F.min(F.struct((-F.col("column_share")).alias("_less"), F.col(label).alias("_label")))
    return part.groupBy(group).agg(best.alias("_b")).select(group, F.col("_b._label").alias(label), (-F.col("_b._less")).alias("share"))


def given_order(df: DataFrame, group: str, order: list) -> DataFrame:
    """(group, rank): the groups in an order that the user gives, which must name each of them once."""
    names = [r[0] for r in df.select(group).distinct().limit(len(order) + 1).collect()]  # one more than the order at most
    if len(set(order)) != len(order) or set(order) != set(names):
        raise ValueError(f"the order is no permutation of the values of {group!r}: {sorted(map(str, set(order) ^ set(names)))[:9]}")
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order, start=1)], f"`{group}` {dict(df.dtypes)[group]}, rank int")


def mean_order(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, mean, rank): groups ranked by descending mean, ties by group."""
    means = df.groupBy(group).agg(F.avg(value).alias("mean"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), group)))  # over groups


def histogram(df: DataFrame, bin_of: Column, by: list[str]) -> DataFrame:
    """(by..., bin, count); rows outside the bins drop out."""
    return df.withColumn("bin", bin_of).filter("bin is not null").groupBy(*by, "bin").count()


def distribution(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., value, ecdf): the empirical distribution function at each distinct value.

    Equal values are counted first; the counts are sorted into ranges, summed within each range, and
    the sums of the ranges before are added, so no task holds a group or the whole. A null group is a group.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(group.alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    placed = cut(counts.repartitionByRange("g", "v").withColumn("range", F.spark_partition_id()))
    sums = placed.groupBy("g", "range").agg(F.sum("c").alias("c"))  # a row a range, and few more
    before = Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("g", "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"), F.sum("c").over(Window.partitionBy("g")).alias("n"))
    inside = F.sum("c").over(Window.partitionBy("g", "range").orderBy("v"))
    joined = placed.withColumn("upto", inside).join(starts, ["g", "range"])
    return joined.select(*[F.col("g")[c].alias(c) for c in by], F.col("v").alias(value), ((F.col("start") + F.col("upto")) / F.col("n")).alias("ecdf"))


def anova(df: DataFrame, markers: list[str], group: str) -> DataFrame:
    """(marker, f_stat, df_between, df_within, p, p_divided, p_bonferroni): one-way analysis of variance of each marker.

    From counts, sums and sums of squares about the marker's mean, in two aggregations. p_divided
    is p / number of markers; p_bonferroni its product, at most 1. One group or no spread: null.
    """
    long = df.select(F.col(group).alias("grp"), F.inline(F.array(*[F.struct(F.lit(m).alias("marker"), F.col(m).cast("double").alias("x")) for m in markers])))
    parts = long.filter("x is not null and grp is not null").groupBy("marker", "grp").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    sums = parts.groupBy("marker").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q")
    )
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    out = sums.withColumns({"df_between": F.col("k") - 1, "df_within": F.col("n") - F.col("k")}).withColumn(
        "f_stat", F.try_divide(F.try_divide(between, F.col("df_between")), F.try_divide(F.col("within"), F.col("df_within")))
    )
    p = _f_tail("f_stat", "df_between", "df_within")
    m = len(markers)
    return out.withColumn("p", p).select("marker", "f_stat", "df_between", "df_within", "p", (F.col("p") / m).alias("p_divided"), F.least(F.lit(1.0), F.col("p") * m).alias("p_bonferroni"))


def f_upper_tail(f: float | None, d1: float, d2: float) -> float | None:
    """P(F > f) by the continued fraction of the regularised incomplete beta function."""
    if f is None or d1 < 1 or d2 < 1 or f != f:
        return None
    x = d2 / (d2 + d1 * f)
    a, b = d2 / 2, d1 / 2

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 500):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + top / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def _f_tail(f: str, d1: str, d2: str) -> Column:
    def tail(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([f_upper_tail(None if x != x else x, y, z) for x, y, z in zip(a, b, c)], dtype="float64")

    return F.pandas_udf(tail, "double")(f, d1, d2)
