"""Exact quantiles with plotting positions (k - 0.5) / n, per group, without sorting the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 100_000


def hazen_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """(by..., p, quantile): quantiles with plotting positions (k - 0.5) / n and linear interpolation.

    One pass bounds the wanted values: sketches, whose rank error is at most n / ``accuracy``, answer
    a little below and above each rank. The next counts what lies below the lower bound and each
    distinct value between the two, some 6 n / ``accuracy``, which alone are ranked; so outliers and
    ties don't matter. Null and NaN values are left out, a null group is a group, a single value is
    fine, an empty table gives no rows.
    """
    by = list(by or [])
    if not probs:
        raise ValueError("no probabilities")
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    clean = df.select(group.alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    slack = 3 / accuracy
    ends = F.percentile_approx("v", [e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack))], accuracy)
    bounds = clean.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), ends.alias("e"))
    position = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), F.col("n") * F.col("p") + 0.5))
    few = F.col("n") * slack < 4  # too few rows for the bounds to lie a rank apart: all are ranked
    lo = [F.when(few | F.lit(p <= slack), F.col("least")).otherwise(F.col("e")[2 * i]) for i, p in enumerate(probs)]
    hi = [F.when(few | F.lit(p >= 1 - slack), F.col("most")).otherwise(F.col("e")[2 * i + 1]) for i, p in enumerate(probs)]
    asked = F.array(*[F.struct(F.lit(float(p)).alias("p"), lo[i].alias("lo"), hi[i].alias("hi")) for i, p in enumerate(probs)])
    wanted = bounds.select("g", "n", F.inline(asked)).select("g", "p", "lo", "hi", F.floor(position).alias("k"), F.least(F.floor(position) + 1, F.col("n")).alias("k2"), (position - F.floor(position)).alias("part"))
    # null stands for everything below the lower bound
    counts = clean.join(wanted.select("g", "p", "lo", "hi"), "g").filter("v <= hi").groupBy("g", "p", F.expr("if(v >= lo, v, null)").alias("v")).count()
    ranked = counts.withColumn("upto", F.sum("count").over(Window.partitionBy("g", "p").orderBy(F.asc_nulls_first("v"))))
    hit = lambda k: (F.col(k) <= F.col("upto")) & (F.col(k) > F.col("upto") - F.col("count"))
    found = ranked.join(wanted, ["g", "p"]).groupBy("g", "p").agg(F.max(F.when(hit("k"), F.col("v"))).alias("low"), F.max(F.when(hit("k2"), F.col("v"))).alias("high"), F.max("part").alias("part"))
    return found.select(*[F.col("g")[c].alias(c) for c in by], "p", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("quantile"))


def quantile_value(df: DataFrame, value: str, p: float) -> float | None:
    """One quantile of a whole column; None for an empty one."""
    row = hazen_quantiles(df, value, [p]).first()
    return None if row is None else row["quantile"]
