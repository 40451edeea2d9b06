"""Column builders: transforms, scalings, discretising, names."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arcsinh(x: Column, cofactor: float) -> Column:
    """Inverse hyperbolic sine of x / cofactor; cofactor 0 leaves x as it is. Null stays null."""
    return x if cofactor == 0 else F.asinh(x / F.lit(float(cofactor)))


def arcsinh_each(v: Column, cofactors: list[float]) -> Column:
    """``arcsinh`` of each position of an array with its own cofactor."""
    safe = F.array(*[F.lit(float(c)) for c in cofactors])
    return F.zip_with(v, safe, lambda x, c: F.when(c == 0, x).otherwise(F.asinh(x / F.when(c == 0, 1.0).otherwise(c))))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def l1_norm(v: Column) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + F.abs(x))


def squared_norm(v: Column) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x)


def magnitude(v: Column, metric: str = "L1") -> Column:
    """The size of a vector: the sum of absolutes for L1 and angle, the squared length for L2."""
    if metric not in ("L1", "L2", "angle"):
        raise ValueError(f"no magnitude for {metric!r}")
    return squared_norm(v) if metric == "L2" else l1_norm(v)


def unit_vector(v: Column) -> Column:
    """The vector divided by its length; null for a zero vector."""
    length = F.sqrt(squared_norm(v))
    return F.when(length > 0, F.transform(as_double(v), lambda x: x / length))


def minmax_scaled(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """``name`` = ``value`` scaled to [0, 1] within each group, by two numbers a group; null where all values are equal."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return (
        df.join(ends, by) if by else df.crossJoin(ends)  # without groups: one row
    ).withColumn(name, F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def floor_state(df: DataFrame, value: str, name: str = "state") -> DataFrame:
    """``name`` = the floor of ``value`` shifted so that the smallest is 0."""
    low = df.agg(F.min(F.floor(value)).alias("_low"))
    return df.crossJoin(low).withColumn(name, F.floor(value) - F.col("_low")).drop("_low")


def first_seen_labels(df: DataFrame, value: str, order: list[str], name: str = "label") -> DataFrame:
    """``name`` = 1 .. k in the order in which the values first appear, ties by value; equal values share it."""
    first = df.groupBy(value).agg(F.min(F.struct(*order)).alias("_first"))
    ranked = first.withColumn(name, F.row_number().over(Window.orderBy("_first", value))).drop("_first")  # a row for each state
    return df.join(ranked.withColumnRenamed(value, "_value"), F.col(value).eqNullSafe(F.col("_value"))).drop("_value")


def joint_states(df: DataFrame, values: list[str], order: list[str], name: str = "joint") -> DataFrame:
    """One label for each distinct combination of the values: of one column its 0-based floor
    state, of several 1 .. k in the order of first appearance."""
    if len(values) == 1:
        return floor_state(df, values[0], name)
    return first_seen_labels(df.withColumn("_all", F.struct(*values)), "_all", order, name).drop("_all")


def arity_state(values: list[tuple[Column, int]]) -> Column:
    """1 + the mixed-radix number of 0-based states with declared arities; -1 where a state exceeds its arity."""
    state, base, fits = F.lit(1), 1, F.lit(True)
    for x, arity in values:
        state, base, fits = state + x * base, base * arity, fits & (x < arity) & (x >= 0)
    return F.when(fits, state).otherwise(-1)


def cube_root_bins(n: int) -> int:
    """The smallest whole number whose cube is at least n."""
    k = max(0, round(n ** (1 / 3)) - 1)
    while k**3 < n:
        k += 1
    return k


ROUND_WIDTHS = (1, 2, 3, 5, 10)  # fixed values: times a power of ten, the widths taken where the number of bins is free


def _grains(count: int, power: int) -> float:
    """``count`` times ten to the ``power``, as the double nearest to that decimal number."""
    return float(count * 10**power) if power >= 0 else count / 10**-power


def _in_grains(x: float, power: int) -> float:
    return x / 10**power if power >= 0 else x * 10**-power


def round_edges(lo: float, hi: float, bins: int | None, width: float | None = None) -> list[float]:
    """Edges of equal bins that cover [lo, hi], all of them multiples of a power of ten.

    With ``bins``, exactly so many: on the coarsest decimal grid on which none of them lies
    beyond ``hi``, they begin at the last grid point up to ``lo`` and are as narrow as covers
    ``hi``. Without, the width is the one of ROUND_WIDTHS nearest to ``width``, and there are as
    many bins as are needed. If the ends are too close to tell bins apart, the bins share a unit
    interval (or what doubles of that size resolve) from the whole number up to ``lo``.
    """
    if hi - lo <= (bins or 1) ** 2 * math.ulp(max(abs(lo), abs(hi))):
        count, left = bins or 1, math.floor(lo)
        span = max(1, math.ceil(hi) - left, math.ceil(4 * count * math.ulp(float(hi))))
        return [left + i * span / count for i in range(count + 1)]
    power = math.ceil(math.log10(hi - lo if bins else width))
    if bins is None:
        step, power = min(((m, k) for k in (power - 1, power) for m in ROUND_WIDTHS), key=lambda c: abs(_grains(*c) - width))
        first = math.floor(_in_grains(lo, power) / step) * step
        count = max(1, math.ceil((_in_grains(hi, power) - first) / step))
    else:
        count, step = bins, 0
        while not step or _grains(first + (count - 1) * step, power) > hi:
            power -= bool(step)
            first = math.floor(_in_grains(lo, power))
            step = max(1, math.ceil((_in_grains(hi, power) - first) / count))
    edges = [_grains(first + i * step, power) for i in range(count + 1)]
    return [min(edges[0], lo), *edges[1:-1], max(edges[-1], hi)]


def bin_number(x: Column, edges: list[float]) -> Column:
    """1-based bin by edges: closed on the left, the last one on both sides; null outside and for NaN."""
    n = len(edges) - 1
    inside = (x >= edges[0]) & (x <= edges[-1]) & ~F.isnan(x)
    if n <= 64:
        hit = F.aggregate(F.array(*[F.lit(e) for e in edges[1:-1]]), F.lit(1), lambda s, e: s + F.when(x >= e, 1).otherwise(0)) if n > 1 else F.lit(1)
        return F.when(inside, hit)
    step = edges[1] - edges[0]
    guess = F.floor((x - edges[0]) / step).cast("int") + 1
    table = F.array(*[F.lit(e) for e in edges])
    fixed = guess + F.when(F.get(table, guess) <= x, 1).otherwise(0) - F.when(F.get(table, guess - 1) > x, 1).otherwise(0)
    return F.when(inside, F.least(F.greatest(fixed, F.lit(1)), F.lit(n)))


def plain_marker(name: Column) -> Column:
    """A marker name without its isotope prefix, with blanks for underscores."""
    return F.regexp_replace(F.regexp_replace(name, "^[0-9]+[A-Za-z]+_", ""), "_", " ")


def parent_stem(stem: Column) -> Column:
    """The stem without its last _number; empty for a top-level branch."""
    return F.regexp_replace(stem, "_[0-9]+$", "")


def stem_depth(stem: Column) -> Column:
    """The number of underscores of a stem."""
    return F.length(stem) - F.length(F.replace(stem, F.lit("_"), F.lit("")))
