"""Information theory on discrete columns, in bits.

Everything comes from one grouped count: the joint counts of all columns involved. The
counts of each subset of columns are grouping sets over that (much smaller) table, and
every measure is a sum of terms T(S) = sum over the states s of S of weight(s) log2 count(s),
so a hot state costs one row. Doubles are floored to states; null is a state of its own; an
empty table gives 0. Unknown columns raise. A list of columns is one joint variable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vars = str | list[str]


def _list(x: Vars | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def discrete(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """The columns as states (doubles floored), and more columns."""
    kinds = dict(df.dtypes)
    missing = [c for c in columns if c not in kinds]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*[F.floor(c).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns], *more)


def joint_counts(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """(columns..., _c, _w): rows and total weight of each joint state; without weight the two are equal."""
    total = F.sum("_w") if weight else F.count("*")
    rows = discrete(df, columns, *([F.col(weight).cast("double").alias("_w")] if weight else []))
    return rows.groupBy(*columns).agg(F.count("*").alias("_c"), total.cast("double").alias("_w"))


def _terms(df: DataFrame, sets: dict[str, list[str]], weight: str | None, power: float | None = None) -> DataFrame:
    """One row: n, sw, and for each named set its T (or, with ``power``, the sum of count ** power)."""
    columns = sorted({c for s in sets.values() for c in s})
    counts = joint_counts(df, columns, weight)
    term = F.pow("_c", F.lit(power)) if power is not None else F.col("_w") * F.log2("_c")
    out = counts.agg(F.sum("_c").alias("n"), F.sum("_w").alias("sw"))
    named = {}
    for name, s in sets.items():
        named.setdefault(tuple(sorted(set(s))), []).append(name)
    grouped = [(list(s), names) for s, names in named.items() if s]
    if grouped:
        tagged = counts.groupingSets([[F.col(c) for c in s] for s, _ in grouped], *columns).agg(
            F.sum("_c").alias("_c"), F.sum("_w").alias("_w"), F.grouping_id().alias("_gid")
        )
        ids = {}
        for s, names in grouped:  # a bit is 1 for each column that the set leaves out
            ids[sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)] = names
        sums = tagged.agg(*[F.sum(F.when(F.col("_gid") == gid, term)).alias(name) for gid, names in ids.items() for name in names])
        out = out.crossJoin(sums)  # one row each
    for name in named.get((), []):
        out = out.withColumn(name, F.pow("n", F.lit(power)) if power is not None else F.col("sw") * F.log2("n"))
    return out


def _measure(df: DataFrame, sets: dict[str, list[str]], value: Column, name: str, weight: str | None = None, power: float | None = None) -> DataFrame:
    return _terms(df, sets, weight, power).select(F.coalesce(value, F.lit(0.0)).alias(name))


def _per_row(x: Column) -> Column:
    return F.try_divide(x, F.col("n"))


def entropy(df: DataFrame, x: Vars, y: Vars | None = None, weight: str | None = None, name: str = "h") -> DataFrame:
    """H(X), or the joint H(X, Y). With weight: each state's term times its mean weight."""
    return _measure(df, {"x": _list(x) + _list(y)}, _per_row(F.col("sw") * F.log2("n") - F.col("x")), name, weight)


def conditional_entropy(df: DataFrame, x: Vars, given: Vars | None = None, weight: str | None = None, name: str = "h") -> DataFrame:
    """H(X | Y); without condition H(X)."""
    return _measure(df, {"xy": _list(x) + _list(given), "y": _list(given)}, _per_row(F.col("y") - F.col("xy")), name, weight)


def mutual_information(df: DataFrame, x: Vars, y: Vars, weight: str | None = None, name: str = "mi") -> DataFrame:
    """I(X; Y)."""
    value = F.col("xy") + F.col("sw") * F.log2("n") - F.col("x") - F.col("y")
    return _measure(df, {"x": _list(x), "y": _list(y), "xy": _list(x) + _list(y)}, _per_row(value), name, weight)


def conditional_mutual_information(df: DataFrame, x: Vars, y: Vars, given: Vars | None = None, weight: str | None = None, name: str = "cmi") -> DataFrame:
    """I(X; Y | Z) = H(X | Z) - H(X | Y, Z); without condition I(X; Y)."""
    a, b, z = _list(x), _list(y), _list(given)
    value = F.col("z") - F.col("xz") - F.col("yz") + F.col("xyz")
    return _measure(df, {"z": z, "xz": a + z, "yz": b + z, "xyz": a + b + z}, _per_row(value), name, weight)


def renyi_entropy(df: DataFrame, alpha: float, x: Vars, y: Vars | None = None, name: str = "h") -> DataFrame:
    """log2(sum p ** alpha) / (1 - alpha), of X or of (X, Y)."""
    _not_one(alpha)
    value = F.log2(F.try_divide(F.col("x"), F.pow("n", F.lit(alpha)))) / (1 - alpha)
    return _measure(df, {"x": _list(x) + _list(y)}, value, name, power=alpha)


def renyi_joint_information(df: DataFrame, alpha: float, x: Vars, y: Vars, name: str = "mi") -> DataFrame:
    """The Rényi entropies of X and Y minus that of (X, Y)."""
    _not_one(alpha)
    part = lambda c: F.log2(F.try_divide(F.col(c), F.pow("n", F.lit(alpha)))) / (1 - alpha)
    return _measure(df, {"x": _list(x), "y": _list(y), "xy": _list(x) + _list(y)}, part("x") + part("y") - part("xy"), name, power=alpha)


def renyi_divergence_information(df: DataFrame, alpha: float, x: Vars, y: Vars, name: str = "mi") -> DataFrame:
    """log2(sum p(xy) ** alpha (p(x) p(y)) ** (1 - alpha)) / (alpha - 1)."""
    _not_one(alpha)
    a, b = _list(x), _list(y)
    table = state_table(df, a, b)
    term = F.pow("p", F.lit(alpha)) * F.pow(F.col("px") * F.col("py"), F.lit(1 - alpha))
    return table.agg(F.coalesce(F.log2(F.sum(term)) / (alpha - 1), F.lit(0.0)).alias(name))


def _not_one(alpha: float) -> None:
    if alpha == 1:
        raise ValueError("alpha 1 is the Shannon measure")


def state_table(df: DataFrame, x: Vars, y: Vars | None = None, weight: str | None = None) -> DataFrame:
    """The probability of each state (columns, p), or of each joint state with its margins (columns, p, px, py).

    With weight also the mean weight of the state and of its margins: weight, weight_x, weight_y.
    """
    a, b = _list(x), _list(y)
    counts = joint_counts(df, a + b, weight)
    total = counts.agg(F.sum("_c").alias("_n"))
    sides = {"": a + b} | ({"x": a, "y": b} if b else {})
    out = counts.crossJoin(total)  # one row
    for tag, cols in sides.items():
        if tag:
            margin = counts.groupBy(F.struct(*cols).alias(f"_k{tag}")).agg(F.sum("_c").alias(f"_c{tag}"), F.sum("_w").alias(f"_w{tag}"))
            out = out.join(margin, F.struct(*cols) == F.col(f"_k{tag}"))
    pick = [(F.col("_c" if not tag else f"_c{tag}") / F.col("_n")).alias(f"p{tag}") for tag in sides]
    if weight:
        pick += [(F.col("_w" if not tag else f"_w{tag}") / F.col("_c" if not tag else f"_c{tag}")).alias("weight" + (f"_{tag}" if tag else "")) for tag in sides]
    return out.select(*a, *b, *pick)


def normalised_information(df: DataFrame, x: Vars, y: Vars, name: str = "nmi") -> DataFrame:
    """I(X; Y) / sqrt(H(X) H(Y)), at least 0; 0 where one of them is constant."""
    h = lambda c: F.col("sw") * F.log2("n") - F.col(c)
    mi = F.col("xy") + F.col("sw") * F.log2("n") - F.col("x") - F.col("y")
    value = F.greatest(F.lit(0.0), F.try_divide(mi, F.sqrt(F.greatest(h("x") * h("y"), F.lit(0.0)))))
    return _measure(df, {"x": _list(x), "y": _list(y), "xy": _list(x) + _list(y)}, value, name)


def measure(df: DataFrame, name: str, x: Vars, y: Vars | None = None, given: Vars | None = None, *, alpha: float | None = None, weight: str | None = None) -> DataFrame:
    """A measure by its name: h (of x, or of x and y), mi, cmi, nmi; cond_h is h of x given y.

    ``alpha`` asks for the Rényi form of h or mi, which at 1 is Shannon's; ``weight`` for the weighted form.
    Lists are joint variables. A name that doesn't exist, a missing variable, or one too many, is an error.
    """
    asked = {"h": (False, False), "cond_h": (True, False), "mi": (True, False), "nmi": (True, False), "cmi": (True, True)}
    if name not in asked:
        raise ValueError(f"no measure {name!r}; there are {sorted(asked)}")
    if (asked[name][0] and y is None) or asked[name][1] != (given is not None):
        raise ValueError(f"{name} needs other variables")
    if alpha is not None and alpha != 1:
        if name not in ("h", "mi") or weight:
            raise ValueError(f"no Rényi form of {name}" + " with weights" * bool(weight))
        return renyi_entropy(df, alpha, x, y) if name == "h" else renyi_divergence_information(df, alpha, x, y)
    if name == "nmi":
        if weight:
            raise ValueError("no weighted nmi")
        return normalised_information(df, x, y)
    if name == "cmi":
        return conditional_mutual_information(df, x, y, given, weight)
    return {"h": entropy, "cond_h": conditional_entropy, "mi": mutual_information}[name](df, x, y, weight)


def pairwise_information(binned: DataFrame, markers: list[str]) -> DataFrame:
    """(m1, m2, mi) for every pair of discrete columns, m1 before m2 in the list: one pass over the
    rows counts all pairs at once, partly aggregated before the shuffle."""
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")) for i, a in enumerate(markers) for j, b in enumerate(markers) if i < j]
    counts = binned.select(F.inline(F.array(*pairs))).groupBy("i", "j", "a", "b").count()
    log = lambda: F.sum(F.col("count") * F.log2("count"))
    both = counts.groupBy("i", "j").agg(F.sum("count").alias("n"), log().alias("ab"))
    left = counts.groupBy("i", "j", "a").agg(F.sum("count").alias("count")).groupBy("i", "j").agg(log().alias("ta"))
    right = counts.groupBy("i", "j", "b").agg(F.sum("count").alias("count")).groupBy("i", "j").agg(log().alias("tb"))
    names = F.array(*[F.lit(m) for m in markers])
    mi = (F.col("ab") + F.col("n") * F.log2("n") - F.col("ta") - F.col("tb")) / F.col("n")
    return both.join(left, ["i", "j"]).join(right, ["i", "j"]).select(F.get(names, F.col("i")).alias("m1"), F.get(names, F.col("j")).alias("m2"), mi.alias("mi"))


def information_summary(pairs: DataFrame, markers: list[str], used: list[str]) -> DataFrame:
    """(marker, used, max_mi, mean_mi), used markers first, then by descending max_mi. The mean counts the marker itself as 0."""
    both = pairs.select(F.col("m1").alias("marker"), "mi").unionByName(pairs.select(F.col("m2").alias("marker"), "mi"))
    out = both.groupBy("marker").agg(F.greatest(F.lit(0.0), F.max("mi")).alias("max_mi"), (F.sum("mi") / len(markers)).alias("mean_mi"))
    return out.withColumn("used", F.col("marker").isin(used)).select("marker", "used", "max_mi", "mean_mi").orderBy(F.desc("used"), F.desc("max_mi"), "marker")
