"""Queries of the information measures and feature selection, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudfork.operators import information as info
from cloudfork.operators import selection
from cloudfork.plans import reports
from cloudfork.plans.basics import grid_sql
from cloudfork.session import read_table as t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
X, Y, Z, WEIGHT = "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"


def _n(columns: str, w: str = "count(*)") -> str:
    """SQL of the counts and weights of the states of some columns."""
    return f"(SELECT {columns}{', ' if columns else ''}count(*)::DOUBLE AS c, {w}::DOUBLE AS w FROM lineitem{' GROUP BY ' + columns if columns else ''})"


def _t(columns: str, w: str = "count(*)") -> str:
    return f"(SELECT sum(w * log2(c)) FROM {_n(columns, w)})"


def _base(w: str = "count(*)") -> str:
    return f"(SELECT {w}::DOUBLE * log2(count(*)::DOUBLE) FROM lineitem)"


_N = "(SELECT count(*)::DOUBLE FROM lineitem)"


def _add(name: str, make, formula: str, column: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return make(t(spark, d, "lineitem")).select((F.round(column, 6) + 0.0).alias(column))

    run.__name__, run.__doc__ = name, f"{name.replace('_', ' ')} over the whole of lineitem"
    QUERIES[name] = run
    ORACLE[name] = f"SELECT round({formula}, 6) + 0.0 AS {column}"


for _prefix, _w, _sql in (("", None, "count(*)"), ("weighted_", WEIGHT, f"sum({WEIGHT})")):
    _b, _T = _base(_sql), lambda c, s=_sql: _t(c, s)
    _add(_prefix + "entropy", lambda df, w=_w: info.entropy(df, X, weight=w), f"({_b} - {_T(X)}) / {_N}", "h")
    _add(_prefix + "joint_entropy", lambda df, w=_w: info.entropy(df, X, Y, weight=w), f"({_b} - {_T(f'{X}, {Y}')}) / {_N}", "h")
    _add(_prefix + "cond_entropy", lambda df, w=_w: info.conditional_entropy(df, X, Y, weight=w), f"({_T(Y)} - {_T(f'{X}, {Y}')}) / {_N}", "h")
    _add(_prefix + "mutual_information", lambda df, w=_w: info.mutual_information(df, X, Y, weight=w), f"({_T(f'{X}, {Y}')} + {_b} - {_T(X)} - {_T(Y)}) / {_N}", "mi")
    _add(
        _prefix + "cond_mutual_information", lambda df, w=_w: info.conditional_mutual_information(df, X, Y, Z, weight=w),
        f"({_T(Z)} - {_T(f'{X}, {Z}')} - {_T(f'{Y}, {Z}')} + {_T(f'{X}, {Y}, {Z}')}) / {_N}", "cmi",
    )
_add("joint_variable_information", lambda df: info.mutual_information(df, [X, Z], [Y]), f"({_t(f'{X}, {Y}, {Z}')} + {_base()} - {_t(f'{X}, {Z}')} - {_t(Y)}) / {_N}", "mi")
_add(
    "nmi", lambda df: info.normalised_information(df, X, Y),
    f"greatest(0, ({_t(f'{X}, {Y}')} + {_base()} - {_t(X)} - {_t(Y)}) / sqrt(({_base()} - {_t(X)}) * ({_base()} - {_t(Y)})))", "nmi",
)
for _alpha, _tag in ((2.0, "2"), (0.5, "half")):
    _h = lambda c, a=_alpha: f"((SELECT log2(sum(pow(c / {_N}, {a}))) FROM {_n(c)}) / (1 - {a}))"
    _add(f"renyi_entropy_{_tag}", lambda df, a=_alpha: info.renyi_entropy(df, a, X), _h(X), "h")
    _add(f"renyi_joint_entropy_{_tag}", lambda df, a=_alpha: info.renyi_entropy(df, a, X, Y), _h(f"{X}, {Y}"), "h")
    _add(f"renyi_mi_joint_{_tag}", lambda df, a=_alpha: info.renyi_joint_information(df, a, X, Y), f"{_h(X)} + {_h(Y)} - {_h(f'{X}, {Y}')}", "mi")
    _add(
        f"renyi_mi_divergence_{_tag}", lambda df, a=_alpha: info.renyi_divergence_information(df, a, X, Y),
        f"(SELECT log2(sum(pow(j.c / {_N}, {_alpha}) * pow(a.c / {_N} * b.c / {_N}, {1 - _alpha}))) / ({_alpha} - 1) FROM {_n(f'{X}, {Y}')} j JOIN {_n(X)} a USING ({X}) JOIN {_n(Y)} b USING ({Y}))", "mi",
    )


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"SELECT {X}, round(c / {_N}, 9) AS p, round(w / c, 6) AS weight FROM {_n(X, f'sum({WEIGHT})')}")
def state_probabilities(spark, d):
    s = info.state_table(t(spark, d, "lineitem"), X, weight=WEIGHT)
    return s.select(X, F.round("p", 9).alias("p"), F.round("weight", 6).alias("weight"))


@query(f"""SELECT {X}, {Y}, round(j.c / {_N}, 9) AS p, round(a.c / {_N}, 9) AS px, round(b.c / {_N}, 9) AS py, round(j.w / j.c, 6) AS weight, round(a.w / a.c, 6) AS weight_x, round(b.w / b.c, 6) AS weight_y
FROM {_n(f'{X}, {Y}', f'sum({WEIGHT})')} j JOIN {_n(X, f'sum({WEIGHT})')} a USING ({X}) JOIN {_n(Y, f'sum({WEIGHT})')} b USING ({Y})""")
def joint_probabilities(spark, d):
    s = info.state_table(t(spark, d, "lineitem"), X, Y, WEIGHT)
    return s.select(X, Y, *[F.round(c, 9).alias(c) for c in ("p", "px", "py")], *[F.round(c, 6).alias(c) for c in ("weight", "weight_x", "weight_y")])


MARKERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def binned_markers(spark: SparkSession, d: str) -> DataFrame:
    """lineitem's numeric columns in ceil(n ** (1/3)) round equal-width bins."""
    return reports.binned(t(spark, d, "lineitem"), MARKERS, keep=["l_returnflag"])[0]


_CUBE_ROOT = "(SELECT count(*) FROM range(1, 10000) r(i) WHERE (i - 1) ** 3 < (SELECT count(*) FROM lineitem))"


def _bin_sql(m: str) -> str:
    return f"""b_{m} AS (SELECT x, len(list_filter(edges, lambda q: q <= x)) AS bin FROM (SELECT DISTINCT {m} AS x FROM lineitem), ({grid_sql('lineitem', m, _CUBE_ROOT)}))"""


_BINNED = ", ".join(_bin_sql(m) for m in MARKERS) + ", binned AS (SELECT l_returnflag, " + ", ".join(f"b{i}.bin AS m{i}" for i in range(4)) + " FROM lineitem " + " ".join(
    f"JOIN b_{m} b{i} ON b{i}.x = {m}" for i, m in enumerate(MARKERS)
) + ")"
_PAIRS = " UNION ALL ".join(
    f"""SELECT '{MARKERS[i]}' AS m1, '{MARKERS[j]}' AS m2, (SELECT sum(c * log2(c)) / sum(c) + log2(sum(c)) FROM (SELECT count(*)::DOUBLE AS c FROM binned GROUP BY m{i}, m{j}))
 - (SELECT sum(c * log2(c)) / sum(c) FROM (SELECT count(*)::DOUBLE AS c FROM binned GROUP BY m{i})) - (SELECT sum(c * log2(c)) / sum(c) FROM (SELECT count(*)::DOUBLE AS c FROM binned GROUP BY m{j})) AS mi"""
    for i in range(4) for j in range(4) if i < j
)


@query(f"WITH {_BINNED}, pairs AS ({_PAIRS}) SELECT m1, m2, round(mi, 6) + 0.0 AS mi FROM pairs")
def mi_matrix(spark, d):
    return info.pairwise_information(binned_markers(spark, d), MARKERS).withColumn("mi", F.round("mi", 6) + 0.0)


@query(f"""WITH {_BINNED}, pairs AS ({_PAIRS}), sided AS (SELECT m1 AS marker, mi FROM pairs UNION ALL SELECT m2, mi FROM pairs)
SELECT marker, marker IN ('l_quantity', 'l_extendedprice') AS used, round(greatest(0, max(mi)), 6) + 0.0 AS max_mi, round(sum(mi) / 4, 6) + 0.0 AS mean_mi FROM sided GROUP BY marker""")
def mi_summary(spark, d):
    s = info.information_summary(info.pairwise_information(binned_markers(spark, d), MARKERS), MARKERS, ["l_quantity", "l_extendedprice"])
    return s.select("marker", "used", (F.round("max_mi", 6) + 0.0).alias("max_mi"), (F.round("mean_mi", 6) + 0.0).alias("mean_mi"))


FEATURES = ["p_size", "p_brand", "p_type", "price_band"]


def _parts(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    return p.withColumn("price_band", F.floor(F.col("p_retailprice") / 100)).withColumn("cls", F.pmod(F.col("p_size"), F.lit(5)) + F.length("p_type"))


def _picked(spark: SparkSession, picks: list[str]) -> DataFrame:
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(picks)], "position int, feature string")


_TOP = """WITH p AS (SELECT CAST(p_size AS VARCHAR) AS p_size, p_brand, p_type, CAST(floor(p_retailprice / 100) AS VARCHAR) AS price_band, p_size % 5 + length(p_type) AS cls FROM part),
l AS (SELECT * FROM (UNPIVOT p ON p_size, p_brand, p_type, price_band INTO NAME feature VALUE v)), c AS (SELECT feature, v, cls, count(*)::DOUBLE AS c FROM l GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM part),
m AS (SELECT feature, sum(c * log2(c)) AS xy FROM c GROUP BY 1), x AS (SELECT feature, sum(c * log2(c)) AS x FROM (SELECT feature, v, sum(c) AS c FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT 1 AS position, arg_max(feature, xy - x) AS feature FROM m JOIN x USING (feature)"""


@query(_TOP)
def select_first(spark, d):
    """The feature of largest mutual information with the class: the first pick of every selector."""
    return _picked(spark, selection.select_mrmr(_parts(spark, d), 1, FEATURES, "cls"))


# The sum of c log2 c over the states of every subset of the four features (bits 1, 2, 4, 8) and the class (16).
_VARIABLES = {1: "p_size", 2: "p_brand", 4: "p_type", 8: "price_band", 16: "cls"}


def _subset_sql() -> str:
    parts = []
    for bits in range(1, 32):
        columns = ", ".join(v for b, v in _VARIABLES.items() if bits & b)
        parts.append(f"SELECT {bits} AS s, sum(c * log2(c)) / (SELECT count(*) FROM pt) AS t FROM (SELECT count(*)::DOUBLE AS c FROM pt GROUP BY {columns})")
    return f"""pt AS (SELECT p_size, p_brand, p_type, floor(p_retailprice / 100) AS price_band, p_size % 5 + length(p_type) AS cls FROM part),
tt AS (SELECT 0 AS s, log2(count(*)::DOUBLE) AS t FROM pt UNION ALL {' UNION ALL '.join(parts)}), term AS (SELECT map_from_entries(list((s, t))) AS m FROM tt),
f AS (SELECT * FROM (VALUES {', '.join(f"({b}, '{v}')" for b, v in _VARIABLES.items() if b < 16)}) v(b, name)),
rel AS (SELECT b, m[16 + b] + m[0] - m[16] - m[b] AS v FROM f, term),
two AS (SELECT f.b, g.b AS g, m[f.b + g.b] + m[0] - m[f.b] - m[g.b] AS red, m[g.b] - m[f.b + g.b] - m[16 + g.b] + m[16 + f.b + g.b] AS cond,
 (m[16 + f.b + g.b] + m[0] - m[f.b + g.b] - m[16]) / (m[0] - m[16 + f.b + g.b]) AS ratio FROM f, f g, term WHERE f.b <> g.b)"""


def _greedy_sql(score: str) -> str:
    """Three picks; ``score`` is an aggregate over the picks so far of two.red, two.cond, two.ratio and rel.v. Ties by feature order."""
    nth = lambda picks: f"SELECT two.b FROM two JOIN rel USING (b) WHERE g IN ({picks}) AND two.b NOT IN ({picks}) GROUP BY two.b, rel.v ORDER BY round({score}, 12) DESC, two.b LIMIT 1"
    return f"""WITH {_subset_sql()}, p1 AS (SELECT b FROM rel ORDER BY round(v, 12) DESC, b LIMIT 1), p2 AS ({nth('SELECT b FROM p1')}), p12 AS (SELECT b FROM p1 UNION ALL SELECT b FROM p2), p3 AS ({nth('SELECT b FROM p12')})
SELECT CAST(k AS INTEGER) AS position, name AS feature FROM (SELECT 1 AS k, b FROM p1 UNION ALL SELECT 2, b FROM p2 UNION ALL SELECT 3, b FROM p3) JOIN f USING (b)"""


@query(_greedy_sql("rel.v - avg(red)"))
def select_mrmr(spark, d):
    return _picked(spark, selection.select_mrmr(_parts(spark, d), 3, FEATURES, "cls"))


@query(_greedy_sql("least(rel.v, min(cond))"))
def select_cmim(spark, d):
    return _picked(spark, selection.select_cmim(_parts(spark, d), 3, FEATURES, "cls"))


@query(_greedy_sql("sum(ratio)"))
def select_disr(spark, d):
    return _picked(spark, selection.select_disr(_parts(spark, d), 3, FEATURES, "cls"))


# I(f; class | z) for every feature and set z without it; the blanket grows by the best, then loses the weakest.
@query(f"""WITH RECURSIVE {_subset_sql()}, z AS (SELECT unnest(range(0, 16)) AS z),
gain AS (SELECT b, z, m[z] - m[z + b] - m[z + 16] + m[z + 16 + b] AS v FROM f, z, term WHERE z & b = 0),
grow AS (SELECT 0::BIGINT AS z, []::INTEGER[] AS picks UNION ALL SELECT z + b, list_append(picks, b) FROM (SELECT w.z, picks, g.b, v, row_number() OVER (ORDER BY round(v, 12) DESC, g.b) AS r FROM grow w JOIN gain g ON g.z = w.z) WHERE r = 1 AND v >= 0.02),
shrink AS (SELECT z, picks FROM (SELECT * FROM grow ORDER BY len(picks) DESC LIMIT 1)
UNION ALL SELECT z - b, list_filter(picks, lambda x: x <> b) FROM (SELECT s.z, picks, g.b, v, row_number() OVER (ORDER BY v, list_position(picks, g.b)) AS r FROM shrink s JOIN gain g ON g.z = s.z - g.b AND s.z & g.b > 0) WHERE r = 1 AND v <= 0.02),
last AS (SELECT picks FROM shrink ORDER BY len(picks) LIMIT 1)
SELECT CAST(list_position(picks, b) AS INTEGER) AS position, name AS feature FROM last, f WHERE list_contains(picks, b)""")
def select_iamb(spark, d):
    return _picked(spark, selection.select_iamb(_parts(spark, d), FEATURES, "cls"))
