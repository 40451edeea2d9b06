"""Queries of the scalar, filter, join and group operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudfork.functions import quantiles, scalar
from cloudfork.operators import contingency, sampling
from cloudfork.session import read_table as t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


@query("SELECT event_id, round(ln(value / 5 + sqrt((value / 5) ** 2 + 1)), 6) + 0.0 AS y FROM events")
def asinh_transform(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", r6(scalar.arcsinh(F.col("value"), 5)).alias("y"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: asinh(x::DOUBLE / 0.5))), 6) + 0.0 AS total FROM embeddings""")
def asinh_each_position(spark, d):
    v = scalar.arcsinh_each(scalar.as_double(F.col("embedding")), [0.5] * 64)
    return t(spark, d, "embeddings").select("vec_id", r6(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, round((l_extendedprice - lo) / nullif(hi - lo, 0), 6) AS scaled FROM lineitem
JOIN (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1) USING (l_returnflag)""")
def minmax_scale(spark, d):
    df = scalar.minmax_scaled(t(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], "scaled")
    return df.select("l_orderkey", "l_linenumber", "l_returnflag", F.round("scaled", 6).alias("scaled"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * i[1])) , 6) + 0.0 AS dot FROM
(SELECT vec_id, embedding, [1 / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))] AS i FROM embeddings)""")
def row_l2_norm(spark, d):
    unit = scalar.unit_vector(F.col("embedding"))
    return t(spark, d, "embeddings").select("vec_id", r6(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x)).alias("dot"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS l1, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS l2 FROM embeddings""")
def row_magnitude(spark, d):
    e = F.col("embedding")
    return t(spark, d, "embeddings").select("vec_id", F.round(scalar.magnitude(e, "L1"), 6).alias("l1"), F.round(scalar.magnitude(e, "L2"), 6).alias("l2"))


@query("SELECT event_id, CAST(floor(value) - (SELECT min(floor(value)) FROM events) AS BIGINT) AS state FROM events")
def floor_normalise(spark, d):
    return scalar.floor_state(t(spark, d, "events"), "value").select("event_id", F.col("state").cast("long").alias("state"))


@query("SELECT CAST(max(floor(value) - (SELECT min(floor(value)) FROM events)) + 1 AS BIGINT) AS n_states FROM events")
def max_state(spark, d):
    return scalar.floor_state(t(spark, d, "events"), "value").agg((F.max("state") + 1).cast("long").alias("n_states"))


@query("""WITH f AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) AS label FROM events GROUP BY event_type) SELECT event_id, label FROM events JOIN f USING (event_type)""")
def first_seen_relabel(spark, d):
    return scalar.first_seen_labels(t(spark, d, "events"), "event_type", ["event_id"]).select("event_id", F.col("label").cast("long").alias("label"))


@query("""WITH f AS (SELECT l_returnflag, l_linestatus, row_number() OVER (ORDER BY min({'k': l_orderkey, 'l': l_linenumber}), l_returnflag, l_linestatus) AS joint FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, joint FROM lineitem JOIN f USING (l_returnflag, l_linestatus)""")
def joint_state(spark, d):
    df = scalar.joint_states(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber"])
    return df.select("l_orderkey", "l_linenumber", F.col("joint").cast("long").alias("joint"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 1 < 5 THEN 1 + CAST(l_quantity AS BIGINT) % 7 + (l_linenumber - 1) * 7 ELSE -1 END AS state FROM lineitem""")
def joint_state_arity(spark, d):
    state = scalar.arity_state([(F.col("l_quantity").cast("long") % 7, 7), (F.col("l_linenumber").cast("long") - 1, 5)])
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", state.alias("state"))


@query("""SELECT o_orderkey, o_orderpriority AS name, length(o_orderpriority) - length(replace(o_orderpriority, '-', '')) AS dashes, upper(o_orderstatus) AS status FROM orders""")
def string_functions(spark, d):
    p = F.col("o_orderpriority")
    return t(spark, d, "orders").select(
        "o_orderkey", scalar.plain_marker(F.concat(F.lit("170Er_"), p)).alias("name"), (F.length(p) - F.length(F.replace(p, F.lit("-"), F.lit("")))).cast("long").alias("dashes"), F.upper("o_orderstatus").alias("status")
    )


# bins and distributions


def _edges(spark, d, table: str, value: str, bins: int | None, width: float | None = None) -> list[float]:
    lo, hi = t(spark, d, table).agg(F.min(value), F.max(value)).first()
    return scalar.round_edges(lo, hi, bins, width)


@query("""SELECT event_type, CAST(floor(least(greatest(asinh(value / 5), 0), 8) / 0.5) + 1 AS BIGINT) AS bin, count(*) AS count FROM events WHERE asinh(value / 5) BETWEEN 0 AND 8 AND asinh(value / 5) < 8 GROUP BY ALL""")
def marginal_histogram(spark, d):
    y = scalar.arcsinh(F.col("value"), 5)
    return contingency.histogram(t(spark, d, "events"), scalar.bin_number(y, [i / 2 for i in range(17)]), ["event_type"]).select("event_type", F.col("bin").cast("long").alias("bin"), "count")


def grid_sql(table: str, value: str, bins: str) -> str:
    """A SELECT of the left edges (a list) of so many round equal bins: of every power of ten the fit, and of these the coarsest whose last bin begins up to the largest value."""
    at = "(first + {i} * step) * pow(10, greatest(p, 0)) / pow(10, greatest(-p, 0))"
    return f"""SELECT max_by(list_transform(range(0, CAST(bins AS BIGINT)), lambda i: {at.format(i='i')}), p) AS edges FROM (
SELECT *, greatest(1, ceil((hi / pow(10, greatest(p, 0)) * pow(10, greatest(-p, 0)) - first) / bins)) AS step FROM (
SELECT *, floor(lo / pow(10, greatest(p, 0)) * pow(10, greatest(-p, 0))) AS first FROM (
SELECT min({value})::DOUBLE AS lo, max({value})::DOUBLE AS hi, {bins} AS bins FROM {table}), (SELECT unnest(range(-9, 10)) AS p)
WHERE p <= ceil(log10(hi - lo)))) WHERE {at.format(i='(bins - 1)')} <= hi"""


@query(f"""WITH g AS ({grid_sql('events', 'value', '20')}) SELECT CAST(len(list_filter(edges, lambda q: q <= value)) AS BIGINT) AS bin, count(*) AS count FROM events, g WHERE value IS NOT NULL GROUP BY ALL""")
def equal_width_bins(spark, d):
    """20 bins at round numbers over all event values."""
    return contingency.histogram(t(spark, d, "events"), scalar.bin_number(F.col("value"), _edges(spark, d, "events", "value", 20)), []).select(F.col("bin").cast("long").alias("bin"), "count")


@query("SELECT event_type, value, round(max(c), 9) AS ecdf FROM (SELECT event_type, value, cume_dist() OVER (PARTITION BY event_type ORDER BY value) AS c FROM events WHERE value IS NOT NULL) GROUP BY ALL")
def ecdf_by_label(spark, d):
    return contingency.distribution(t(spark, d, "events"), "value", ["event_type"]).select("event_type", "value", F.round("ecdf", 9).alias("ecdf"))


_HAZEN = """WITH v AS (SELECT {g} AS g, {x} AS x, row_number() OVER (PARTITION BY {g} ORDER BY {x}) AS r, count(*) OVER (PARTITION BY {g}) AS n FROM {t} WHERE {x} IS NOT NULL),
w AS (SELECT g, n, p, greatest(1.0, least(n::DOUBLE, n * p + 0.5)) AS pos FROM (SELECT DISTINCT g, n FROM v), (SELECT unnest({p}::DOUBLE[]) AS p)),
q AS (SELECT w.g, p, min(a.x) + (pos - floor(pos)) * (min(b.x) - min(a.x)) AS quantile FROM w JOIN v a ON a.g = w.g AND a.r = floor(pos) JOIN v b ON b.g = w.g AND b.r = least(floor(pos) + 1, w.n) GROUP BY w.g, p, pos)"""


@query(_HAZEN.format(g="event_type", x="value", t="events", p="[0.01, 0.25, 0.5, 0.95]") + " SELECT g AS event_type, p, round(quantile, 9) AS quantile FROM q")
def hazen_quantiles(spark, d):
    return quantiles.hazen_quantiles(t(spark, d, "events"), "value", [0.01, 0.25, 0.5, 0.95], ["event_type"]).select("event_type", "p", F.round("quantile", 9).alias("quantile"))


_L1 = "list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE)))"


@query(_HAZEN.format(g="1", x="m", t=f"(SELECT {_L1} AS m FROM embeddings)", p="[0.01]") + f" SELECT vec_id FROM embeddings WHERE {_L1} > (SELECT quantile FROM q)")
def zero_ball(spark, d):
    return sampling.remove_zero_ball(t(spark, d, "embeddings"), "embedding").select("vec_id")


_QV = _HAZEN.format(g="1", x="value", t="events", p="[0.01, 0.5]")
_DRAW = "((event_id * 1103515245::BIGINT + 73 * 12345) % 2147483648) / 2147483648.0"


@query(_QV + " SELECT event_id FROM events WHERE value < (SELECT quantile FROM q WHERE p = 0.01)")
def outlier_filter(spark, d):
    return sampling.outliers(t(spark, d, "events"), "value", 0.01).select("event_id")


@query(_QV + f""" SELECT event_id FROM events WHERE value >= (SELECT quantile FROM q WHERE p = 0.01) AND (value = 0 OR {_DRAW} <= (SELECT quantile FROM q WHERE p = 0.5) / nullif(value, 0))""")
def density_downsample(spark, d):
    return sampling.density_downsample(t(spark, d, "events"), "value", 0.01, 0.5, sampling.portable_uniform(F.col("event_id"))).select("event_id")


@query(f"SELECT event_id FROM events ORDER BY {_DRAW}, event_id LIMIT 500")
def hash_sample(spark, d):
    """An exact sample of 500 rows without replacement (the limit is the operator)."""
    return sampling.exact_sample(t(spark, d, "events"), "event_id", 500, sampling.portable_uniform(F.col("event_id"))).select("event_id")


TREE_DRAW = "((vec_id * 1103515245::BIGINT + 73 * 12345) % 2147483648 + 1) * (tree_id * 7919 + 1) % 2147483647"
DRAWN_SQL = f"""(SELECT tree_id, node_id, vec_id FROM (SELECT tree_id, node_id, vec_id, row_number() OVER (PARTITION BY tree_id, node_id ORDER BY {TREE_DRAW}, vec_id) AS r
FROM (SELECT vec_id, label * 3 + vec_id % 3 AS node_id FROM embeddings), (SELECT unnest(range(0, 20)) AS tree_id)) WHERE r = 1)"""


def tree_nodes(df: DataFrame) -> DataFrame:
    """With node_id: each label in three parts."""
    return df.withColumn("node_id", F.col("label").cast("long") * 3 + F.col("vec_id") % 3)


def tree_draws(cells: DataFrame, n_trees: int) -> DataFrame:
    """(tree_id, node_id, vec_id): for each tree one random row of every node."""
    return sampling.one_per_node(cells, "node_id", "vec_id", n_trees, draw=sampling.portable_tree_draw(F.col("vec_id"), F.col("tree_id")))


@query(f"SELECT CAST(tree_id AS INTEGER) AS tree_id, node_id, vec_id FROM {DRAWN_SQL}")
def one_row_per_node(spark, d):
    """For each of 20 trees one random row of every node."""
    return tree_draws(tree_nodes(t(spark, d, "embeddings")), 20)


@query("SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND count(*) > 0.0001 * (SELECT count(*) FROM lineitem)")
def group_share_filter(spark, d):
    return sampling.above_share(t(spark, d, "lineitem"), ["l_suppkey"], 0.0001)


# joins


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_branch(spark, d):
    chosen = t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return t(spark, d, "orders").join(chosen, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')")
def anti_join_outliers(spark, d):
    """Customers without an urgent order in process."""
    urgent = t(spark, d, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    return t(spark, d, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_branch(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    return t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("""WITH s AS (SELECT DISTINCT 'branch_' || l_linenumber || '_' || CAST(l_quantity AS BIGINT) AS stem, 'branch_' || l_linenumber AS top FROM lineitem), a AS (SELECT stem FROM s UNION SELECT top FROM s)
SELECT c.stem, p.stem AS parent_stem, length(c.stem) - length(replace(c.stem, '_', '')) AS depth FROM a c LEFT JOIN a p ON regexp_replace(c.stem, '_[0-9]+$', '') = p.stem""")
def parent_stem_join(spark, d):
    from cloudfork.plans.recursive import branch_tree

    stems = t(spark, d, "lineitem").select(F.concat(F.lit("branch_"), "l_linenumber").alias("top"), F.concat(F.lit("branch_"), "l_linenumber", F.lit("_"), F.col("l_quantity").cast("long")).alias("stem"))
    every = stems.select(F.explode(F.array("top", "stem")).alias("stem")).distinct()
    return branch_tree(every).withColumn("depth", F.col("depth").cast("long"))


_GRID = "SELECT DISTINCT l_linenumber AS n_ref, CAST(l_quantity AS BIGINT) // 10 * 10 AS n_points, CAST(round(l_tax * 100) AS BIGINT) // 2 * 2 AS n_dims FROM lineitem"


@query(f"""WITH grid AS ({_GRID}), asks AS (SELECT DISTINCT p_size AS a, CAST(floor(p_retailprice) AS BIGINT) % 70 AS b, p_partkey % 12 AS c FROM part)
SELECT a, b, c, coalesce((SELECT max(n_ref) FROM grid WHERE n_ref <= a), (SELECT min(n_ref) FROM grid)) AS n_ref,
coalesce((SELECT max(n_points) FROM grid WHERE n_points <= b), (SELECT min(n_points) FROM grid)) AS n_points,
coalesce((SELECT max(n_dims) FROM grid WHERE n_dims <= c), (SELECT min(n_dims) FROM grid)) AS n_dims FROM asks""")
def floor_lookup_3key(spark, d):
    """For each request the greatest grid value not above it, key by key, else the smallest."""
    from cloudfork.plans.recursive import floor_keys

    li = t(spark, d, "lineitem")
    grid = li.select(F.col("l_linenumber").alias("n_ref"), F.floor(F.col("l_quantity").cast("long") / 10).cast("long").alias("x"), F.floor(F.round(F.col("l_tax") * 100).cast("long") / 2).cast("long").alias("y")).distinct()
    grid = grid.select("n_ref", (F.col("x") * 10).alias("n_points"), (F.col("y") * 2).alias("n_dims"))
    asks = t(spark, d, "part").select(F.col("p_size").alias("a"), F.pmod(F.floor("p_retailprice"), F.lit(70)).alias("b"), F.pmod("p_partkey", F.lit(12)).alias("c")).distinct()
    return floor_keys(asks, grid, {"a": "n_ref", "b": "n_points", "c": "n_dims"})


# group tables


@query("""SELECT r_name, count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS AUTOMOBILE, count(*) FILTER (c_mktsegment = 'BUILDING') AS BUILDING, count(*) FILTER (c_mktsegment = 'FURNITURE') AS FURNITURE,
count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS HOUSEHOLD, count(*) FILTER (c_mktsegment = 'MACHINERY') AS MACHINERY FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def crosstab_label_node(spark, d):
    df = lookup_branch(spark, d).join(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return contingency.crosstab(df, "r_name", "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@query("""WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS count FROM orders GROUP BY ALL)
SELECT a.o_orderpriority, b.o_orderstatus, coalesce(count, 0) AS count FROM (SELECT DISTINCT o_orderpriority FROM c) a CROSS JOIN (SELECT DISTINCT o_orderstatus FROM c) b LEFT JOIN c ON c.o_orderpriority = a.o_orderpriority AND c.o_orderstatus = b.o_orderstatus""")
def crosstab_full(spark, d):
    return contingency.full_counts(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 9) AS row_share, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 9) AS column_share FROM lineitem GROUP BY 1, 2""")
def row_col_normalised(spark, d):
    s = contingency.shares(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return s.select("l_returnflag", "l_linestatus", "count", F.round("row_share", 9).alias("row_share"), F.round("column_share", 9).alias("column_share"))


@query("""SELECT user_id, event_type, count FROM (SELECT user_id, event_type, count(*) AS count, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def majority_vote(spark, d):
    return contingency.majority(t(spark, d, "events"), "user_id", "event_type")


@query("""WITH s AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY event_type) AS share FROM events GROUP BY 1, 2)
SELECT user_id, event_type, round(share, 12) AS share FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY share DESC, event_type) AS r FROM s) WHERE r = 1""")
def largest_sample(spark, d):
    return contingency.largest_share(t(spark, d, "events"), "user_id", "event_type").withColumn("share", F.round("share", 12))


@query("SELECT event_type, round(avg(value), 6) AS mean, CAST(row_number() OVER (ORDER BY avg(value) DESC, event_type) AS INTEGER) AS rank FROM events GROUP BY 1")
def group_mean_order(spark, d):
    return contingency.mean_order(t(spark, d, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 4) AS total, min(p_size) AS smallest, max(p_size) AS largest, count(*) FILTER (p_retailprice > 1200) AS above FROM part GROUP BY 1")
def group_aggregates(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(
        F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 4).alias("total"), F.min("p_size").alias("smallest"), F.max("p_size").alias("largest"), F.count_if(F.col("p_retailprice") > 1200).alias("above")
    )


@query("SELECT o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS idx FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def distinct_index(spark, d):
    return t(spark, d, "orders").select("o_orderpriority").distinct().withColumn("idx", F.dense_rank().over(Window.orderBy("o_orderpriority")))


_ANOVA = " UNION ALL ".join(
    f"""SELECT '{m}' AS marker, round((sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(v) / (sum(n) - count(*))), 4) AS f_stat, count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within
FROM (SELECT l_returnflag, count(*) AS n, avg({m}) AS m, var_pop({m}) * count(*) AS v FROM lineitem GROUP BY 1), (SELECT avg({m}) AS g FROM lineitem)"""
    for m in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)


@query(_ANOVA)
def anova_f_stat(spark, d):
    a = contingency.anova(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag")
    return a.select("marker", F.round("f_stat", 4).alias("f_stat"), "df_between", "df_within")


@query(f"""SELECT marker, round(p, 9) + 0.0 AS p, round(p / 4, 9) + 0.0 AS p_divided, round(least(1.0, p * 4), 9) + 0.0 AS p_bonferroni FROM (
SELECT marker, pow(1 + 2 * f_stat / df_within, -df_within / 2.0) AS p FROM ({_ANOVA.replace(', 4) AS f_stat', ', 12) AS f_stat')}))""")
def anova_p_values(spark, d):
    """With three groups the tail of F has a closed form: (1 + 2 F / m) ** (-m / 2), m within the groups."""
    a = contingency.anova(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag")
    return a.select("marker", *[(F.round(c, 9) + 0.0).alias(c) for c in ("p", "p_divided", "p_bonferroni")])


# windows and sets


@query("SELECT c_nationkey, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS INTEGER) AS rank FROM customer GROUP BY 1")
def rank_by_size(spark, d):
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "c_nationkey")))


@query("""SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS step FROM events""")
def running_total_and_step(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").select(
        "user_id", "event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.round(F.col("value") - F.lag("value").over(w), 4).alias("step")
    )


@query("SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def arg_max(spark, d):
    best = F.min(F.struct((-F.col("c_acctbal")).alias("a"), "c_custkey")).alias("b")
    return t(spark, d, "customer").groupBy("c_nationkey").agg(best).select("c_nationkey", "b.c_custkey")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 3")
def top_three(spark, d):
    return t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(3)


@query("SELECT c_nationkey AS k, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT c_nationkey, 'customer only' FROM customer EXCEPT SELECT s_nationkey, 'customer only' FROM supplier) UNION ALL (SELECT c_nationkey, 'any' FROM customer UNION SELECT s_nationkey, 'any' FROM supplier)")
def set_operations(spark, d):
    c, s = t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"both": c.intersect(s), "customer only": c.subtract(s), "any": c.union(s).distinct()}
    out = None
    for kind, df in parts.items():
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return out


@query("SELECT NOT EXISTS ((SELECT n_nationkey FROM nation EXCEPT ALL SELECT DISTINCT c_nationkey FROM customer) UNION ALL (SELECT DISTINCT c_nationkey FROM customer EXCEPT ALL SELECT n_nationkey FROM nation)) AS equal")
def set_equality(spark, d):
    a, b = t(spark, d, "nation").select("n_nationkey"), t(spark, d, "customer").select("c_nationkey").distinct()
    return a.exceptAll(b).union(b.exceptAll(a)).agg((F.count("*") == 0).alias("equal"))
