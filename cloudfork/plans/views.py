"""Plot-ready tables, streams and sources as queries."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudfork.config import Options
from cloudfork.functions.scalar import minmax_scaled
from cloudfork.operators import contingency, graph, information, layout
from cloudfork.plans import graphs, recursive, reports
from cloudfork.plans.basics import tree_nodes
from cloudfork.plans.distances import cells, centroids
from cloudfork.plans.information import _BINNED
from cloudfork.plans.information import MARKERS as MI_MARKERS
from cloudfork.session import checkpoint_dir, cut
from cloudfork.session import read_table as t
from cloudfork.sources import fcs, tables
from cloudfork.sources.store import RunStore
from cloudfork.streaming import live

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT event_type, user_id, count(*) AS count FROM events GROUP BY ALL")
def stream_state_counts(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream, counted by type and user."""
    schema = t(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return live.run_to_table(live.state_counts(stream, ["event_type", "user_id"]))


@query()
def stream_node_assignment(spark, d):
    """embeddings as a stream, each row with its nearest label centroid."""
    fixed = cells(spark, d)
    stream = spark.readStream.schema(t(spark, d, "embeddings").schema).option("pathGlobFilter", "embeddings.parquet").parquet(d)
    live_cells = stream.select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    return live.run_to_table(live.assign_stream(live_cells, centroids(fixed)), "append")


@query("""SELECT l_orderkey, l_linenumber, marker, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME marker VALUE value)""")
def long_markers(spark, d):
    """Cells from a wide table by marker names, one row a cell and marker."""
    li = t(spark, d, "lineitem").withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    c = tables.cells_from_wide(li, "id", "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return tables.to_long(c, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("cell_id.*", "marker", "value")


@query()
def view_marker_values(spark, d):
    """Node marker values scaled to [0, 1] on the layout."""
    nodes = centroids(tree_nodes(cells(spark, d)), "node_id")
    long = nodes.select("node_id", F.posexplode("features").alias("marker", "value"))
    return minmax_scaled(long, "value", ["marker"], "scaled").join(graphs.layout_xy(spark, d), "node_id")


@query("""SELECT l_linestatus, column_share, l_returnflag FROM (SELECT l_linestatus, l_returnflag, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 9) AS column_share FROM lineitem GROUP BY 1, 2)""")
def view_contingency(spark, d):
    s = contingency.shares(t(spark, d, "lineitem"), "l_linestatus", "l_returnflag")
    return s.select("l_linestatus", "l_returnflag", F.round("column_share", 9).alias("column_share"))


@query(f"WITH RECURSIVE {graphs._SQL_PARTS} SELECT CAST(node_id AS BIGINT) AS node_id, round(score, 9) AS score, round(cume_dist() OVER (ORDER BY round(score, 9)), 9) AS ecdf FROM scores")
def view_score_distribution(spark, d):
    """Branching scores with their empirical distribution."""
    scores = graphs.branching_scores(spark, d)
    return scores.join(contingency.distribution(scores, "score", []), "score").withColumn("ecdf", F.round("ecdf", 9))


@query()
def view_contingency_nmi(spark, d):
    """Branch against label of the analysis, with the normalised mutual information."""
    run = graphs.branch.analyse(graphs._analysis_cells(spark, d), graphs.OPTIONS)
    rows = run.cells.join(run.branches, "node_id")
    return rows.groupBy("branch", "label").count().crossJoin(information.normalised_information(rows, "branch", "label"))  # one row


# files, sinks and stores

MARKERS = [f"m{i}" for i in range(1, 13)]
_COMPLETE = "(SELECT DISTINCT cell_id, file_id, all_data FROM all_struct WHERE cell_id IS NOT NULL AND file_id IS NOT NULL AND len(all_data) = 12 AND list_count(all_data) = 12 AND NOT list_bool_or(list_transform(all_data, lambda x: isnan(x))))"


@query(f"""SELECT cell_id, CAST(file_id AS VARCHAR) || '/' || CAST(cell_id // 20000 AS VARCHAR) AS label, round(asinh(all_data[1] / 5), 6) + 0.0 AS m1, round(asinh(all_data[2] / 2), 6) + 0.0 AS m2, round(asinh(all_data[3] / 5), 6) + 0.0 AS m3, round(all_data[12], 6) + 0.0 AS m12
FROM (SELECT cell_id, file_id, min(all_data) AS all_data FROM {_COMPLETE} GROUP BY 1, 2)""")
def fcs_cells(spark, d):
    """The complete cells of all_struct as FCS files (with a gain, and a spillover of two markers) and back, by marker names."""
    bad = F.exists("all_data", lambda x: x.isNull() | F.isnan(x))
    path = F.concat_ws("/", F.col("file_id").cast("string"), F.floor(F.col("cell_id") / 20000).cast("string"))
    rows = t(spark, d, "all_struct").filter("cell_id is not null and file_id is not null and size(all_data) = 12").filter(~bad).select(path.alias("path"), "cell_id", "file_id", "all_data")
    rows = rows.repartition("path").groupBy("path", "cell_id", "file_id").agg(F.min("all_data").alias("v"))  # moved once, also for the files
    stored = F.array(F.col("v")[0] * 2, F.col("v")[1], F.col("v")[2] + F.col("v")[1] * 0.25, *[F.col("v")[i] for i in range(3, 12)], F.col("cell_id").cast("double"))
    par = [{"par_name": f"CH{i}", "par_name2": m} for i, m in enumerate(MARKERS, start=1)] + [{"par_name": "cell"}]
    par[0]["par_gain"] = 2
    files = cut(fcs.pack_files(rows.withColumn("values", stored), F.col("path"), par, {"$SPILLOVER": "2,CH2,CH3,1,0.25,0,1"}), "zstd")
    options = Options(sigma=1.0, cofactors={"m2": 2.0, "m12": 0, "cell": 0})
    c = fcs.cells_from_files(spark, files, ["m1", "m2", "m3", "m12"], ["cell"], options, compensate=True)
    return c.select(F.round(F.col("extra")[0]).cast("long").alias("cell_id"), "label", *[(F.round(F.col("features")[i], 6) + 0.0).alias(m) for i, m in enumerate(("m1", "m2", "m3", "m12"))])


@query("SELECT file_id, CAST(num_of_par AS BIGINT) AS n_fields FROM (SELECT file_id, count(DISTINCT par_no) AS num_of_par FROM fcs_par WHERE par_name IS NOT NULL GROUP BY 1)")
def fcs_headers(spark, d):
    """The fields of every file of fcs_par written as a header and read again: how many it has."""
    fields = t(spark, d, "fcs_par").filter("par_name is not null and file_id is not null").groupBy("file_id", "par_no").agg(F.min(F.struct("par_name", "par_name2")).alias("p"))
    lists = fields.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("par_no", "p"))).alias("par"))  # a file's fields

    def write(batches):
        for b in batches:
            made = [fcs.file_bytes(np.zeros((0, len(par))), [p["p"] for p in par]) for par in b.column("par").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("file_id").cast(pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    headers = fcs.read_headers(spark, cut(lists.mapInArrow(write, "path string, content binary")))
    return headers.select(F.col("path").cast("long").alias("file_id"), F.size("par").cast("long").alias("n_fields"))


@query("SELECT p_brand, printf('%.4f', avg(p_retailprice)) AS mean_price, CAST(count(*) AS VARCHAR) AS n FROM part GROUP BY 1")
def text_sink(spark, d):
    """Group means as tab-separated text with four decimals, read back as text."""
    means = t(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean_price"), F.count("*").alias("n"))
    path = f"{checkpoint_dir(spark)}/text-{uuid.uuid4().hex}"
    tables.write_text(means, path)
    return spark.read.option("sep", "\t").option("header", True).csv(path)


@query(graphs.ORACLE["edge_ensemble"])
def stored_graph(spark, d):
    """The ensemble's graph through a run store: saved, listed in the manifest, loaded."""
    store = RunStore(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    store.save("graph", graphs.edge_ensemble(spark, d))
    return store.load("graph")


# reports

_BINS = ", ".join(f"SELECT l_returnflag, 'l_{m}' AS marker, m{i} AS bin FROM binned" for i, m in enumerate(("quantity", "extendedprice", "discount", "tax"))).replace(", SELECT", " UNION ALL SELECT")


@query(f"WITH {_BINNED} SELECT l_returnflag, marker, CAST(bin AS INTEGER) AS bin, count(*) AS count FROM ({_BINS}) GROUP BY ALL")
def pre_run_marginals(spark, d):
    """The marginals of the report before an analysis."""
    return reports.pre_run(t(spark, d, "lineitem"), MI_MARKERS, MI_MARKERS[:2], "l_returnflag")["marginals"]


@query(graphs.ORACLE["best_branches"] + " WHERE branch IN (SELECT branch FROM branches WHERE branch > 0 GROUP BY 1 HAVING count(*) > 1)")
def displayed_branches(spark, d):
    return reports.displayed_branches(graphs.best_branches(spark, d))


@query("""SELECT l_shipmode_order.rank AS rank, l_linestatus, count(*) AS count FROM (SELECT l_returnflag, l_linestatus FROM lineitem) l JOIN (VALUES ('R', 1), ('A', 2), ('N', 3)) l_shipmode_order(flag, rank) ON l_returnflag = flag GROUP BY ALL""".replace("l_shipmode_order", "o"))
def contingency_in_given_order(spark, d):
    """Flags in an order given by the user, checked to be a permutation of theirs."""
    li = t(spark, d, "lineitem")
    return li.join(contingency.given_order(li, "l_returnflag", ["R", "A", "N"]), "l_returnflag").groupBy("rank", "l_linestatus").count()


def _named_sql() -> str:
    from cloudfork.plans.information import ORACLE as sql

    asked = {"h": "entropy", "cond_h": "cond_entropy", "mi": "mutual_information", "cmi": "cond_mutual_information", "nmi": "nmi", "renyi_h": "renyi_entropy_2", "weighted_mi": "weighted_mutual_information"}
    return " UNION ALL ".join(f"SELECT '{name}' AS measure, value FROM ({sql[q]}) q(value)" for name, q in asked.items())


@query(_named_sql())
def named_measures(spark, d):
    """Information measures asked for by name."""
    li, (x, y, z) = t(spark, d, "lineitem"), ("l_returnflag", "l_linestatus", "l_linenumber")
    asked = {
        "h": information.measure(li, "h", x), "cond_h": information.measure(li, "cond_h", x, y), "mi": information.measure(li, "mi", x, y, alpha=1), "cmi": information.measure(li, "cmi", x, y, z),
        "nmi": information.measure(li, "nmi", x, y), "renyi_h": information.measure(li, "h", x, alpha=2.0), "weighted_mi": information.measure(li, "mi", x, y, weight="l_quantity"),
    }
    parts = [df.select(F.lit(name).alias("measure"), (F.round(df.columns[0], 6) + 0.0).alias("value")) for name, df in asked.items()]
    return reduce(DataFrame.unionByName, parts)


# the look-ups of the recursive analysis, over branches that lineitem spells out: two levels, the supplier as top-level node

_LEVELS_SQL = """base AS (SELECT l_orderkey * 10 + l_linenumber AS cell_id, l_suppkey AS top_node, l_quantity = 50 AS at_branch_point, 'branch_' || l_linenumber AS stem1, 'branch_' || l_linenumber || '_' || CAST(l_quantity AS BIGINT) % 3 AS stem2 FROM lineitem),
levels AS (SELECT cell_id, top_node, at_branch_point, stem1 AS stem, 'branch' AS parent_stem, 1 AS depth FROM base UNION ALL SELECT cell_id, top_node, at_branch_point, stem2, stem1, 2 FROM base WHERE top_node % 2 = 0)"""


def _levels(spark: SparkSession, d: str) -> DataFrame:
    stem = F.concat(F.lit("branch_"), "l_linenumber")
    base = t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell_id"), F.col("l_suppkey").alias("top_node"), (F.col("l_quantity") == 50).alias("at_branch_point"), stem.alias("stem1"), F.concat(stem, F.lit("_"), F.col("l_quantity").cast("long") % 3).alias("stem2"))
    own = ("cell_id", "top_node", "at_branch_point")
    one = base.select(*own, F.col("stem1").alias("stem"), F.lit("branch").alias("parent_stem"), F.lit(1).alias("depth"))
    return one.unionByName(base.filter("top_node % 2 = 0").select(*own, F.col("stem2").alias("stem"), F.col("stem1").alias("parent_stem"), F.lit(2).alias("depth")))


@query(f"""WITH {_LEVELS_SQL}, votes AS (SELECT depth, top_node, stem, count(*) AS n FROM levels WHERE NOT at_branch_point AND top_node <> 0 GROUP BY ALL), won AS (SELECT depth, top_node, stem FROM (SELECT *, row_number() OVER (PARTITION BY depth, top_node ORDER BY n DESC, stem) AS r FROM votes) WHERE r = 1)
SELECT s_suppkey AS node_id, coalesce(arg_max(stem, depth), 'branch') AS stem FROM supplier LEFT JOIN won ON top_node = s_suppkey GROUP BY 1""")
def deepest_labels(spark, d):
    """The deepest stem that the rows of a node vote for."""
    return recursive.deepest_labels(_levels(spark, d), t(spark, d, "supplier").withColumnRenamed("s_suppkey", "node_id"))


@query(f"""WITH {_LEVELS_SQL}, votes AS (SELECT parent_stem, top_node, count(DISTINCT cell_id) AS n FROM levels WHERE at_branch_point AND top_node <> 0 GROUP BY ALL)
SELECT parent_stem, top_node AS node_id FROM (SELECT *, row_number() OVER (PARTITION BY parent_stem ORDER BY n DESC, top_node) AS r FROM votes) WHERE r = 1""")
def branch_points(spark, d):
    """The node in which most of a split's branch-point rows lie."""
    return recursive.branch_points(_levels(spark, d))


@query("""WITH placed AS (SELECT s_suppkey AS node_id, s_nationkey AS stem, s_acctbal AS x, s_suppkey::DOUBLE AS y FROM supplier), centre AS (SELECT stem, avg(x) AS cx, avg(y) AS cy FROM placed GROUP BY 1)
SELECT stem, node_id FROM (SELECT p.stem, node_id, row_number() OVER (PARTITION BY p.stem ORDER BY (x - cx) ** 2 + (y - cy) ** 2, node_id) AS r FROM placed p JOIN centre c ON p.stem = c.stem) WHERE r = 1""")
def central_nodes(spark, d):
    """The node nearest to the centre of each group on a layout."""
    s = t(spark, d, "supplier")
    return recursive.central_node(s.select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").alias("stem")), s.select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y")))


@query("""WITH s AS (SELECT l_linenumber AS r, CAST(l_quantity AS BIGINT) // 10 * 1000 AS n, l_discount AS x FROM lineitem), asks AS (SELECT * FROM (VALUES (3, 2500), (9, 900), (9, 40001), (1, 1001)) a(r, n)),
grid AS (SELECT a.r, a.n, (SELECT max(s.r) FROM s WHERE s.r <= a.r) AS gr, coalesce((SELECT max(s.n) FROM s WHERE s.n <= a.n), (SELECT min(s.n) FROM s)) AS gn FROM asks a),
v AS (SELECT g.r, g.n, x, row_number() OVER (PARTITION BY g.r, g.n ORDER BY x) AS k, count(*) OVER (PARTITION BY g.r, g.n) AS c FROM grid g JOIN s ON s.r = gr AND s.n = gn),
w AS (SELECT DISTINCT r, n, c, greatest(1.0, least(c::DOUBLE, c * 0.95 + 0.5)) AS pos FROM v)
SELECT CAST(a.r AS BIGINT) AS n_ref, CAST(a.n AS BIGINT) AS n_points, CASE WHEN a.n > 1000 THEN round((SELECT min(lo.x) + (pos - floor(pos)) * (min(hi.x) - min(lo.x)) FROM v lo, v hi WHERE lo.r = a.r AND lo.n = a.n AND hi.r = a.r AND hi.n = a.n AND lo.k = floor(pos) AND hi.k = least(floor(pos) + 1, lo.c)), 9) END AS score_limit FROM asks a LEFT JOIN w ON w.r = a.r AND w.n = a.n""")
def null_score_limits(spark, d):
    """The limit that a score must exceed, from a table of null scores; null (infinite) up to 1000 points."""
    li = t(spark, d, "lineitem")
    nulls = li.select(F.col("l_linenumber").cast("long").alias("n_ref_cells"), (F.floor(F.col("l_quantity").cast("long") / 10) * 1000).alias("n_points"), F.lit(2).cast("long").alias("n_dims"), F.col("l_discount").alias("score"))
    limits = [(r, n, recursive.score_limit(nulls, r, n, 2, 0.95)) for r, n in ((3, 2500), (9, 900), (9, 40001), (1, 1001))]
    return spark.createDataFrame([(r, n, None if x == float("inf") else round(x, 9)) for r, n, x in limits], "n_ref long, n_points long, score_limit double")


def _run(spark: SparkSession, d: str):
    run = graphs.branch.analyse(graphs._analysis_cells(spark, d), graphs.OPTIONS)
    return run, layout.chosen_layout(spark, run.graph, graphs.OPTIONS, tries=4).drop("graph_id")


@query()
def six_layouts(spark, d):
    """A layout of each of the six graphs of the ensemble."""
    return layout.chosen_layout(spark, graph.ensemble_graph(graphs._ensemble(spark, d)), Options(sigma=1.0, layout_graph=None), tries=4)


@query()
def view_samples_on_layout(spark, d):
    return reports.samples_on_layout(*_run(spark, d))


@query()
def view_densities(spark, d):
    """The mean density of each node on the layout."""
    return reports.density_views(*_run(spark, d))["nodes"]
