"""Queries of trees, ensembles, branches and layouts over embeddings, with SQL where it can express them.

The nodes are the labels in three parts each; a tree takes one row of each node. The analysis queries run all stages
over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudfork.config import Options
from cloudfork.functions.scalar import arcsinh_each
from cloudfork.operators import contingency, graph, layout
from cloudfork.plans import branch, recursive
from cloudfork.plans.basics import DRAWN_SQL, tree_draws, tree_nodes
from cloudfork.plans.distances import _D, _NODES, DIM, cells, centroids
from cloudfork.session import cut
from cloudfork.session import read_table as t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TREES, NODES = 20, 30


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""WITH RECURSIVE {_NODES}, pairs AS (SELECT a.node_id AS a, b.node_id AS b, {_D['L1'].replace('e[i]', 'a.v[i]').replace('v[i]))', 'b.v[i]))').replace('a.b.v', 'a.v')} AS x FROM nodes a, nodes b WHERE a.node_id <> b.node_id),
prim AS (SELECT [(SELECT min(node_id) FROM nodes)] AS seen, NULL::INTEGER AS src, NULL::INTEGER AS dst, NULL::DOUBLE AS x
UNION ALL SELECT seen, src, dst, x FROM (SELECT list_append(seen, b) AS seen, least(a, b) AS src, greatest(a, b) AS dst, p.x AS x, row_number() OVER (ORDER BY p.x, least(a, b), greatest(a, b)) AS r FROM prim, pairs p WHERE list_contains(seen, a) AND NOT list_contains(seen, b)) WHERE r = 1)
SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, round(x, 6) AS dist FROM prim WHERE src IS NOT NULL""")
def label_mst(spark: SparkSession, d: str) -> DataFrame:
    """The minimum spanning tree of the label centroids."""
    nodes = centroids(cells(spark, d)).withColumn("tree_id", F.lit(0).cast("long"))
    return graph.tree_ensemble(nodes).select("src", "dst", F.round("dist", 6).alias("dist"))


def _ensemble(spark: SparkSession, d: str) -> DataFrame:
    c = tree_nodes(cells(spark, d))
    return cut(graph.tree_ensemble(tree_draws(c, TREES).join(c.select("vec_id", "features"), "vec_id")))


# The SQL of the ensemble, step by step. Draws, then Prim's algorithm in all trees at once.
_SQL_TREES = f"""pt AS (SELECT tree_id, node_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM {DRAWN_SQL} JOIN (SELECT vec_id, embedding FROM embeddings) USING (vec_id)),
gaps AS (SELECT a.tree_id, a.node_id AS a, b.node_id AS b, list_sum(list_transform(range(1, 65), lambda i: abs(a.e[i] - b.e[i]))) AS x FROM pt a JOIN pt b ON a.tree_id = b.tree_id AND a.node_id <> b.node_id),
prim AS (SELECT tree_id, [min(node_id)] AS seen, NULL::INTEGER AS src, NULL::INTEGER AS dst, NULL::DOUBLE AS x FROM pt GROUP BY tree_id
UNION ALL SELECT tree_id, seen, src, dst, x FROM (SELECT p.tree_id, list_append(seen, b) AS seen, least(a, b) AS src, greatest(a, b) AS dst, g.x AS x,
 row_number() OVER (PARTITION BY p.tree_id ORDER BY g.x, least(a, b), greatest(a, b)) AS r FROM prim p JOIN gaps g ON p.tree_id = g.tree_id AND list_contains(seen, a) AND NOT list_contains(seen, b)) WHERE r = 1),
trees AS (SELECT tree_id, src, dst, x AS dist FROM prim WHERE src IS NOT NULL)"""
# All paths within each tree; how often i and j stay together without c; the parts at every number of trees.
_SQL_PARTS = f"""{_SQL_TREES}, sides AS (SELECT tree_id, src AS a, dst AS b FROM trees UNION ALL SELECT tree_id, dst, src FROM trees),
walk AS (SELECT tree_id, node_id AS i, node_id AS j, [node_id] AS path FROM pt UNION ALL SELECT w.tree_id, i, b, list_append(path, b) FROM walk w JOIN sides s ON s.tree_id = w.tree_id AND s.a = j WHERE NOT list_contains(path, b)),
kept AS (SELECT c, i, j, count(*) FILTER (NOT list_contains(path, c)) AS k FROM walk, (SELECT DISTINCT node_id AS c FROM pt) WHERE i <> j AND i <> c AND j <> c GROUP BY ALL),
start AS (SELECT c, lv, i AS node FROM (SELECT DISTINCT c, i FROM kept), (SELECT unnest(range(1, 21)) AS lv)),
near AS (SELECT c, lv, i AS node, j AS other FROM kept, (SELECT unnest(range(1, 21)) AS lv) WHERE k >= lv UNION ALL SELECT c, lv, node, node FROM start),
lab AS (SELECT c, lv, node, node AS part, 0 AS step FROM start UNION ALL SELECT l.c, l.lv, n.other AS node, min(l.part) AS part, step + 1 FROM lab l JOIN near n ON n.c = l.c AND n.lv = l.lv AND n.node = l.node WHERE step < 28 GROUP BY l.c, l.lv, n.other, step),
parts AS (SELECT c, lv, node, part FROM lab WHERE step = 28),
sizes AS (SELECT c AS node_id, thr AS threshold, row_number() OVER (PARTITION BY c, thr ORDER BY size DESC) AS rank, size FROM (SELECT c, lv, part, count(*) AS size FROM parts GROUP BY ALL HAVING count(*) >= 2) JOIN (SELECT unnest(range(1, 100)) AS thr) ON lv = (thr * 20 + 99) // 100),
scores AS (SELECT node_id, coalesce(sum(size) FILTER (rank >= 3), 0) * 100 / 30 / 99 AS score FROM (SELECT DISTINCT node_id FROM pt) LEFT JOIN sizes USING (node_id) GROUP BY 1)"""
# The best node; the highest threshold at which its third part is largest; nodes by themselves join where they stay together most.
_SQL_BRANCHES = f"""{_SQL_PARTS}, top AS (SELECT node_id AS p FROM scores ORDER BY score DESC, node_id LIMIT 1),
spot AS (SELECT p, threshold FROM sizes, top WHERE node_id = p AND rank = 3 ORDER BY size DESC, threshold DESC LIMIT 1),
own AS (SELECT node, part, count(*) OVER (PARTITION BY part) AS n FROM parts, spot WHERE c = p AND lv = (threshold * 20 + 99) // 100),
joined AS (SELECT o.node, CASE WHEN n > 1 THEN o.part ELSE (SELECT q.part FROM kept k, spot, own q WHERE k.c = p AND k.i = o.node AND q.node = k.j AND q.n > 1 ORDER BY k.k DESC, k.j LIMIT 1) END AS part FROM own o),
ranks AS (SELECT part, row_number() OVER (ORDER BY count(*) DESC, part) AS branch FROM joined GROUP BY part),
branches AS (SELECT node AS node_id, branch FROM joined JOIN ranks USING (part) UNION ALL SELECT p, 0 FROM spot UNION ALL SELECT DISTINCT node_id, 1 FROM pt WHERE NOT EXISTS (SELECT * FROM spot))"""


@query(f"WITH RECURSIVE {_SQL_TREES} SELECT CAST(tree_id AS BIGINT) AS tree_id, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, round(dist, 6) AS dist FROM trees")
def tree_ensemble(spark, d):
    return _ensemble(spark, d).withColumn("dist", F.round("dist", 6))


_EDGES = "edges AS (SELECT DISTINCT l_orderkey % 500 AS tree_id, least(l_suppkey, s2) AS src, greatest(l_suppkey, s2) AS dst, l_quantity AS dist FROM (SELECT l_orderkey, l_suppkey, l_quantity, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS s2 FROM lineitem) WHERE s2 IS NOT NULL AND s2 <> l_suppkey)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Links between the suppliers of neighbouring lines of an order."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = t(spark, d, "lineitem").withColumn("s2", F.lead("l_suppkey").over(w)).filter("s2 is not null and s2 <> l_suppkey")
    return li.select((F.col("l_orderkey") % 500).alias("tree_id"), F.least("l_suppkey", "s2").alias("src"), F.greatest("l_suppkey", "s2").alias("dst"), F.col("l_quantity").alias("dist")).distinct()


@query(f"WITH {_EDGES} SELECT src, dst, count(*) AS freq, round(avg(dist), 6) AS mean_len, round(1 / count(*), 9) AS inv_freq FROM edges GROUP BY 1, 2")
def edge_ensemble(spark, d):
    return graph.ensemble_graph(_edges(spark, d)).select("src", "dst", "freq", F.round("mean_len", 6).alias("mean_len"), F.round("inv_freq", 9).alias("inv_freq"))


@query(f"""WITH {_EDGES}, g AS (SELECT src, dst, 1.0::DOUBLE / count(*) AS w FROM edges GROUP BY 1, 2), e AS (SELECT w, cume_dist() OVER (ORDER BY w) AS c FROM g)
SELECT src, dst FROM g WHERE w <= (SELECT min(w) FROM e WHERE c >= 0.9)""")
def edge_quantile_filter(spark, d):
    from cloudfork.operators.contingency import distribution

    g = graph.ensemble_graph(_edges(spark, d))
    level = distribution(g, "inv_freq", []).filter("ecdf >= 0.9").agg(F.min("inv_freq").alias("level"))
    return g.crossJoin(level).filter("inv_freq <= level").select("src", "dst")  # one row


# For each frequency that occurs, whether the edges at least as frequent connect all nodes; the connecting threshold; the six graphs.
_VARIANTS = f"""g AS (SELECT src, dst, avg(dist) AS mean_len, 1.0::DOUBLE / count(*) AS w FROM edges GROUP BY 1, 2), lv AS (SELECT DISTINCT w AS t FROM g),
nd AS (SELECT src AS node FROM g UNION SELECT dst FROM g),
nb AS (SELECT t, src AS a, dst AS b FROM g, lv WHERE w <= t UNION ALL SELECT t, dst, src FROM g, lv WHERE w <= t UNION ALL SELECT t, node, node FROM nd, lv),
lab AS (SELECT t, node, node AS part, 0 AS step FROM nd, lv UNION ALL SELECT l.t, n.b AS node, min(l.part) AS part, step + 1 FROM lab l JOIN nb n ON n.t = l.t AND n.a = l.node WHERE step < 24 GROUP BY l.t, n.b, step),
cutoff AS (SELECT min(t) AS t FROM (SELECT t FROM lab WHERE step = 24 GROUP BY t HAVING count(DISTINCT part) = 1)),
tenth AS (SELECT min(w) AS t FROM (SELECT w, cume_dist() OVER (ORDER BY w) AS c FROM g) WHERE c >= 0.9),
all6 AS (SELECT 1 AS graph_id, 'full_dist' AS name, src, dst, mean_len AS weight FROM g UNION ALL SELECT 2, 'full_freq', src, dst, w FROM g
UNION ALL SELECT 3, 'tenth_dist', src, dst, mean_len FROM g, tenth, cutoff WHERE w <= tenth.t AND tenth.t >= cutoff.t UNION ALL SELECT 4, 'tenth_freq', src, dst, w FROM g, tenth, cutoff WHERE w <= tenth.t AND tenth.t >= cutoff.t
UNION ALL SELECT 5, 'sparse_dist', src, dst, mean_len FROM g, cutoff WHERE w <= cutoff.t UNION ALL SELECT 6, 'sparse_freq', src, dst, w FROM g, cutoff WHERE w <= cutoff.t)"""


@query(f"WITH RECURSIVE {_EDGES}, {_VARIANTS} SELECT CAST(graph_id AS INTEGER) AS graph_id, name, src, dst, round(weight, 9) AS weight, round(CASE WHEN weight <> 0 THEN 1 / weight END, 9) AS inverse, 1 AS boolean FROM all6")
def graph_variants(spark, d):
    v = graph.graph_variants(graph.ensemble_graph(_edges(spark, d)))
    return v.withColumns({c: F.round(c, 9) for c in ("weight", "inverse")})


@query("""WITH RECURSIVE e AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS a, CAST(1000000 + o_orderkey // 4 AS BIGINT) AS b FROM orders), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e UNION ALL SELECT a, a FROM e UNION ALL SELECT b, b FROM e),
lab AS (SELECT node, node AS part, 0 AS step FROM (SELECT DISTINCT a AS node FROM s) UNION ALL SELECT s.b AS node, min(l.part) AS part, step + 1 FROM lab l JOIN (SELECT DISTINCT a, b FROM s) s ON s.a = l.node WHERE step < 40 GROUP BY s.b, step)
SELECT node, part AS component FROM lab WHERE step = 40""")
def components(spark, d):
    """Connected customers and order groups."""
    e = t(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.lit(1_000_000) + F.col("o_orderkey") / F.lit(4)).cast("long").alias("dst"))
    return graph.connected_components(e)


_TREE_SQL = "tree AS (SELECT n_nationkey AS a, 100 + n_regionkey AS b FROM nation UNION ALL SELECT 100 + n_regionkey, n_nationkey FROM nation UNION ALL SELECT 100 + r_regionkey, 999 FROM region UNION ALL SELECT 999, 100 + r_regionkey FROM region)"


@query(f"WITH RECURSIVE {_TREE_SQL}, h AS (SELECT 0 AS node_id, 0 AS hops UNION SELECT b, hops + 1 FROM h JOIN tree ON a = node_id WHERE hops < 6) SELECT CAST(node_id AS BIGINT) AS node_id, min(hops) AS hops FROM h GROUP BY node_id")
def tree_hops(spark, d):
    """Hops from nation 0 in the tree of nations, regions and the world."""
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    edges = n.select(F.lit(0).cast("long").alias("tree_id"), F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst")).union(
        r.select(F.lit(0).cast("long"), (F.col("r_regionkey") + 100).cast("long"), F.lit(999).cast("long"))
    )
    return graph.tree_hops(edges, 0).select("node_id", "hops")


@query(f"""WITH RECURSIVE {_EDGES}, g AS (SELECT src, dst, avg(dist) AS w FROM edges GROUP BY 1, 2), b AS (SELECT src AS a, dst AS b, w FROM g UNION ALL SELECT dst, src, w FROM g),
p AS (SELECT 1::BIGINT AS node, 0.0::DOUBLE AS dist, 0 AS step UNION ALL SELECT b AS node, min(p.dist + w) AS dist, step + 1 FROM p JOIN b ON a = node WHERE step < 7 GROUP BY b, step)
SELECT node, round(min(dist), 6) AS dist FROM p GROUP BY node""")
def shortest_paths(spark, d):
    """Weighted distance from supplier 1."""
    g = graph.ensemble_graph(_edges(spark, d)).select("src", "dst", F.col("mean_len").alias("weight"))
    return graph.shortest_paths(g, 1).select("node", F.round("dist", 6).alias("dist"))


@query(f"WITH RECURSIVE {_SQL_PARTS} SELECT CAST(node_id AS BIGINT) AS node_id, CAST(threshold AS INTEGER) AS threshold, CAST(rank AS INTEGER) AS rank, CAST(size AS INTEGER) AS size FROM sizes")
def branch_sizes(spark, d):
    return graph.branch_sizes(spark, _ensemble(spark, d))


@query(f"WITH RECURSIVE {_SQL_PARTS} SELECT CAST(node_id AS BIGINT) AS node_id, round(score, 9) AS score FROM scores")
def branching_scores(spark, d):
    sizes = graph.branch_sizes(spark, _ensemble(spark, d))
    nodes = tree_nodes(t(spark, d, "embeddings")).select("node_id").distinct()
    return graph.branching_scores(sizes, nodes, NODES).withColumn("score", F.round("score", 9))


def _branches(spark: SparkSession, trees: DataFrame) -> DataFrame:
    sizes = cut(graph.branch_sizes(spark, trees))
    return graph.best_branches(spark, trees, sizes, graph.branching_scores(sizes, sizes.select("node_id").distinct(), NODES))


@query(f"WITH RECURSIVE {_SQL_BRANCHES} SELECT CAST(node_id AS BIGINT) AS node_id, CAST(branch AS INTEGER) AS branch FROM branches")
def best_branches(spark, d):
    return _branches(spark, _ensemble(spark, d))


_MEANS = ", ".join(f"avg(embedding[{i + 1}]::DOUBLE) AS e{i}" for i in range(4))
_F = " UNION ALL ".join(
    f"""SELECT 'e{i}' AS marker, round((sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(v) / (sum(n) - count(*))), 6) AS f_stat, count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within
FROM (SELECT branch, count(*) AS n, avg(e{i}) AS m, var_pop(e{i}) * count(*) AS v FROM placed GROUP BY 1), (SELECT avg(e{i}) AS g FROM placed)"""
    for i in range(4)
)


@query(f"SELECT label * 3 + vec_id % 3 AS node_id, {_MEANS.replace('avg', 'round(avg').replace(') AS', '), 9) AS')} FROM embeddings WHERE label * 3 + vec_id % 3 <> 0 GROUP BY 1")
def node_means(spark, d):
    """Four positions of the mean of every node's rows."""
    means = branch.node_means(tree_nodes(cells(spark, d)), DIM)
    return means.select("node_id", *[F.round(F.col("features")[i], 9).alias(f"e{i}") for i in range(4)])


@query(f"""WITH RECURSIVE {_SQL_BRANCHES}, means AS (SELECT label * 3 + vec_id % 3 AS node_id, {_MEANS} FROM embeddings GROUP BY 1), placed AS (SELECT * FROM means JOIN branches USING (node_id) WHERE branch > 0) {_F}""")
def branch_significance(spark, d):
    """Analysis of variance of four positions of the node means over the branches, without the branch point."""
    nodes = centroids(tree_nodes(cells(spark, d)), "node_id")
    placed = nodes.join(best_branches(spark, d).filter("branch > 0"), "node_id").select("branch", *[F.col("features")[i].alias(f"e{i}") for i in range(4)])
    return contingency.anova(placed, [f"e{i}" for i in range(4)], "branch").select("marker", F.round("f_stat", 6).alias("f_stat"), "df_between", "df_within")


@query(f"""WITH RECURSIVE {_SQL_BRANCHES}, far AS (SELECT j AS node_id, avg(len(path) - 1) AS m FROM walk, spot WHERE i = p GROUP BY j)
SELECT CAST(node_id AS BIGINT) AS node_id, CAST(branch AS INTEGER) AS branch, round(CASE WHEN branch = 1 THEN -m ELSE m END / (SELECT max(m) FROM far), 9) + 0.0 AS signed_dist FROM far JOIN branches USING (node_id)""")
def mean_tree_distance(spark, d):
    """Signed distance of every node from the branch point of the ensemble; no rows if it has none."""
    trees = _ensemble(spark, d)
    branches = _branches(spark, trees)
    point = branches.filter("branch = 0").first()
    if point is None:
        return spark.createDataFrame([], "node_id long, branch int, signed_dist double")
    return graph.signed_distance(graph.tree_hops(trees, point["node_id"]), branches).withColumn("signed_dist", F.round("signed_dist", 9) + 0.0)


@query()
def layout_xy(spark, d):
    return layout.best_layout(spark, graph.ensemble_graph(_ensemble(spark, d)), tries=8)


@query()
def gp_profile(spark, d):
    """Smooth profiles of every position of the node vectors along the branches."""
    dist = mean_tree_distance(spark, d)
    nodes = centroids(tree_nodes(cells(spark, d)), "node_id")
    values = nodes.select("node_id", F.inline(F.array(*[F.struct(F.lit(f"e{i}").alias("marker"), F.col("features")[i].alias("value")) for i in range(DIM)])))
    return layout.branch_profiles(values.join(dist, "node_id"))


OPTIONS = Options(sigma=5.0, n_ref_cells=30, n_trees=40)


def _analysis_cells(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).select(F.col("vec_id").alias("cell_id"), F.col("label").cast("string").alias("label"), "features")


@query()
def pipeline_branch_scores(spark, d):
    """All stages: score and branch of every reference node."""
    run = branch.analyse(_analysis_cells(spark, d), OPTIONS)
    return run.scores.join(run.branches, "node_id")


@query()
def pipeline_label_table(spark, d):
    return branch.label_table(branch.analyse(_analysis_cells(spark, d), OPTIONS))


@query()
def recursive_labels(spark, d):
    """The recursive analysis of the complete cells of all_struct, and the stem of every top-level node.

    Null scores are those of the least grid point, 1001 points, which stands for all larger levels.
    """
    bad = F.exists("all_data", lambda x: x.isNull() | F.isnan(x))
    whole = t(spark, d, "all_struct").filter("cell_id is not null and size(all_data) = 12").filter(~bad).groupBy("cell_id").agg(F.min(F.struct("all_data", "all_labels")).alias("c"))
    c = whole.select("cell_id", F.lower(F.trim("c.all_labels")).alias("label"), arcsinh_each(F.col("c.all_data"), [5.0] * 12).alias("features"))
    options = OPTIONS.with_(sigma=1.0, n_trees=20)
    levels = recursive.analyse_recursively(c, options, recursive.null_tables(spark, options, [1001]), 12)
    top = spark.range(1, options.n_ref_cells + 1).withColumnRenamed("id", "node_id")
    return recursive.deepest_labels(levels, top)
