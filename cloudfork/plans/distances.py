"""Queries of the distance operators over embeddings and their label centroids, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudfork.operators import distance as dist
from cloudfork.operators import information as info
from cloudfork.session import read_table as t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
DIM = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def cells(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")


def centroids(df: DataFrame, label: str = "label", dim: int = DIM) -> DataFrame:
    """(node_id, features): the mean vector of each label."""
    return df.groupBy(F.col(label).alias("node_id")).agg(F.array(*[F.avg(F.col("features")[i]) for i in range(dim)]).alias("features"))


_NODES = """cells AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
nodes AS (SELECT node_id, list(m ORDER BY i) AS v FROM (SELECT label AS node_id, i, avg(e[i]) AS m FROM cells, range(1, 65) r(i) GROUP BY ALL) GROUP BY node_id)"""
_D = {
    "L1": "list_sum(list_transform(range(1, 65), lambda i: abs(e[i] - v[i])))",
    "L2": "sqrt(list_sum(list_transform(range(1, 65), lambda i: (e[i] - v[i]) ** 2)))",
    "cosine": "1 - list_cosine_similarity(e, v)",
    "angle": "acos(greatest(-1, least(1, list_cosine_similarity(e, v)))) / pi()",
}


def _distances(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = cells(spark, d)
        return dist.node_distances(c, centroids(c), metric).withColumn("distance", F.round("distance", 6))

    run.__name__ = f"node_distance_{metric.lower()}"
    query(f"WITH {_NODES} SELECT vec_id, CAST(node_id AS BIGINT) AS node_id, round({_D[metric]}, 6) AS distance FROM cells, nodes")(run)


for _m in _D:
    _distances(_m)

_STATS = ", st AS (SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM (SELECT i, avg(e[i]) AS m, sqrt(var_pop(e[i]) * count(*)) AS s FROM cells, range(1, 65) r(i) GROUP BY i)), nst AS (SELECT list(m ORDER BY i) AS nm, list(s ORDER BY i) AS ns FROM (SELECT i, avg(v[i]) AS m, sqrt(var_pop(v[i]) * count(*)) AS s FROM nodes, range(1, 65) r(i) GROUP BY i))"
_CORR = "list_sum(list_transform(range(1, 65), lambda i: (e[i] - m[i]) / s[i] * (v[i] - nm[i]) / ns[i]))"


def _correlation(spark: SparkSession, d: str, absolute: bool) -> DataFrame:
    c = cells(spark, d)
    nodes = centroids(c)
    metric = dist.correlation_metric(absolute, dist.column_centre(c, "features", DIM), dist.column_centre(nodes, "features", DIM))
    return dist.node_distances(c, nodes, metric).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_NODES}{_STATS} SELECT vec_id, CAST(node_id AS BIGINT) AS node_id, round(1 - {_CORR}, 6) AS distance FROM cells, nodes, st, nst")
def node_distance_corr(spark, d):
    return _correlation(spark, d, False)


@query(f"WITH {_NODES}{_STATS} SELECT vec_id, CAST(node_id AS BIGINT) AS node_id, round(1 - abs({_CORR}), 6) AS distance FROM cells, nodes, st, nst")
def node_distance_abs_corr(spark, d):
    return _correlation(spark, d, True)


_NEAREST = f"near AS (SELECT vec_id, label, min({{'d': round({_D['L1']}, 9), 'n': node_id}}) AS b FROM cells, nodes GROUP BY ALL)"


@query(f"WITH {_NODES}, {_NEAREST} SELECT vec_id, CAST(b.n AS BIGINT) AS node_id, round(b.d, 6) AS distance FROM near")
def nearest_centroid(spark, d):
    c = cells(spark, d)
    return dist.nearest_node(c, centroids(c)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_NODES} SELECT vec_id, round(min(({_D['L2']}) ** 2), 6) AS phi FROM cells, nodes GROUP BY vec_id")
def phi_squared_distance(spark, d):
    c = cells(spark, d)
    return dist.squared_to_nearest(c, centroids(c), "L2").select("vec_id", F.round("phi", 6).alias("phi"))


@query(f"""WITH {_NODES}, {_NEAREST}, j AS (SELECT b.n AS node_id, label, count(*)::DOUBLE AS c FROM near GROUP BY ALL), a AS (SELECT node_id, sum(c) AS c FROM j GROUP BY 1), b AS (SELECT label, sum(c) AS c FROM j GROUP BY 1),
h AS (SELECT (SELECT sum(c) FROM j) AS n, (SELECT sum(c * log2(c)) FROM j) AS tj, (SELECT sum(c * log2(c)) FROM a) AS ta, (SELECT sum(c * log2(c)) FROM b) AS tb)
SELECT CAST(j.node_id AS BIGINT) AS node_id, j.label, CAST(j.c AS BIGINT) AS n_cells, round(greatest(0, (tj + n * log2(n) - ta - tb) / sqrt((n * log2(n) - ta) * (n * log2(n) - tb))), 6) AS nmi FROM j, h""")
def nearest_centroid_nmi(spark, d):
    """Contingency of the nearest centroid and the label, with their normalised mutual information."""
    c = cells(spark, d)
    near = dist.nearest_node(c, centroids(c), keep=("label",))
    nmi = info.normalised_information(near, "node_id", "label")
    return near.groupBy("node_id", "label").agg(F.count("*").alias("n_cells")).crossJoin(nmi.withColumn("nmi", F.round("nmi", 6)))  # one row


SIGMA, REFERENCES = 5.0, 5000
_REF = f"refs AS (SELECT vec_id AS ref_id, e AS v FROM cells ORDER BY (vec_id * 1103515245::BIGINT + 73 * 12345) % 2147483648, vec_id LIMIT {REFERENCES})"


def _references(c: DataFrame) -> DataFrame:
    from cloudfork.operators.sampling import exact_sample, portable_uniform

    return exact_sample(c, "vec_id", REFERENCES, portable_uniform(F.col("vec_id")))


@query(f"WITH {_NODES}, {_REF} SELECT vec_id, round(sum(exp(-0.5 * pow(({_D['L1']}) / {SIGMA}, 2))) - max(CASE WHEN ref_id = vec_id THEN 1 ELSE 0 END), 6) + 0.0 AS density FROM cells, refs GROUP BY vec_id")
def kde_density(spark, d):
    """Gaussian kernel density against a sample of at most 5000 reference rows (the operator's own parameter)."""
    c = cells(spark, d)
    return dist.kernel_density(c, _references(c), SIGMA).withColumn("density", F.round("density", 6) + 0.0)


@query(f"WITH {_NODES}, {_REF} SELECT vec_id, round(kth, 6) AS kth FROM (SELECT vec_id, x AS kth, row_number() OVER (PARTITION BY vec_id ORDER BY x) AS r FROM (SELECT vec_id, {_D['L1']} AS x FROM cells, refs)) WHERE r = 100")
def knn_density(spark, d):
    """Distance to the 100th nearest of at most 5000 reference rows."""
    c = cells(spark, d)
    return dist.knn_distance(c, _references(c), 100).withColumn("kth", F.round("kth", 6))
