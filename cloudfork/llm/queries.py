"""The queries of this subpackage, each over the whole of its tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudfork.llm import clusters, diverse, mixing, neighbors, percentiles, reading, tokens
from cloudfork.session import read_table as t


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Mutual neighbours among the 10 nearest, at most 0.06 apart; exact."""
    return neighbors.mutual_pairs(neighbors.nearest_vectors(t(spark, d, "all_struct"), 10, max_distance=0.06))


def p1_knn(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of every cell whose id is divisible by 20, against all cells."""
    cells = t(spark, d, "all_struct")
    return neighbors.nearest_vectors(cells, 10, queries=cells.filter(F.col("cell_id") % 20 == 0), factor=neighbors.FACTOR)


def p2_subset(spark: SparkSession, d: str) -> DataFrame:
    """One percent of the complete cells, chosen for variety."""
    return diverse.varied_subset(t(spark, d, "all_struct"), fraction=0.01)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of the transitively linked clusters (links of at most 0.25) of at least 6 cells."""
    members = clusters.similarity_clusters(t(spark, d, "all_struct"), 0.25)
    large = members.groupBy("cluster_id").count().filter("count >= 6").select("cluster_id")
    return members.join(large, "cluster_id", "left_semi").select("cluster_id", "cell_id")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Average-linkage clusters in which members without a link count as 0.5 apart: size, spread and typical members."""
    cells = t(spark, d, "all_struct")
    return clusters.cluster_profiles(clusters.similarity_clusters(cells, 0.25, missing=0.5), cells)


def _day_sketches(spark: SparkSession, d: str) -> DataFrame:
    cells = t(spark, d, "all_struct").filter("cell_id is not null and size(all_data) = 12 and all_labels is not null")
    once = cells.select("cell_id", F.lower(F.trim("all_labels")).alias("all_labels"), "acq_day", "all_data").dropDuplicates(["cell_id"])
    return percentiles.quantile_sketches(once, "all_data", ["all_labels", "acq_day"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Label, day and position whose median or 95th percentile is off the reference by more than the tolerance."""
    answers = percentiles.sketch_quantiles(_day_sketches(spark, d).filter("n >= 40"), [50, 95])
    reference = t(spark, d, "marker_reference").withColumn("all_labels", F.lower(F.trim("all_labels")))
    return (
        answers.withColumnRenamed("position", "marker_no")
        .join(reference, ["all_labels", "marker_no", "q_pct"])
        .filter(F.abs(F.col("value") - F.col("ref_value")) > F.col("tolerance"))
        .select("all_labels", F.date_format("acq_day", "yyyy-MM-dd").alias("acq_day"), "marker_no", "q_pct")
    )


def p4_label_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The days' sketches combined to labels: 1, 5, 25, 50, 75, 95 and 99 % of every position."""
    labels = percentiles.merge_sketches(_day_sketches(spark, d), ["all_labels"])
    return percentiles.sketch_quantiles(labels, [1, 5, 25, 50, 75, 95, 99]).withColumnRenamed("position", "marker_no")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(t(spark, d, "documents"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Of each document the number of ids, and whether decoding them gives its text (empty for null)."""
    documents = t(spark, d, "documents").filter("doc_id is not null")
    encoded = tokens.encode_corpus(documents, keep=("text",))
    decoded = tokens.decode_corpus(encoded.select("doc_id", "ids")).withColumnRenamed("text", "decoded")
    counts = encoded.select("doc_id", F.size("ids").alias("n_ids"), F.coalesce("text", F.lit("")).alias("text"))
    return counts.join(decoded, "doc_id").select("doc_id", "n_ids", (F.col("text") == F.col("decoded")).alias("exact"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(t(spark, d, "documents"), t(spark, d, "mix_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(t(spark, d, "documents"), t(spark, d, "mix_targets"))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(t(spark, d, "documents"))


def p8_bands(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by reading band: documents, words and mean level; null where there is too little prose."""
    bands = reading.reading_bands(t(spark, d, "documents"), t(spark, d, "reading_labels"))
    return bands.groupBy("band").agg(F.count("*").alias("n_docs"), F.sum("words").alias("words"), F.avg("level").alias("mean_level"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the most demanding band, with at least 40 words of prose."""
    bands = reading.reading_bands(t(spark, d, "documents"), t(spark, d, "reading_labels"))
    return bands.filter("band = 5").select("doc_id")


_ALL = (
    p1_found, p1_knn, p2_subset, p3_found, p3_clusters, p4_found, p4_label_percentiles,
    p6_ids, p6_roundtrip, p7_mix, p7_report, p8_found, p8_levels, p8_bands,
)
QUERIES = {f.__name__: f for f in _ALL}


def _near_sql(reach: float) -> str:
    """CTEs: whole (id, v), the complete cells, and near (a, b, d), the pairs within reach, by cells of a grid over three positions."""
    grid = ", ".join(f"CAST(floor(v[{i}] / {reach}) AS BIGINT) AS g{i}" for i in (1, 2, 3))
    good = "cell_id IS NOT NULL AND len(all_data) = 12 AND list_count(all_data) = 12 AND NOT list_bool_or(list_transform(all_data, lambda x: isnan(x) OR isinf(x)))"
    return f"""whole AS (SELECT id, v, {grid} FROM (SELECT cell_id AS id, min(all_data) AS v FROM all_struct WHERE {good} GROUP BY 1)),
steps AS (SELECT unnest([-1, 0, 1]) AS s), spread AS (SELECT id, v, g1 + a.s AS g1, g2 + b.s AS g2, g3 + c.s AS g3 FROM whole, steps a, steps b, steps c),
near AS (SELECT x.id AS a, y.id AS b, list_distance(x.v, y.v) AS d FROM whole x JOIN spread y USING (g1, g2, g3) WHERE x.id <> y.id AND list_distance(x.v, y.v) <= {reach})"""


_P4_SQL = """WITH once AS (SELECT cell_id, lower(trim(all_labels)) AS all_labels, acq_day, all_data FROM all_struct WHERE cell_id IS NOT NULL AND len(all_data) = 12 AND all_labels IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at) = 1),
vals AS (SELECT all_labels, acq_day, i AS marker_no, all_data[i] AS x FROM once, range(1, 13) r(i)), good AS (SELECT * FROM vals WHERE x IS NOT NULL AND NOT isnan(x)),
q AS (SELECT all_labels, acq_day, marker_no, quantile_disc(x, [0.5, 0.95]) AS v FROM good GROUP BY ALL HAVING count(*) >= 40),
a AS (SELECT all_labels, acq_day, marker_no, unnest([50, 95]) AS q_pct, unnest(v) AS x FROM q)
SELECT a.all_labels, strftime(acq_day, '%Y-%m-%d') AS acq_day, CAST(a.marker_no AS INTEGER) AS marker_no, a.q_pct FROM a JOIN marker_reference r ON lower(trim(r.all_labels)) = a.all_labels AND r.marker_no = a.marker_no AND r.q_pct = a.q_pct WHERE abs(x - ref_value) > tolerance"""
#: Those that SQL can express exactly; the sketches of p4_found are held to exact percentiles, as the data leave room for their error.
ORACLE: dict[str, str] = {
    "p1_found": f"""WITH {_near_sql(0.06)}, ranked AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM near), top AS (SELECT a, b FROM ranked WHERE r <= 10)
SELECT x.a AS cell_a, x.b AS cell_b FROM top x JOIN top y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
    "p3_found": f"""WITH RECURSIVE {_near_sql(0.25)}, sides AS (SELECT a, b FROM near UNION ALL SELECT DISTINCT a, a FROM near),
lab AS (SELECT DISTINCT a AS node, a AS part, 0 AS step FROM near UNION ALL SELECT s.b AS node, min(l.part) AS part, step + 1 FROM lab l JOIN sides s ON s.a = l.node WHERE step < 40 GROUP BY s.b, step),
sized AS (SELECT node, part, count(*) OVER (PARTITION BY part) AS n FROM lab WHERE step = 40) SELECT part AS cluster_id, node AS cell_id FROM sized WHERE n >= 6""",
    "p4_found": _P4_SQL,
}
