"""Queries of the drifting schemas (problem 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudfork.session import read_table as t
from cloudfork.sources import drift


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(t(spark, d, "fcs_par"), t(spark, d, "fcshdr"), t(spark, d, "input_struct"), t(spark, d, "marker_catalog"))


def p5_schema(spark: SparkSession, d: str) -> DataFrame:
    return drift.fused_schema(t(spark, d, "raw_cells"), t(spark, d, "fcs_par"))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    return drift.tagged_values(t(spark, d, "raw_cells")).drop("name")


def p5_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return drift.appearing_alternatives(t(spark, d, "raw_cells"), t(spark, d, "fcshdr"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table with each marker's canonical number (of its first value) and its tagged values as text, by marker number."""
    table = drift.consistent_table(t(spark, d, "raw_cells"), t(spark, d, "marker_catalog"))
    columns = []
    for no, marker in enumerate(table.columns[4:-1], start=1):
        values = F.col(f"`{marker}`")
        columns += [F.get(values, F.lit(0))["number"].alias(f"m{no}_number"), drift.tags(values).alias(f"m{no}_tags")]
    return table.select(*table.columns[:4], *columns, drift.tags(F.col("others"), True).alias("others"))


def _key(name: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({name})), '{drift.CHANNEL_FORMS}', '', 'g'), '[^a-z0-9]', '', 'g')"


_NAME = "CASE WHEN length(trim(par_name2)) > 0 THEN par_name2 ELSE par_name END"
_KIND = "CASE WHEN value IS NULL THEN 'null' " + " ".join(
    f"WHEN regexp_matches(trim(value), '{p.replace('(?i)', '')}'{', ' + chr(39) + 'i' + chr(39) if '(?i)' in p else ''}) THEN '{n}'" for n, p in drift.NOTATIONS.items()
) + " ELSE 'text' END"
_FILES = """files AS (SELECT file_id, h.run_id AS run_id, h.num_of_par AS num_of_par, h.acquired_at AS acquired_at,
 lag(file_id) OVER (PARTITION BY h.run_id ORDER BY h.acquired_at, file_id) AS previous_id
 FROM (SELECT file_id, max({'loaded_at': loaded_at, 'run_id': run_id, 'num_of_par': num_of_par, 'acquired_at': acquired_at}) AS h FROM fcshdr WHERE file_id IS NOT NULL GROUP BY file_id))"""
_NUMBER = """CASE WHEN kind = 'nan' THEN 'nan'::DOUBLE WHEN kind = 'decimal_comma' THEN CAST(replace(trim(value), ',', '.') AS DOUBLE) WHEN kind IN ('integer', 'decimal', 'scientific') THEN CAST(trim(value) AS DOUBLE) END"""
_INTEGER = "CASE WHEN kind = 'integer' THEN TRY_CAST(replace(trim(value), '+', '') AS BIGINT) END"
_VALUES = f"""vals AS (SELECT raw_id, file_id, row_no, CAST(i AS INTEGER) AS position, all_markers[i] AS name, all_data[i] AS value
 FROM (SELECT *, unnest(range(1, 1 + greatest(len(all_markers), len(all_data)))) AS i FROM raw_cells)),
tagged AS (SELECT raw_id, file_id, row_no, position, {_key('name')} AS path, {_KIND} AS kind, value FROM vals)"""

QUERIES = {f.__name__: f for f in (p5_found, p5_schema, p5_values, p5_alternatives, p5_table)}
ORACLE = {
    "p5_found": f"""WITH known AS (SELECT marker, {_key('marker')} AS key FROM marker_catalog), {_FILES},
own AS (SELECT file_id, marker, arg_min(name, par_no) AS name, arg_min(par_datatype, par_no) AS datatype, arg_min(par_bit, par_no) AS bit
 FROM (SELECT *, {_NAME} AS name FROM fcs_par) JOIN known ON {_key('name')} = key GROUP BY ALL),
now AS (SELECT f.file_id, marker, name, datatype, bit FROM files f JOIN own o ON f.file_id = o.file_id WHERE previous_id IS NOT NULL),
bef AS (SELECT f.file_id, marker, name, datatype, bit FROM files f JOIN own o ON f.previous_id = o.file_id)
SELECT file_id, marker, 'added' AS change_kind FROM now ANTI JOIN bef USING (file_id, marker)
UNION ALL SELECT file_id, marker, 'removed' FROM bef ANTI JOIN now USING (file_id, marker)
UNION ALL SELECT file_id, marker, 'renamed' FROM now JOIN bef USING (file_id, marker) WHERE now.name <> bef.name
UNION ALL SELECT file_id, marker, 'retyped' FROM now JOIN bef USING (file_id, marker) WHERE now.datatype IS DISTINCT FROM bef.datatype OR now.bit IS DISTINCT FROM bef.bit
UNION ALL SELECT file_id, marker, 'missing' FROM (SELECT DISTINCT f.file_id, k.marker FROM files f JOIN (SELECT run_id, unnest(used_markers) AS name FROM input_struct) u ON f.run_id = u.run_id JOIN known k ON {_key('u.name')} = k.key) ANTI JOIN own USING (file_id, marker)
UNION ALL SELECT file_id, '*', 'count' FROM files LEFT JOIN (SELECT file_id, count(DISTINCT par_no) AS n FROM fcs_par GROUP BY file_id) USING (file_id) WHERE num_of_par IS DISTINCT FROM coalesce(n, 0)""",
    "p5_schema": f"""WITH {_VALUES}, alls AS (
SELECT {_key(_NAME)} AS path, 'declared' AS origin, concat(coalesce(par_datatype, '?'), coalesce(CAST(par_bit AS VARCHAR), '?')) AS alternative, file_id FROM fcs_par
UNION ALL SELECT path, 'observed', kind, file_id FROM tagged)
SELECT path, origin, alternative, count(DISTINCT file_id) AS n_files, count(*) AS n_values, min(file_id) AS first_file FROM alls WHERE path IS NOT NULL GROUP BY ALL""",
    "p5_values": f"""WITH {_VALUES} SELECT raw_id, file_id, row_no, position, path, kind, {_INTEGER} AS integer, CASE WHEN {_INTEGER} IS NULL THEN {_NUMBER} END AS real,
CASE WHEN kind = 'text' THEN value END AS text, {_NUMBER} AS number FROM tagged""",
    "p5_table": f"""WITH {_VALUES}, known AS (SELECT marker_no, {_key('marker')} AS key FROM marker_catalog),
long AS (SELECT raw_id, marker_no, position, kind || ':' || coalesce(value, '') AS tag, {_NUMBER} AS x FROM tagged JOIN known ON path = key),
per AS (SELECT raw_id, marker_no, arg_min({{'x': x}}, position) AS first, string_agg(tag, '|' ORDER BY position) AS tags FROM long GROUP BY ALL),
wide AS (SELECT raw_id, {', '.join(f"any_value(first.x) FILTER (marker_no = {i}) AS m{i}_number, any_value(tags) FILTER (marker_no = {i}) AS m{i}_tags" for i in range(1, 25))} FROM per GROUP BY 1),
rest AS (SELECT raw_id, string_agg(coalesce(path, '') || '=' || kind || ':' || coalesce(value, ''), '|' ORDER BY position) AS others FROM tagged WHERE path IS NULL OR path NOT IN (SELECT key FROM known) GROUP BY 1)
SELECT r.raw_id, r.file_id, r.row_no, lower(trim(r.all_labels)) AS all_labels, coalesce(others, '') AS others, wide.* EXCLUDE (raw_id) FROM raw_cells r LEFT JOIN wide ON wide.raw_id = r.raw_id LEFT JOIN rest o ON o.raw_id = r.raw_id""",
    "p5_alternatives": f"""WITH {_VALUES}, {_FILES}, seen AS (SELECT DISTINCT file_id, path, kind AS alternative FROM tagged WHERE path IS NOT NULL AND kind <> 'null'),
firsts AS (SELECT run_id, path, alternative, min({{'a': acquired_at, 'f': file_id}}) AS hit FROM seen JOIN files USING (file_id) GROUP BY ALL)
SELECT run_id, path, alternative, hit.f AS file_id FROM (SELECT *, min(hit) OVER (PARTITION BY run_id, path) AS start FROM firsts) WHERE hit > start""",
}
