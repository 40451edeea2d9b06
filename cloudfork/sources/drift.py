"""Schemas that drift between files: one consistent table and a report of each change.

Method: tagged-union inference. Every field path keeps all the alternatives seen for it:
the names and types that files declare and the notations in which values are written. Parallel
schemas are fused path by path; where alternatives conflict, a value goes to its typed
branch (integer, real or text) and, where it can be read as one, to the canonical number; the
report names each alternative where it first appears, and reads off the fused paths, in the
order of files, where an alternative comes, goes or gives way to another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The ways a channel is written around a marker's name, in lower case.
CHANNEL_FORMS = r"^[0-9]+[a-z]{1,2}[_ ]|^[a-z]{1,2}[0-9]+di-|\([a-z]{1,2}[0-9]+\)di$|_[a-z]{1,2}[0-9]+$"
#: Notations of a value, by the first pattern that its trimmed text matches.
NOTATIONS = {
    "empty": r"^$",
    "nan": r"^(?i)nan$",
    "integer": r"^[+-]?[0-9]+$",
    "decimal": r"^[+-]?[0-9]*\.[0-9]+$",
    "decimal_comma": r"^[+-]?[0-9]+,[0-9]+$",
    "scientific": r"^[+-]?[0-9]+(\.[0-9]*)?[eE][+-]?[0-9]+$",
}


def spelling_key(name: Column) -> Column:
    """A field name without its channel, case, blanks and punctuation."""
    bare = F.regexp_replace(F.lower(F.trim(name)), CHANNEL_FORMS, "")
    return F.regexp_replace(bare, "[^a-z0-9]", "")


def notation(text: Column) -> Column:
    """The kind of a value's text: null, one of NOTATIONS, or text."""
    trimmed = F.trim(text)
    kind = F.when(text.isNull(), "null")
    for name, pattern in NOTATIONS.items():
        kind = kind.when(trimmed.rlike(pattern), name)
    return kind.otherwise("text")


def canonical_number(text: Column, kind: Column) -> Column:
    """The number that a value's text stands for; null for null, empty and other text."""
    readable = F.when(kind == "decimal_comma", F.regexp_replace(text, ",", ".")).when(kind.isin("nan", "integer", "decimal", "scientific"), text)
    return F.when(kind == "nan", F.lit(float("nan"))).otherwise(F.trim(readable).try_cast("double"))


def fields(par: DataFrame, catalog: DataFrame) -> DataFrame:
    """(file_id, marker, name, datatype, bit): the catalog markers of each file.

    A field's name is par_name2, or par_name where that is null or blank. Of several fields
    of a file that are the same marker, the one with the lowest number counts; repeated rows
    count once; rows without file or name and fields that are no catalog marker drop out.
    """
    name = F.when(F.length(F.trim("par_name2")) > 0, F.col("par_name2")).otherwise(F.col("par_name"))
    named = par.select("file_id", "par_no", name.alias("name"), F.col("par_datatype").alias("datatype"), F.col("par_bit").alias("bit"))
    known = catalog.select("marker", spelling_key(F.col("marker")).alias("key")).dropDuplicates(["key"])
    row = F.struct("par_no", "name", "datatype", "bit")
    return (  # by file_id, so that what follows by file moves nothing again
        named.filter("file_id is not null and name is not null").withColumn("key", spelling_key(F.col("name")))
        .join(known, "key").drop("key").repartition("file_id").groupBy("file_id", "marker").agg(F.min(row).alias("f"))
        .select("file_id", "marker", "f.name", "f.datatype", "f.bit")
    )


def file_order(header: DataFrame) -> DataFrame:
    """(file_id, run_id, num_of_par, acquired_at, seq, next_id): one row a file, the latest delivery, numbered within its run; ties by file_id."""
    latest = header.filter("file_id is not null").groupBy("file_id").agg(
        F.max(F.struct("loaded_at", "run_id", "num_of_par", "acquired_at")).alias("h")
    ).select("file_id", "h.run_id", "h.num_of_par", "h.acquired_at")
    by = Window.partitionBy("run_id").orderBy("acquired_at", "file_id")
    return latest.withColumns({"seq": F.row_number().over(by), "next_id": F.lead("file_id").over(by)})


def declared_alternatives(par: DataFrame, order: DataFrame, catalog: DataFrame) -> DataFrame:
    """(run_id, marker, seq, file_id, next_id, alternative): the fused schema of each run. Each path, a catalog
    marker, with the alternative (name, datatype, bit) of every file that has it; ``order`` is ``file_order``."""
    own = fields(par, catalog).select("file_id", "marker", F.struct("name", "datatype", "bit").alias("alternative"))
    return own.join(_merged(order.select("file_id", "run_id", "seq", "next_id")), "file_id")


def _merged(table: DataFrame) -> DataFrame:
    """A table of files or runs for a join: never broadcast. Spark goes by the size of the Parquet files, which may be a hundredth of the rows in the driver's memory."""
    return table.hint("merge")


def alternative_changes(fused: DataFrame) -> DataFrame:
    """(file_id, marker, change_kind): where, along the files of a run, a path's alternative comes, goes or gives way to another.

    A file's alternative is compared with the one before it on the same path; a gap between their
    numbers is a removal in the file after the earlier one and an addition in the later one.
    """
    path = Window.partitionBy("run_id", "marker").orderBy("seq")
    seen = fused.select("*", F.lag(F.struct("seq", "alternative")).over(path).alias("last"), F.lead("seq").over(path).alias("next"))
    follows, now, old = F.col("last.seq") == F.col("seq") - 1, F.col("alternative"), F.col("last.alternative")
    retyped = ~(now["datatype"].eqNullSafe(old["datatype"]) & now["bit"].eqNullSafe(old["bit"]))

    def change(when: Column, file: str, kind: str) -> Column:
        return F.when(when, F.struct(F.col(file).alias("file_id"), F.lit(kind).alias("change_kind")))

    changes = F.array(
        change((F.col("seq") > 1) & ~F.coalesce(follows, F.lit(False)), "file_id", "added"),
        change(F.col("next_id").isNotNull() & (F.coalesce("next", F.lit(0)) != F.col("seq") + 1), "next_id", "removed"),
        change(follows & (now["name"] != old["name"]), "file_id", "renamed"),
        change(follows & retyped, "file_id", "retyped"),
    )
    return seen.select("marker", F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("c")).select("c.file_id", "marker", "c.change_kind")


def schema_changes(par: DataFrame, header: DataFrame, runs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(file_id, marker, change_kind): added, removed, renamed, retyped against the run's previous
    file; missing: a used marker of the run is not in the file; count: num_of_par is not the number
    of distinct par_no (marker '*'; a null num_of_par differs, a file without fields has 0).

    Files follow acquired_at within a run (nulls first, ties by file_id); files without a run
    are one group of their own. Empty tables give no rows; extra columns are ignored.
    """
    order = file_order(header)
    fused = declared_alternatives(par, order, catalog)
    known = catalog.select("marker", spelling_key(F.col("marker")).alias("key")).dropDuplicates(["key"])
    used = runs.select("run_id", F.explode("used_markers").alias("name")).withColumn("key", spelling_key(F.col("name"))).join(known, "key").groupBy("run_id").agg(F.collect_set("marker").alias("used"))
    held = fields(par, catalog).groupBy("file_id").agg(F.collect_set("marker").alias("held"))  # of a file, at most the catalog
    asked = order.select("file_id", "run_id").join(_merged(used), "run_id").join(_merged(held), "file_id", "left")
    absent = F.array_except("used", F.coalesce("held", F.array().cast("array<string>")))
    missing = asked.select("file_id", F.explode(absent).alias("marker"), F.lit("missing").alias("change_kind"))
    numbers = par.filter("file_id is not null").groupBy("file_id").agg(F.countDistinct("par_no").alias("n"))
    counted = order.join(_merged(numbers), "file_id", "left").filter(~F.col("num_of_par").eqNullSafe(F.coalesce("n", F.lit(0)).cast("int")))
    return alternative_changes(fused).unionByName(missing).unionByName(counted.select("file_id", F.lit("*").alias("marker"), F.lit("count").alias("change_kind")))


def typed_branches(value: Column, kind: Column) -> dict[str, Column]:
    """integer, real or text: the branch of a value by its kind (whole numbers beyond 64 bits are real); number: the canonical conversion."""
    number = canonical_number(value, kind)
    integer = F.when(kind == "integer", F.trim(value).try_cast("bigint"))
    return {"integer": integer, "real": F.when(integer.isNull(), number), "text": F.when(kind == "text", value), "number": number}


def tagged_values(raw: DataFrame) -> DataFrame:
    """(raw_id, file_id, row_no, position, name, path, kind, integer, real, text, number): every value under its path.

    path is the spelling key; names and values pair by position, and the shorter side is
    padded with null. text holds what is neither number nor empty; rows without both arrays drop out.
    """
    pairs = raw.select("raw_id", "file_id", "row_no", F.posexplode(F.arrays_zip(F.col("all_markers").alias("name"), F.col("all_data").alias("value"))))
    kind = notation(F.col("value"))
    return pairs.select(
        "raw_id", "file_id", "row_no", (F.col("pos") + 1).alias("position"), F.col("col.name").alias("name"), F.col("col.value").alias("value")
    ).select(
        "raw_id", "file_id", "row_no", "position", "name", spelling_key(F.col("name")).alias("path"), kind.alias("kind"),
        *[c.alias(name) for name, c in typed_branches(F.col("value"), kind).items()],
    )


def fused_schema(raw: DataFrame, par: DataFrame) -> DataFrame:
    """(path, origin, alternative, n_files, n_values, first_file): the tagged union of each path.

    origin 'declared': the types in the files' parameters; 'observed': the notations of the values.
    """
    name = F.when(F.length(F.trim("par_name2")) > 0, F.col("par_name2")).otherwise(F.col("par_name"))
    declared = par.select(spelling_key(name).alias("path"), F.lit("declared").alias("origin"), F.concat(F.coalesce("par_datatype", F.lit("?")), F.coalesce(F.col("par_bit").cast("string"), F.lit("?"))).alias("alternative"), "file_id")
    observed = tagged_values(raw).select("path", F.lit("observed").alias("origin"), F.col("kind").alias("alternative"), "file_id")
    return declared.unionByName(observed).filter("path is not null").groupBy("path", "origin", "alternative").agg(
        F.countDistinct("file_id").alias("n_files"), F.count("*").alias("n_values"), F.min("file_id").alias("first_file")
    )


def appearing_alternatives(raw: DataFrame, header: DataFrame) -> DataFrame:
    """(run_id, path, alternative, file_id): the file of each run in which a path first shows a notation,
    where other notations of that path came before it."""
    seen = tagged_values(raw).filter("path is not null and kind <> 'null'").select("file_id", "path", F.col("kind").alias("alternative")).distinct()
    placed = seen.join(_merged(file_order(header).select("file_id", "run_id", "acquired_at")), "file_id")
    first = placed.groupBy("run_id", "path", "alternative").agg(F.min(F.struct("acquired_at", "file_id")).alias("at"))
    start = Window.partitionBy("run_id", "path")
    return first.withColumn("start", F.min("at").over(start)).filter(F.col("at") > F.col("start")).select("run_id", "path", "alternative", "at.file_id")


def _has_path(key: str):
    return lambda e: e["path"] == key


def consistent_table(raw: DataFrame, catalog: DataFrame) -> DataFrame:
    """raw_id, file_id, row_no, all_labels, then for each catalog marker an array of its values in the row, and the
    other fields as ``others``: one schema for every file.

    A value is a struct (path, kind, value, integer, real, text, number), value being the text as
    delivered. A marker that a row has twice has both values, in order; one that it lacks is null.
    The catalog is schema-sized: its names become columns.
    """

    def entry(pair: Column) -> Column:
        kind = notation(pair["all_data"])
        branches = [c.alias(name) for name, c in typed_branches(pair["all_data"], kind).items()]
        return F.struct(spelling_key(pair["all_markers"]).alias("path"), kind.alias("kind"), pair["all_data"].alias("value"), *branches)

    keys = {r["marker"]: r["key"] for r in catalog.select("marker_no", "marker", spelling_key(F.col("marker")).alias("key")).orderBy("marker_no").collect()}
    tagged = raw.withColumn("_tagged", F.transform(F.arrays_zip("all_markers", "all_data"), entry))
    found = {marker: F.filter("_tagged", _has_path(key)) for marker, key in keys.items()}
    columns = [F.when(F.size(values) > 0, values).alias(marker) for marker, values in found.items()]
    others = F.filter("_tagged", lambda e: e["path"].isNull() | ~e["path"].isin(list(keys.values())))
    return tagged.select("raw_id", "file_id", "row_no", F.lower(F.trim("all_labels")).alias("all_labels"), *columns, others.alias("others"))


def tags(values: Column, with_path: bool = False) -> Column:
    """An array of tagged values as one text: kind:value, or path=kind:value, joined by |."""
    return F.array_join(F.transform(values, lambda e: F.concat(*([F.coalesce(e["path"], F.lit("")), F.lit("=")] if with_path else []), e["kind"], F.lit(":"), F.coalesce(e["value"], F.lit("")))), "|")
