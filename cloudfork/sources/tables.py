"""Cells from tables and files: marker columns by name, labels, one schema for all files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudfork.config import Options
from cloudfork.functions.scalar import arcsinh


def resolve(columns: list[str], wanted: list[str], long_names: dict[str, str] | None = None) -> list[str]:
    """The column of each wanted marker, in the order asked for: by long name, else by the column's own name.

    A marker that is missing, or that two columns bear, is an error.
    """
    out = []
    for m in wanted:
        hits = [c for c in columns if (long_names or {}).get(c) == m] or [c for c in columns if c == m]
        if len(hits) != 1:
            raise ValueError(f"marker {m!r} " + ("is missing" if not hits else f"is borne by {hits}"))
        out.append(hits[0])
    return out


def cells_from_wide(df: DataFrame, key: str, label: str, used: list[str], extra: list[str] | None = None, options: Options | None = None) -> DataFrame:
    """(cell_id, label, features, extra) of a table with a column for each marker, transformed by its cofactor."""

    def array(markers: list[str]):
        columns = resolve(df.columns, markers)
        factor = {m: (options.cofactors.get(m, options.default_cofactor) if options else 0) for m in markers}
        return F.array(*[arcsinh(F.col(c).cast("double"), factor[m]) for m, c in zip(markers, columns)]) if markers else F.array().cast("array<double>")

    return df.select(F.col(key).alias("cell_id"), F.col(label).cast("string").alias("label"), array(used).alias("features"), array(extra or []).alias("extra"))


def to_long(cells: DataFrame, markers: list[str]) -> DataFrame:
    """(cell_id, label, marker, value), one row a cell and marker."""
    names = F.array(*[F.lit(m) for m in markers])
    pairs = cells.select("cell_id", "label", F.posexplode("features").alias("i", "value"))
    return pairs.select("cell_id", "label", F.get(names, F.col("i")).alias("marker"), "value")


def union_files(parts: dict[str, DataFrame]) -> DataFrame:
    """All tables under one another, by column name, with their label; differing columns are an error."""
    out, names = None, None
    for label, df in parts.items():
        if names is not None and set(df.columns) != names:
            raise ValueError(f"{label!r} has other columns: {sorted(set(df.columns) ^ names)}")
        names = set(df.columns)
        df = df.withColumn("label", F.lit(label))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no tables")
    return out


def write_text(df: DataFrame, path: str, decimals: int = 4) -> None:
    """Tab-separated files with a header; floating-point columns with a fixed number of decimals."""
    columns = [F.format_string(f"%.{decimals}f", c).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    df.select(*columns).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
