import math
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession


def tables_in_duckdb(folder: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


def same_rows(df: DataFrame, duck: duckdb.DuckDBPyConnection, sql: str) -> None:
    """The same columns and rows, floating-point numbers to nine digits."""
    columns = sorted(df.columns)
    ours = sorted("|".join(map(_text, r)) for r in df.select(*columns).collect())
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert ours == sorted("|".join(_text(r[i]) for i in order) for r in cursor.fetchall())


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    yield session
    session.stop()
