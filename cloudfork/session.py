"""Session-level helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The folder of ``spark.checkpoint.dir`` (or one set on the context before) is used as it is.
    Only a local session that names none, as in tests, gets a new folder; on a cluster it is an error.
    """
    context = spark.sparkContext
    jsc = context._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from there.

    Used after steps that are read more than once, and in loops, so that lineage and plans
    stay short and a lost executor costs no recomputation of earlier rounds.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut``, and the number of rows, counted while they are written."""
    rows = Observation()
    table = cut(df.observe(rows, F.count(F.lit(1)).alias("n")))
    return table, rows.get["n"]


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame that ``cut`` returned; it can't be read any more. Other frames keep theirs."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cut-" in path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
