"""The mergeable operators on streams: node assignment (stream against a fixed node set) and state counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudfork.operators.distance import nearest_node
from cloudfork.session import checkpoint_dir


def assign_stream(stream: DataFrame, nodes: DataFrame, metric: str = "L1", **names) -> DataFrame:
    """``nearest_node`` of every arriving row."""
    return nearest_node(stream, nodes, metric, **names)


def state_counts(stream: DataFrame, columns: list[str], time: str | None = None, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts of the joint states so far; with ``time`` in tumbling windows, rows later than ``late`` left out."""
    if time is None:
        return stream.groupBy(*columns).count()
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *columns).count()


def run_to_table(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now, and return its last result as a table in the shared folder."""
    spark = result.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")
    query = result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/out")
