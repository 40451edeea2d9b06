"""The store of a run: one Parquet table an artifact, and a manifest of the branches.

Branches are listed in the manifest, not found by listing folders, so that remains of older
runs are never read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


class RunStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def find(self, name: str) -> DataFrame | None:
        """The table, or None if the run has none of that name."""
        try:
            return self.load(name)
        except AnalysisException:
            return None

    def save_run(self, run, options: dict | None = None) -> None:
        self.save_tables(run.tables(), options)

    def save_tables(self, tables: dict[str, DataFrame], options: dict | None = None) -> None:
        """The tables, and then the manifest: a run that stopped halfway has none, or an older one's that is overwritten."""
        for name, df in tables.items():
            self.save(name, df)
        rows = [(name, json.dumps(options or {}, sort_keys=True, default=str)) for name in tables]
        self.save("manifest", self.spark.createDataFrame(rows, "artifact string, options string"))

    def load_run(self) -> dict[str, DataFrame]:
        """Every table that the manifest lists."""
        return {r["artifact"]: self.load(r["artifact"]) for r in self.load("manifest").collect()}

    def resumes(self, options: dict) -> bool:
        """Whether a complete run with the same options is there."""
        manifest = self.find("manifest")
        return manifest is not None and manifest.filter(manifest["options"] != json.dumps(options, sort_keys=True, default=str)).isEmpty()
