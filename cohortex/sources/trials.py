"""Trials of a search, kept in a table so that a study can be taken up again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortex.staging import _fs


class TrialStore:
    """An append-only Parquet table of trials keyed by study; of a trial written twice the later one counts."""

    SCHEMA = "study string, trial int, params string, path array<double>, state string, at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        """All trials, one row each; empty where nothing was written yet."""
        fs, p = _fs(self.spark, self.path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows.groupBy("study", "trial").agg(F.max_by(F.struct("params", "path", "state", "at"), "at").alias("t")).select("study", "trial", "t.*")

    def add(self, study: str, trial: int, params: str, path: list[float], state: str) -> None:
        row = self.spark.createDataFrame([(study, trial, params, path, state)], "study string, trial int, params string, path array<double>, state string")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def load(self, study: str) -> dict[int, dict]:
        """The study's trials by number (as many as were run, each some bytes)."""
        return {r["trial"]: {"params": r["params"], "path": list(r["path"]), "state": r["state"]} for r in self.table().where(F.col("study") == study).collect()}
