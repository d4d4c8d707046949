"""Keeping the monthly panel current from a stream of landing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landing_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_totals(events: DataFrame, ts: str, entity: str, value: str, late: str = "7 days") -> DataFrame:
    """Totals per entity and day; rows later than the watermark are left out."""
    day = F.window(ts, "1 day")
    g = events.withWatermark(ts, late).groupBy(day.alias("w"), entity).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").cast("date").alias("day"), entity, "n", "total")


def run_to_table(df: DataFrame, path: str, checkpoint: str):
    """Append finished days to a Parquet table until the source is drained."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
