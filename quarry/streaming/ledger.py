"""Spend as a stream: windowed sums with a watermark, and running totals against a ceiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fixed as X


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """The event files of a folder as a stream; their schema is read once."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def spend_by_window(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sum and count per window and type; rows later than the watermark are dropped."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.sum("value").alias("usd"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "usd", "n")


def refusals(spend: DataFrame, ceiling: float = X.BUDGET_DAY, estimate: float = X.BUDGET_ESTIMATE) -> DataFrame:
    """Does the next question exceed the ceiling of its window (strictly)?"""
    return spend.withColumn("refused", F.col("usd") + estimate > ceiling)
