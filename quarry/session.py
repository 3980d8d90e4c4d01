"""The package on the workers' path."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where the driver was not started from its folder."""
    home = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, (home, env.get("PYTHONPATH"))))
