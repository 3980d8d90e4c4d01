"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Spark deletes a plan's shuffle files when the plan has run, not when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` or ``setCheckpointDir`` names; a temporary one only where driver and executors are one process (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        folder = tempfile.mkdtemp(prefix="quarry-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own["dir"] = f"file://{folder}"
    return _own["dir"]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialise` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_quarry_path", None)
        if path is not None:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
