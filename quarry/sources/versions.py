"""Versions of the chunk index: a build is written beside the others, checked, and put in force by one rename.

Under the index's folder every build has a folder of its own with ``chunks``
(in the order of their keys, with Bloom filters) and ``ranges`` (least and
greatest key of every file).  The file ``CURRENT`` names the one in force; it
is replaced by a rename that overwrites, which is atomic on HDFS and on local
disks.  A reader that has begun keeps its version, a build that fails leaves
``CURRENT`` alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("game", "article")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    p = _path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration())


def digest(df: DataFrame) -> tuple[int, int, int]:
    """Rows, and two sums over hashes of whole rows: equal for equal rows in any order and any number of files."""
    cols = sorted(df.columns)
    wide = "decimal(38,0)"
    r = df.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.xxhash64(F.lit(k), *cols).cast(wide)), F.lit(0).cast(wide)).alias(f"h{k}") for k in (1, 2))).first()
    return int(r["n"]), int(r["h1"]), int(r["h2"])


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version in force; none before the first build."""
    pointer = f"{path}/CURRENT"
    if not _files(spark, path).exists(_path(spark, pointer)):
        return None
    return f"{path}/{spark.read.text(pointer).first()[0]}"


def _switch(spark: SparkSession, path: str, name: str) -> None:
    files, draft = _files(spark, path), _path(spark, f"{path}/.CURRENT-{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    target = files.makeQualified(_path(spark, f"{path}/CURRENT"))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(draft), target, how)


def build(chunks: DataFrame, path: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Writes ``chunks`` as a new version, puts it in force if what is stored is what was sent, and returns it."""
    spark, name = chunks.sparkSession, f"v-{uuid.uuid4().hex}"
    writer = chunks.repartitionByRange(*keys, "chunk_id").sortWithinPartitions(*keys, "chunk_id").write
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
    writer.parquet(f"{path}/{name}/chunks")
    stored = spark.read.schema(chunks.schema).parquet(f"{path}/{name}/chunks")
    sent, got = digest(chunks), digest(stored)
    if sent != got:
        raise RuntimeError(f"{got[0]} chunks stored of {sent[0]}, or others than were sent")
    key = F.struct(*keys)
    ends = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("least"), F.max(key).alias("greatest"))
    ends.write.parquet(f"{path}/{name}/ranges")
    _switch(spark, path, name)
    return stored


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the version in force now; later switches do not touch what is returned."""
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no index at {path}")
    return spark.read.parquet(f"{folder}/chunks")


def lookup(spark: SparkSession, path: str, **key: str) -> DataFrame:
    """The chunks with this key (all of the build's keys, in their order), read from the files whose range holds it."""
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no index at {path}")
    wanted = F.struct(*(F.lit(v).alias(k) for k, v in key.items()))
    held = spark.read.parquet(f"{folder}/ranges").where((F.col("least") <= wanted) & (F.col("greatest") >= wanted)).select("file").collect()
    schema = spark.read.parquet(f"{folder}/chunks").schema
    found = spark.read.schema(schema).parquet(*(r["file"] for r in held)) if held else spark.createDataFrame([], schema)
    for k, v in key.items():
        found = found.where(F.col(k) == v)
    return found


def drop_old(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes versions not in force but for the ``keep`` youngest, those that failed builds have left included; returns how many."""
    folder, files = current(spark, path), _files(spark, path)
    listed = [s for s in files.listStatus(_path(spark, path)) if s.isDirectory() and s.getPath().getName().startswith("v-") and (folder is None or s.getPath().getName() != folder.rsplit("/", 1)[1])]
    old = sorted(listed, key=lambda s: -s.getModificationTime())[keep:]
    for s in old:
        files.delete(s.getPath(), True)
    return len(old)
