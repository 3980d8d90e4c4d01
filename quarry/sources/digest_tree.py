"""Two corpora compared from the root of a tree of digests: only key ranges that differ are read.

Rows are dealt into ``LEAVES`` ranges of their key's hash, each in a folder of
its own.  A leaf's digest is of its rows in any order (their number and two
sums over row hashes); a parent's is of its ``FANOUT`` children in order, up to
one root.  Equal corpora have equal roots, however they are ordered and cut
into files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import store

#: Ranges, a power of the fan-out.
LEAVES, FANOUT = 256, 16
TREE = "level int, node int, n long, digest string"


def _levels() -> int:
    n, k = LEAVES, 0
    while n > 1:
        n, k = n // FANOUT, k + 1
    return k


def tree(rows: DataFrame, key: str) -> DataFrame:
    """(level, node, n, digest) of the ranges that have rows; level 0 is the root.  One pass over the rows, then a row a range."""
    cols, wide = sorted(rows.columns), "decimal(38,0)"
    sums = (F.sum(F.xxhash64(F.lit(k), *cols).cast(wide)).cast("string") for k in (1, 2))
    leaf = F.pmod(F.xxhash64(key), F.lit(LEAVES)).cast("int")
    level = rows.groupBy(leaf.alias("node")).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("digest"))
    level = store.written(level, "leaves")
    out = level.select(F.lit(_levels()).alias("level"), "node", "n", "digest")
    for k in reversed(range(_levels())):
        below = F.sort_array(F.collect_list(F.struct("node", "digest")))
        level = level.groupBy(F.expr(f"cast(node div {FANOUT} as int)").alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(below, lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), ","), 256).alias("digest"))
        out = out.unionByName(level.select(F.lit(k).alias("level"), "node", "n", "digest"))
    return out


def write(rows: DataFrame, key: str, path: str) -> str | None:
    """Stores the rows by range and their tree; returns the root, none of no rows."""
    leaf = F.pmod(F.xxhash64(key), F.lit(LEAVES)).cast("int")
    rows.withColumn("leaf", leaf).repartition("leaf").write.partitionBy("leaf").parquet(f"{path}/rows")
    spark = rows.sparkSession
    tree(read(spark, path, rows.schema), key).coalesce(1).write.parquet(f"{path}/tree")
    return root(spark, path)


def read(spark: SparkSession, path: str, schema, leaves: list[int] | None = None) -> DataFrame:
    """The rows of the given ranges, of all without them."""
    if leaves is None:
        return spark.read.schema(schema).parquet(f"{path}/rows")
    there = [f"{path}/rows/leaf={k}" for k in leaves]
    return spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)


def _tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TREE).parquet(f"{path}/tree")


def root(spark: SparkSession, path: str) -> str | None:
    r = _tree(spark, path).where("level = 0").first()
    return r["digest"] if r else None


def differing(spark: SparkSession, a: str, b: str) -> dict[int, tuple[bool, bool]]:
    """The ranges that differ, and on which sides they have rows; from the root down, children of equal nodes are not looked at."""
    x, y = _tree(spark, a), _tree(spark, b).withColumnsRenamed({"n": "m", "digest": "other"})
    both = x.join(y, ["level", "node"], "full").where(~F.col("digest").eqNullSafe(F.col("other")))
    open_nodes = {0}
    for k in range(_levels() + 1):
        parents = [*open_nodes]  # at most a row a range
        rows = both.where((F.col("level") == k) & (F.col("node").isin(parents) if k == 0 else F.expr(f"cast(node div {FANOUT} as int)").isin(parents))).collect()
        open_nodes = {r["node"] for r in rows}
        if not rows:
            return {}
    return {r["node"]: (r["digest"] is not None, r["other"] is not None) for r in rows}


def differences(spark: SparkSession, a: str, b: str, schema) -> DataFrame:
    """Rows on one side only, with repeats counted and ``side``, from the ranges that differ."""
    found = differing(spark, a, b)
    left, right = (read(spark, path, schema, sorted(k for k, has in found.items() if has[i])) for i, path in enumerate((a, b)))
    return store.differences(left, right)
