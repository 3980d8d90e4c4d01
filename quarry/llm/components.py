"""Connected components of a large link table, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import discard, materialise


def _mins(e: DataFrame) -> DataFrame:
    """The smallest neighbour of each u; the key is dealt out anew so that a join may split a hot one (AQE)."""
    return e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("u"), "m")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_mins(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    joined = e.join(_mins(e), "u")
    moved = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
    return moved.where("u > v").distinct()


def smallest_reachable(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (u long, v long): the smallest node that it reaches.

    Alternates large-star and small-star steps, each of which keeps the
    components and shortens the paths, until nothing changes: about the
    square of the logarithm of the longest path in rounds.  Each round is a
    written table.  Self-links and nulls are ignored, so a node with no other
    link has no row.
    """
    e = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, last = materialise(e, "links"), None
    for _ in range(max_rounds):
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.col("v") % 1_000_003).alias("s")).first()
        if state["n"] == 0 or (state["n"], state["h"], state["s"]) == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = (state["n"], state["h"], state["s"])
        after = materialise(_small_star(_large_star(e)), "links")
        discard(e)
        e = after
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
