"""Records, lookups and assertions of the question pipeline over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import fixed as X
from quarry.functions import text as T
from quarry.operators import history as H
from quarry.operators import precedence as P
from quarry.plans import ask
from quarry.plans.corpus import CHUNKS, as_long, chunks, query, questions, table
from quarry.plans.retrieval_queries import EVIDENCE, evidence
from quarry.plans.text_queries import _ANSWER, _answers


@query(rf"""WITH {CHUNKS}, {_ANSWER}, loc AS (SELECT chunk_id AS found, game_title || ' — Article ' || article || ', p.' || page AS locator FROM chunks WHERE article <> '')
SELECT a.chunk_id, count(found) AS n_found, min(found) AS first_found FROM answers a LEFT JOIN loc ON loc.locator = a.game_title || ' — Article ' || a.article || ', p.' || a.page WHERE a.article <> '' GROUP BY a.chunk_id""")
def locator_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the first citation of each answer may mean; those of one place are counted before answers meet them."""
    loc = chunks(spark, sf_dir).where("article <> ''").select(F.col("chunk_id").alias("found"), T.locator(T.citation(F.col("game_title"), F.col("article"), F.col("page"))).alias("locator"))
    a = _answers(spark, sf_dir).where("article <> ''").select("chunk_id", F.get(T.cited_locators(F.col("answer")), F.lit(0)).alias("locator"))
    there = loc.groupBy("locator").agg(F.count("*").alias("n"), F.min("found").alias("first_found"))
    return a.join(there, "locator", "left").groupBy("chunk_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_found"), F.min("first_found").alias("first_found"))


@query(rf"""WITH {EVIDENCE}, r AS (SELECT query_id, chunk_id, coalesce(CASE WHEN chunk_id % 6 <> 0 THEN rel_rank END, {X.MISSING_RANK}) AS rank FROM evidence)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS place FROM r""")
def relevance_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by rank, unranked chunks (here each sixth id) last."""
    r = evidence(spark, sf_dir).select("query_id", "chunk_id", F.coalesce(F.when(F.col("chunk_id") % 6 != 0, F.col("rel_rank")), F.lit(X.MISSING_RANK)).alias("rank"))
    return r.select("query_id", "chunk_id", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "chunk_id")).cast("long").alias("place"))


