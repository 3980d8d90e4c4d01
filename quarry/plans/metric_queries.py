"""Evaluation, cost, history and corpus reports over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import fixed as X
from quarry.functions import text as T
from quarry.operators import metrics as M
from quarry.plans.corpus import CHUNKS, QUESTIONS, as_long, chunks, query, questions, table
from quarry.plans.retrieval_queries import EVIDENCE, evidence

_LABELS = r"""labels_q AS (SELECT query_id * 2 + k AS label_id, query_id, coalesce(game, 'global') AS game, (query_id % 9 + 1) || CASE WHEN k = 1 THEN '.' || (query_id % 7 + 1) ELSE '' END AS prefix FROM questions, (VALUES (0), (1)) v(k)),
qrels AS (SELECT label_id, query_id, chunk_id FROM labels_q l JOIN chunks c ON l.game = c.game AND (c.article = l.prefix OR starts_with(c.article, l.prefix || '.')))"""


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).select("query_id", F.coalesce("game", F.lit("global")).alias("game"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    first = (F.col("query_id") % 9 + 1).cast("string")
    prefix = F.when(F.col("k") == 1, F.concat_ws(".", first, (F.col("query_id") % 7 + 1).cast("string"))).otherwise(first)
    return M.resolve_labels(q.select((F.col("query_id") * 2 + F.col("k")).alias("label_id"), "query_id", "game", prefix.alias("prefix")), chunks(spark, sf_dir))


@query(f"WITH {CHUNKS}, {QUESTIONS}, {_LABELS} SELECT * FROM qrels")
def label_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qrels(spark, sf_dir)


@query(as_long(f"WITH {CHUNKS}, {QUESTIONS}, {_LABELS} SELECT count(*) AS labels, sum(n) AS labelled, (SELECT count(DISTINCT (query_id, chunk_id)) FROM qrels) AS distinct_chunks, max(n) AS most, count_if(n > 1) AS several, count_if(n > {X.FUSED_K}) AS beyond_pool FROM (SELECT label_id, count(*) AS n FROM qrels GROUP BY label_id)", "labelled several beyond_pool"))
def qrels_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _qrels(spark, sf_dir)
    per = q.groupBy("label_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("labels"), F.sum("n").alias("labelled"), F.max("n").alias("most"), F.count_if(F.col("n") > 1).alias("several"), F.count_if(F.col("n") > X.FUSED_K).alias("beyond_pool"), F.lit(1).alias("one"))
    return per.join(q.agg(F.countDistinct("query_id", "chunk_id").alias("distinct_chunks"), F.lit(1).alias("one")), "one").drop("one")


_RANKED = f"{EVIDENCE}, {_LABELS}, ranked AS (SELECT qrels.*, rel_rank AS rank FROM qrels LEFT JOIN evidence USING (query_id, chunk_id))"


@query(f"""WITH {_RANKED}, pl AS (SELECT query_id, label_id, min(rank) AS best, count(*) AS n, count_if(rank <= 8) AS hits FROM ranked GROUP BY ALL)
SELECT (SELECT round(avg(CAST(coalesce(best <= 8, false) AS INTEGER)), 6) FROM pl) AS recall_label, (SELECT round(sum(hits) / sum(n), 6) FROM pl) AS recall_micro, (SELECT round(avg(CAST(best <= {X.ACCOUNTABLE_RANK} AS INTEGER)), 6) FROM pl) AS within_accountable,
  (SELECT round(avg(coalesce(1 / b, 0)), 6) FROM (SELECT min(best) AS b FROM pl GROUP BY query_id)) AS mrr, (SELECT count(DISTINCT query_id) FROM pl) AS n_cases,
  (SELECT round(avg(r), 6) FROM (SELECT count(DISTINCT CASE WHEN rank <= 8 THEN chunk_id END) / count(DISTINCT chunk_id) AS r FROM ranked GROUP BY query_id)) AS recall_macro""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.retrieval_metrics(M.label_ranks(_qrels(spark, sf_dir), evidence(spark, sf_dir)), X.FUSED_K)


@query(f"WITH {_RANKED} SELECT r.rank, count(ranked.rank) AS n, r.rank <= {X.ACCOUNTABLE_RANK} AS accountable FROM (SELECT unnest(range(1, 9)) AS rank) r LEFT JOIN ranked USING (rank) GROUP BY r.rank")
def rank_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = M.label_ranks(_qrels(spark, sf_dir), evidence(spark, sf_dir)).groupBy("rank").agg(F.count("rank").alias("n"))
    return spark.range(1, X.FUSED_K + 1).withColumnRenamed("id", "rank").join(ranked, "rank", "left").select("rank", F.coalesce("n", F.lit(0)).alias("n"), (F.col("rank") <= X.ACCOUNTABLE_RANK).alias("accountable"))


@query("""SELECT answerable, outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY answerable), 6) AS share FROM (
  SELECT CASE WHEN quality = 1 THEN 'answerable' ELSE 'unanswerable' END AS answerable, CASE WHEN toxic = 1 THEN 'abstained' WHEN doc_id % 3 = 0 THEN 'uncited' ELSE 'answered' END AS outcome FROM labels) GROUP BY answerable, outcome""")
def outcome_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "answerable").otherwise("unanswerable").alias("answerable"), F.when(F.col("toxic") == 1, "abstained").when(F.col("doc_id") % 3 == 0, "uncited").otherwise("answered").alias("outcome"))
    n = l.groupBy("answerable", "outcome").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("answerable")), 6))


_COST = "(value * 0.15 + (event_id % 7) * 0.6) / 1000000"


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, round(sum({_COST}), 7) AS usd, count(*) AS n, GROUPING(strftime(ts, '%Y-%m-%d'), user_id) AS level FROM events GROUP BY GROUPING SETS ((strftime(ts, '%Y-%m-%d')), (user_id), ())")
def spend_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend by day, by conversation and in all, in one pass."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", ((F.col("value") * 0.15 + (F.col("event_id") % 7) * 0.6) / 1_000_000).alias("usd"))
    out = e.groupingSets([["day"], ["user_id"], []], "day", "user_id").agg(F.round(F.sum("usd"), 7).alias("usd"), F.count("*").alias("n"), F.grouping_id("day", "user_id").alias("level"))
    return out.select("day", "user_id", "usd", "n", "level")


@query(f"SELECT user_id, round(spent, 9) AS spent, CASE WHEN day_spent + 0.0015 > 0.5 THEN 'day' WHEN spent + 0.0015 > 0.25 THEN 'conversation' ELSE 'ok' END AS refusal FROM (SELECT user_id, sum({_COST}) * 100 AS spent, max(day_spent) * 100 AS day_spent FROM (SELECT *, sum({_COST}) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d')) AS day_spent FROM events) GROUP BY user_id)")
def budget_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the next question refused: the day's ceiling is tested before the conversation's, strictly."""
    e = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), ((F.col("value") * 0.15 + (F.col("event_id") % 7) * 0.6) / 1_000_000).alias("usd"))
    by_day = e.groupBy("user_id", "day").agg(F.sum("usd").alias("usd"))
    s = by_day.groupBy("user_id").agg((F.sum("usd") * 100).alias("spent"), (F.max("usd") * 100).alias("day_spent"))
    state = F.when(F.col("day_spent") + X.BUDGET_ESTIMATE > X.BUDGET_DAY, "day").when(F.col("spent") + X.BUDGET_ESTIMATE > X.BUDGET_CONVERSATION, "conversation").otherwise("ok")
    return s.select("user_id", F.round("spent", 9).alias("spent"), state.alias("refusal"))


@query(as_long(f"SELECT count(*) AS docs, sum(t) AS total, max(t) AS most, round(avg(t), 1) AS mean, count_if(t > {X.MAX_EMBEDDING_TOKENS}) AS too_long, round(sum(t) * 0.02 / 1000000, 6) AS usd, CAST(NULL AS DOUBLE) AS usd_unpriced FROM (SELECT greatest(1, length(text) // 4) AS t FROM documents)", "total too_long"))
def token_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select(M.tokens_estimate(F.col("text")).alias("t"))
    return t.agg(F.count("*").alias("docs"), F.sum("t").alias("total"), F.max("t").alias("most"), F.round(F.avg("t"), 1).alias("mean"), F.count_if(F.col("t") > X.MAX_EMBEDDING_TOKENS).alias("too_long"), F.round(F.sum("t") * 0.02 / 1_000_000, 6).alias("usd"), F.lit(None).cast("double").alias("usd_unpriced"))


@query(as_long("""SELECT conv_id, sum(n) AS turn_count, string_agg(role, ',' ORDER BY first_turn) AS roles, max(last_turn) AS last_turn, left(arg_min(first_text, first_turn), 60) AS title
FROM (SELECT conv_id, role, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn, arg_min(text, turn) AS first_text FROM conversations GROUP BY conv_id, role) GROUP BY conv_id""", "turn_count"))
def conversation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, roles in the order first seen, last turn and title of each conversation."""
    r = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.min_by("text", "turn").alias("first_text"))
    g = r.groupBy("conv_id").agg(F.sum("n").alias("turn_count"), F.sort_array(F.collect_list(F.struct("first_turn", "role"))).alias("seen"), F.max("last_turn").alias("last_turn"), F.min_by("first_text", "first_turn").alias("t"))
    return g.select("conv_id", "turn_count", F.array_join("seen.role", ",").alias("roles"), "last_turn", F.substring("t", 1, 60).alias("title"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS latest FROM conversations")
def turn_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).cast("long").alias("seq"), (F.row_number().over(w.orderBy(F.desc("turn"))) == 1).alias("latest"))


@query(as_long(rf"WITH {CHUNKS} SELECT game, count(*) AS chunks, count_if(article <> '') AS with_article, count(DISTINCT CASE WHEN article <> '' THEN concat_ws(' § ', nullif(part, ''), article) END) AS article_ids, count(DISTINCT nullif(article, '')) AS articles, min(page) AS first_page, max(page) AS last_page, round(100 * count_if(article <> '') / count(*), 3) AS pct FROM chunks GROUP BY game", "with_article"))
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = F.col("article") != ""
    return chunks(spark, sf_dir).groupBy("game").agg(F.count("*").alias("chunks"), F.count_if(has).alias("with_article"), F.countDistinct(F.when(has, F.concat_ws(" § ", F.nullif("part", F.lit("")), "article"))).alias("article_ids"), F.countDistinct(F.when(has, F.col("article"))).alias("articles"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.round(100 * F.count_if(has) / F.count("*"), 3).alias("pct"))


@query(as_long("""SELECT count(*) AS chunks, count(DISTINCT lang) AS books, count_if(lang = 'en' AND source = 'src0') AS amendments,
  left(sha256(CAST(sum(CAST('0x' || left(h, 12) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS VARCHAR)), 8) AS fingerprint FROM (SELECT sha256(doc_id || '|' || text) AS h, lang, source FROM documents)""", "amendments"))
def corpus_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, and a fingerprint of the content that row order does not change: a digest of sums over row digests."""
    r = table(spark, sf_dir, "documents").select(F.sha2(F.concat_ws("|", "doc_id", "text").cast("binary"), 256).alias("h"), "lang", "source")

    def total(at: int) -> Column:
        return F.sum(F.conv(F.substring("h", at, 12), 16, 10).cast("decimal(20,0)")).cast("string")

    digest = F.sha2(F.concat_ws(":", total(1), total(13)).cast("binary"), 256)
    return r.agg(F.count("*").alias("chunks"), F.countDistinct("lang").alias("books"), F.count_if((F.col("lang") == "en") & (F.col("source") == "src0")).alias("amendments"), F.substring(digest, 1, 8).alias("fingerprint"))


@query(rf"WITH {CHUNKS} SELECT game, min(game_title) AS title, count(*) AS n, string_agg(DISTINCT scope, ',' ORDER BY scope) AS scopes FROM chunks GROUP BY game")
def book_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).groupBy("game").agg(F.min("game_title").alias("title"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("scope")), ",").alias("scopes"))
    return c
