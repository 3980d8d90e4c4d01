"""Retrieval over the test tables: pools, BM25, vectors, fusion, evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import fixed as X
from quarry.functions import text as T
from quarry.operators import lexical as L
from quarry.operators import metrics as M
from quarry.operators import retrieval as R
from quarry.operators import vectors as V
from quarry.plans.corpus import CHUNKS, QUESTIONS, chunks, query, questions, sql_content, sql_tokens, table
from quarry.sources import store

_PART = "CASE WHEN scope = 'global' OR (scope = 'amendment' AND game = 'global') THEN '' WHEN scope = 'title' THEN game END"

BM25 = rf"""{CHUNKS}, {QUESTIONS},
counted AS (SELECT chunk_id, part, t, len(t) AS dl FROM (SELECT chunk_id, {_PART} AS part, {sql_tokens('text')} AS t FROM chunks) WHERE part IS NOT NULL),
asked AS (SELECT query_id, pool, term, count(*) AS qtf FROM (SELECT query_id, CASE WHEN coalesce(game, 'global') = 'global' THEN '' ELSE game END AS pool, unnest({sql_tokens('question')}) AS term FROM questions) GROUP BY ALL),
member AS (SELECT pool, counted.* FROM counted, (SELECT DISTINCT pool FROM asked) WHERE part = '' OR part = pool),
sizes AS (SELECT pool, count(*) AS n, sum(dl) / count(*) AS avgdl FROM member GROUP BY pool),
weighted AS (SELECT pool, term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT pool, term, count(*) AS df FROM (SELECT pool, unnest(list_distinct(t)) AS term FROM member) GROUP BY ALL) JOIN sizes USING (pool)),
mean AS (SELECT pool, avg(idf) AS mean FROM weighted GROUP BY pool),
postings AS (SELECT chunk_id, part, dl, term, count(*) AS tf FROM (SELECT chunk_id, part, dl, unnest(t) AS term FROM counted) GROUP BY ALL),
lex_all AS (SELECT query_id, chunk_id, round(sum(qtf * CASE WHEN idf < 0 THEN {X.BM25_EPSILON} * mean ELSE idf END * tf * ({X.BM25_K1} + 1) / (tf + {X.BM25_K1} * (1 - {X.BM25_B} + {X.BM25_B} * dl / avgdl))), 6) AS score
  FROM asked JOIN weighted USING (pool, term) JOIN mean USING (pool) JOIN sizes USING (pool) JOIN postings USING (term) WHERE part = '' OR part = pool GROUP BY ALL),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS lex_rank FROM lex_all) WHERE lex_rank <= {X.LEXICAL_K})"""

DENSE = rf"""vectors AS (SELECT vec_id AS chunk_id, {_PART} AS part, embedding FROM embeddings JOIN chunks ON vec_id = chunk_id),
asked_v AS (SELECT query_id, CASE WHEN coalesce(game, 'global') = 'global' THEN '' ELSE game END AS pool, embedding AS qv FROM questions JOIN embeddings ON vec_id = query_id),
near AS (SELECT * FROM (SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS dense_rank FROM (
  SELECT query_id, chunk_id, round(list_distance(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS distance FROM asked_v, vectors WHERE part = '' OR part = pool)) WHERE dense_rank <= {X.DENSE_K})"""

EVIDENCE = rf"""{BM25}, {DENSE},
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rel_rank FROM (
  SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / ({X.RRF_K} + rank)), 9) AS score FROM (SELECT query_id, chunk_id, lex_rank AS rank FROM lexical UNION ALL SELECT query_id, chunk_id, dense_rank FROM near) GROUP BY ALL)),
evidence AS (SELECT fused.*, chunks.* EXCLUDE (chunk_id), row_number() OVER (PARTITION BY query_id ORDER BY authority DESC, rel_rank) AS read_pos FROM fused JOIN chunks USING (chunk_id) WHERE rel_rank <= {X.FUSED_K})"""


@query(rf"WITH {CHUNKS}, {QUESTIONS} SELECT query_id, count(*) AS n_chunks, count(DISTINCT chunks.game) AS n_games FROM questions, chunks WHERE CASE WHEN questions.game IS NULL THEN scope IN ('global', 'amendment') ELSE chunks.game = questions.game OR scope = 'global' OR (scope = 'amendment' AND chunks.game = 'global') END GROUP BY query_id")
def scope_pool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each question's pool, from counts per part of the corpus."""
    parts = chunks(spark, sf_dir).groupBy(L.part_of(F.col("scope"), F.col("game")).alias("part"), F.col("game").alias("g")).agg(F.count("*").alias("n"))
    q = questions(spark, sf_dir).select("query_id", F.explode(F.array_distinct(F.array(F.lit(""), F.when(F.coalesce("game", F.lit("global")) == "global", "").otherwise(F.col("game"))))).alias("part"))
    return q.join(parts, "part").groupBy("query_id").agg(F.sum("n").alias("n_chunks"), F.countDistinct("g").alias("n_games"))


@query(rf"WITH {CHUNKS} SELECT chunk_id, game = 'de' OR scope = 'global' OR (scope = 'amendment' AND game = 'global') AS for_game, scope IN ('global', 'amendment') AS for_none FROM chunks")
def filter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter documents compiled to predicates."""
    row = {"game": F.col("game"), "scope": F.col("scope")}
    return chunks(spark, sf_dir).select("chunk_id", R.matches_filter(row, R.scope_filter("de")).alias("for_game"), R.matches_filter(row, R.scope_filter(None)).alias("for_none"))


@query(rf"""SELECT word, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)), 6) AS idf
FROM (SELECT unnest(list_distinct({sql_content('text')})) AS word FROM documents) GROUP BY word""")
def doc_frequency_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = d.count()
    df = d.select(F.explode(F.array_distinct(T.content_words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.round(F.log((n + 1) / (F.col("df") + 1)), 6))


def lexical_index(spark: SparkSession, sf_dir: str) -> L.Index:
    """The inverted index of the chunks, written once a session."""
    return store.once("lexical", [table(spark, sf_dir, "documents")], lambda: L.build(chunks(spark, sf_dir)))


@query(f"WITH {BM25} SELECT query_id, chunk_id, lex_rank, round(score, 4) AS score FROM lexical")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.search(lexical_index(spark, sf_dir), questions(spark, sf_dir)).best.select("query_id", "chunk_id", F.col("lex_rank").cast("long").alias("lex_rank"), F.round("score", 4).alias("score"))


def _dense(spark: SparkSession, sf_dir: str, questions: DataFrame) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    c = chunks(spark, sf_dir).select("chunk_id", L.part_of(F.col("scope"), F.col("game")).alias("part"))
    vectors = e.select(F.col("vec_id").alias("chunk_id"), "embedding").join(c, "chunk_id").where("part is not null")
    asked = questions.join(e.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    return R.dense(vectors, asked)


@query(f"WITH {CHUNKS}, {QUESTIONS}, {DENSE} SELECT query_id, chunk_id, dense_rank, distance FROM near")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, questions(spark, sf_dir)).select("query_id", "chunk_id", F.col("dense_rank").cast("long").alias("dense_rank"), "distance")


@query()
def inverted_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 100 against all, by the inverted file; each row has the recall at 12 of all questions against the exact scan.

    No SQL: which neighbours an approximate search misses is no matter of SQL; tests hold it against the exact scan.
    """
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("").alias("part"), "embedding")
    asked = vectors.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.lit(None).cast("string").alias("game"), "embedding")
    index = store.once("vectors", [table(spark, sf_dir, "embeddings")], lambda: V.build(vectors))
    found = store.written(V.search(index, asked), "near")
    measured = V.recall(found, R.dense(vectors, asked)).select("recall", F.lit(1).alias("one"))
    out = found.select("query_id", "chunk_id", F.col("dense_rank").cast("long").alias("dense_rank"), "distance", "compared", "refined", F.lit(1).alias("one"))
    return out.join(measured, "one").drop("one")


def inputs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The tables that evidence is made from."""
    return [table(spark, sf_dir, t) for t in ("documents", "benchmark", "embeddings")]


def retriever(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """Questions (query_id, question, game) to their evidence: both rankings of each one's pool, fused."""

    def retrieve(asked: DataFrame) -> DataFrame:
        return R.hybrid(L.search(lexical_index(spark, sf_dir), asked).best, _dense(spark, sf_dir, asked), chunks(spark, sf_dir))

    return retrieve


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rows a question.  The first query of a session that needs them writes them as a table, which the others read."""
    return store.once("evidence", inputs(spark, sf_dir), lambda: retriever(spark, sf_dir)(questions(spark, sf_dir)))


@query(f"WITH {EVIDENCE} SELECT query_id, chunk_id, rel_rank, read_pos, round(score, 6) AS score FROM evidence")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("query_id", "chunk_id", F.col("rel_rank").cast("long").alias("rel_rank"), F.col("read_pos").cast("long").alias("read_pos"), F.round("score", 6).alias("score"))


@query(f"WITH {EVIDENCE} SELECT query_id, bool_or(rel_rank <> read_pos) AS differ, count(DISTINCT authority) > 1 AS mixed FROM evidence GROUP BY query_id")
def orders_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).groupBy("query_id").agg(F.bool_or(F.col("rel_rank") != F.col("read_pos")).alias("differ"), (F.countDistinct("authority") > 1).alias("mixed"))


@query(f"WITH {EVIDENCE} SELECT query_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY chunk_id) AS accountable FROM evidence WHERE rel_rank <= {X.ACCOUNTABLE_RANK} GROUP BY query_id")
def accountable_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = evidence(spark, sf_dir).where(F.coalesce("rel_rank", F.lit(X.MISSING_RANK)) <= X.ACCOUNTABLE_RANK)
    return near.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("chunk_id")), lambda x: x.cast("string")), ",").alias("accountable"))


@query(f"WITH {EVIDENCE} SELECT query_id, game_title, count(*) AS n, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, game_title) AS place FROM evidence GROUP BY query_id, game_title")
def books_in_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = evidence(spark, sf_dir).groupBy("query_id", "game_title").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("n"), "game_title")).cast("long"))


@query(f"WITH {EVIDENCE} SELECT query_id, game, scope, count(*) AS n, row_number() OVER (PARTITION BY query_id ORDER BY max(authority) DESC, min(game_title), scope) AS place FROM evidence GROUP BY query_id, game, scope")
def scope_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = evidence(spark, sf_dir).groupBy("query_id", "game", "scope").agg(F.count("*").alias("n"), F.max("authority").alias("a"), F.min("game_title").alias("t"))
    return n.select("query_id", "game", "scope", "n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("a"), "t", "scope")).cast("long").alias("place"))


@query(rf"""WITH {EVIDENCE} SELECT query_id, string_agg('[' || read_pos || '] ' || game_title || CASE WHEN article <> '' THEN ' Article ' || article ELSE '' END || ' p.' || page, chr(10) ORDER BY read_pos) AS index_lines FROM evidence GROUP BY query_id""")
def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("["), "read_pos", F.lit("] "), "game_title", F.when(F.col("article") != "", F.concat(F.lit(" Article "), "article")).otherwise(""), F.lit(" p."), "page")
    rows = evidence(spark, sf_dir).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("read_pos", line.alias("line")))).alias("l"))
    return rows.select("query_id", F.array_join(F.col("l.line"), "\n").alias("index_lines"))


@query(rf"""WITH {EVIDENCE} SELECT query_id, md5(string_agg('[' || read_pos || '] ' || CASE authority WHEN 2 THEN 'AMENDMENT' WHEN 1 THEN 'TITLE' ELSE 'GLOBAL' END || ' | ' || game_title || ' | part=' || coalesce(nullif(part, ''), '(none)') || ' | article=' || coalesce(nullif(article, ''), 'unstated') || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY read_pos)) AS rendered_md5 FROM evidence GROUP BY query_id""")
def render_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("authority") == 2, "AMENDMENT").when(F.col("authority") == 1, "TITLE").otherwise("GLOBAL")
    block = F.concat(F.lit("["), "read_pos", F.lit("] "), tier, F.lit(" | "), "game_title", F.lit(" | part="), F.coalesce(F.nullif("part", F.lit("")), F.lit("(none)")), F.lit(" | article="), F.coalesce(F.nullif("article", F.lit("")), F.lit("unstated")), F.lit("\n"), "text")
    rows = evidence(spark, sf_dir).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("read_pos", block.alias("b")))).alias("l"))
    return rows.select("query_id", F.md5(F.array_join(F.col("l.b"), "\n---\n").cast("binary")).alias("rendered_md5"))


@query(f"WITH {EVIDENCE} SELECT query_id, chunk_id, CAST({X.FUSED_K} - rel_rank + 1 AS DOUBLE) AS run_score FROM evidence")
def run_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("query_id", "chunk_id", (X.FUSED_K - F.col("rel_rank") + 1).cast("double").alias("run_score"))


@query(f"""WITH {EVIDENCE}, x AS (SELECT query_id, max(CAST(e.game NOT IN (q.game, 'global') OR (query_id % 3 = 0 AND e.game = 'global') AS INTEGER)) AS leaks FROM questions q LEFT JOIN evidence e USING (query_id) WHERE q.game IS NOT NULL GROUP BY query_id)
SELECT count(*) AS cases, count_if(coalesce(leaks, 0) = 1)::BIGINT AS leaking, coalesce(round(avg(coalesce(leaks, 0)), 6), 0) AS rate FROM x""")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the scoped questions whose evidence has a book outside their scope; each third question excludes the global book, so the rate is not 0."""
    q = questions(spark, sf_dir).withColumn("excluded", F.when(F.col("query_id") % 3 == 0, F.array(F.lit("global"))))
    return M.leakage_rate(evidence(spark, sf_dir), q)


@query(f"""WITH {EVIDENCE}, p AS (SELECT query_id, list(DISTINCT scope) AS s FROM evidence GROUP BY query_id), x AS (SELECT list_has_all(CASE WHEN query_id % 2 = 0 THEN ['global', 'title', 'amendment'] ELSE ['global', 'title'] END, s) AS pure FROM p)
SELECT count(*) AS pools, count_if(pure)::BIGINT AS pure, round(avg(pure::INTEGER), 6) AS rate FROM x""")
def scope_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the pools all of whose scopes are permitted; odd questions permit no amendments."""
    scopes = F.when(F.col("query_id") % 2 == 0, F.array(*map(F.lit, ("global", "title", "amendment")))).otherwise(F.array(F.lit("global"), F.lit("title")))
    return M.scope_purity(evidence(spark, sf_dir), questions(spark, sf_dir).select("query_id", scopes.alias("scopes")))
