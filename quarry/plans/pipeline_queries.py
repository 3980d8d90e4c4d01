"""The question pipeline, written tables and reports over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import fixed as X
from quarry.functions import text as T
from quarry.operators import amendments as N
from quarry.plans import ask
from quarry.plans.corpus import CHUNKS, QUESTIONS, as_long, chunks, query, questions, sql_content, table
from quarry.plans.retrieval_queries import EVIDENCE, evidence
from quarry.plans.text_queries import _ANSWER, _answers
from quarry.sources import digest_tree, store, versions


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select(F.col("game").alias("slug")).distinct()


@query(rf"WITH {CHUNKS}, {QUESTIONS}, w AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+'))) AS slug FROM questions WHERE game IS NULL), h AS (SELECT query_id, min(slug) AS slug FROM w WHERE slug IN (SELECT game FROM chunks) GROUP BY query_id HAVING count(*) = 1) SELECT query_id, coalesce(game, slug) AS routed FROM questions LEFT JOIN h USING (query_id)")
def router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.route(questions(spark, sf_dir), _catalog(spark, sf_dir)).select("query_id", F.col("game").alias("routed"))


@query(rf"WITH {EVIDENCE} SELECT query_id, string_agg('[' || read_pos || '] ' || game_title || ' Article ' || coalesce(nullif(article, ''), '-'), '; ' ORDER BY read_pos) AS note FROM evidence WHERE rel_rank <= {X.ACCOUNTABLE_RANK} GROUP BY query_id")
def coverage_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.coverage_note(evidence(spark, sf_dir))


@query(rf"WITH {CHUNKS} SELECT scope, count(*) AS n, 0 AS differing FROM chunks GROUP BY scope")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks stored for both rankers, and the rows that differ from what was sent."""
    c = chunks(spark, sf_dir).select("chunk_id", "game", "scope", "article")
    stored = versions.build(c, store.work_path(spark, "index"))
    differing = store.differences(c, stored).groupBy("scope").agg(F.count("*").alias("d"))
    return stored.groupBy("scope").agg(F.count("*").alias("n")).join(differing, "scope", "left").select("scope", "n", F.coalesce("d", F.lit(0)).cast("int").alias("differing"))


@query("""SELECT doc_id, 'left' AS side FROM documents WHERE doc_id % 97 = 0 OR doc_id % 101 = 5 UNION ALL SELECT doc_id, 'right' FROM documents WHERE doc_id % 97 = 0 AND doc_id % 101 <> 5 UNION ALL SELECT max(doc_id) + 1, 'right' FROM documents""")
def corpus_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and an edited copy, compared from the roots of their trees: some texts changed, some gone, one new."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    new = d.agg((F.max("doc_id") + 1).alias("doc_id")).select("doc_id", F.lit("new").alias("text"), F.lit("en").alias("lang"))
    edited = d.where("doc_id % 101 <> 5").withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).unionByName(new)
    a, b = store.work_path(spark, "corpus"), store.work_path(spark, "corpus")
    digest_tree.write(d, "doc_id", a)
    digest_tree.write(edited, "doc_id", b)
    return digest_tree.differences(spark, a, b, d.schema).select("doc_id", "side")


def _built(c: DataFrame, path: str) -> str:
    versions.build(c, path)
    return path


@query(rf"WITH {CHUNKS} SELECT chunk_id, page, md5(text) AS text_md5 FROM chunks WHERE game = 'global' AND article = '2.2'")
def chunk_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of one article, from the files of the stored index that may hold it."""
    path = store.once("index", [table(spark, sf_dir, "documents")], lambda: _built(chunks(spark, sf_dir), store.work_path(spark, "index")))
    return versions.lookup(spark, path, game="global", article="2.2").select("chunk_id", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(rf"""WITH {QUESTIONS} SELECT query_id, game, quality = 1 AS answerable, CASE WHEN quality IS NULL THEN 'unlabelled' ELSE 'labelled' END AS bucket FROM questions LEFT JOIN labels ON query_id = doc_id""")
def case_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), "quality")
    return questions(spark, sf_dir).join(labels, "query_id", "left").select("query_id", "game", (F.col("quality") == 1).alias("answerable"), F.when(F.col("quality").isNull(), "unlabelled").otherwise("labelled").alias("bucket"))


@query()
def amendment_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and books that notices aim at; text windows, so checked by unit tests."""
    text = F.concat("text", F.lit(". Article 5.1 of the Book "), F.upper("lang"), F.lit(" now reads otherwise."))
    notices = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("notice_id"), text.alias("text"))
    books = [(g, ["book", g]) for g in ("de", "en", "es", "fr")]
    return N.amendment_targets(notices, books)


