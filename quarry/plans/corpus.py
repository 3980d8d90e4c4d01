"""The test tables in the roles of the engine: chunks, questions, vectors, turns and usage.

``documents`` are chunks: English books are the global rulebook (those of
``src0`` its amendments), other languages are title books; article, page, part
and heading follow from the id and the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that checks it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def as_long(sql: str, columns: str) -> str:
    """The SQL with these columns (sums, which DuckDB widens) as 64-bit integers, as Spark has them."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in columns.split())}) FROM ({sql})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    en = F.col("lang") == "en"
    number = F.concat_ws(".", (i % 9 + 1).cast("string"), (i % 7 + 1).cast("string"), F.when(i % 3 == 0, (i % 4 + 1).cast("string")))
    return d.select(
        i.alias("chunk_id"),
        F.when(en, "global").otherwise(F.col("lang")).alias("game"),
        F.when(en, "Global Book").otherwise(F.concat(F.lit("Book "), F.upper("lang"))).alias("game_title"),
        F.when(~en, "title").when(F.col("source") == "src0", "amendment").otherwise("global").alias("scope"),
        F.when(~en, 1).when(F.col("source") == "src0", 2).otherwise(0).alias("authority"),
        F.when(i % 11 == 0, "").otherwise(number).alias("article"),
        (i % 40 + 1).cast("int").alias("page"),
        F.when(i % 13 == 0, "Appendix I").otherwise("").alias("part"),
        F.regexp_extract("text", r"^([^ \n]+ [^ \n]+ [^ \n]+)", 1).alias("heading"),
        "text",
    )


CHUNKS = r"""chunks AS (
  SELECT doc_id AS chunk_id, CASE WHEN lang = 'en' THEN 'global' ELSE lang END AS game,
    CASE WHEN lang = 'en' THEN 'Global Book' ELSE 'Book ' || upper(lang) END AS game_title,
    CASE WHEN lang <> 'en' THEN 'title' WHEN source = 'src0' THEN 'amendment' ELSE 'global' END AS scope,
    CASE WHEN lang <> 'en' THEN 1 WHEN source = 'src0' THEN 2 ELSE 0 END AS authority,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat_ws('.', doc_id % 9 + 1, doc_id % 7 + 1, CASE WHEN doc_id % 3 = 0 THEN doc_id % 4 + 1 END) END AS article,
    CAST(doc_id % 40 + 1 AS INTEGER) AS page, CASE WHEN doc_id % 13 = 0 THEN 'Appendix I' ELSE '' END AS part,
    regexp_extract(text, '^([^ \n]+ [^ \n]+ [^ \n]+)', 1) AS heading, text
  FROM documents
)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` items as questions; four in five are scoped to a game."""
    b, i = table(spark, sf_dir, "benchmark"), F.col("item_id")
    game = F.when(i % 5 == 1, "de").when(i % 5 == 2, "fr").when(i % 5 == 3, "es").when(i % 5 == 4, "global")
    return b.select(i.alias("query_id"), F.col("text").alias("question"), game.alias("game"))


QUESTIONS = r"""questions AS (
  SELECT item_id AS query_id, text AS question,
    CASE item_id % 5 WHEN 1 THEN 'de' WHEN 2 THEN 'fr' WHEN 3 THEN 'es' WHEN 4 THEN 'global' END AS game
  FROM benchmark
)"""


@cache
def stop_list() -> str:
    from quarry.functions.fixed import STOPWORDS

    return "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def sql_content(text: str) -> str:
    """DuckDB expression for the content words of ``text``."""
    return rf"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+(?:\.[a-z0-9]+)*'), lambda w: length(w) > 1 AND NOT list_contains({stop_list()}, w))"


def sql_tokens(text: str) -> str:
    return rf"""flatten(list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+(?:[.\-][a-z0-9]+)*'), lambda t:
      list_concat([t], list_transform(range(2, len(string_split(t, '.'))), lambda n: array_to_string(string_split(t, '.')[1:n], '.')))))"""


def sql_shingles(words: str, n: int = 3) -> str:
    return f"list_distinct(list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string(({words})[i:i + {n - 1}], ' ')))"
