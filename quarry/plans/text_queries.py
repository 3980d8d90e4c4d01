"""Text, citation, date and URL functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fixed as X
from quarry.functions import text as T
from quarry.operators import metrics as M
from quarry.plans.corpus import CHUNKS, chunks, query, sql_content, sql_shingles, sql_tokens, table


@query(f"""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, {sql_tokens("text || ' Article ' || (doc_id % 9) || '.' || (doc_id % 7) || '.' || (doc_id % 5) || '-b'")} AS t FROM documents)""")
def tokenize_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    text = F.concat("text", F.lit(" Article "), i % 9, F.lit("."), i % 7, F.lit("."), i % 5, F.lit("-b"))
    return d.select("doc_id", T.tokens(text).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(f"SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, {sql_content('text')} AS w FROM documents)")
def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.content_words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ").cast("binary")).alias("words_md5"))


@query(f"""SELECT doc_id, len(s) AS n_shingles, coalesce(list_min(s), '') AS first_shingle
FROM (SELECT doc_id, {sql_shingles('w')} AS s FROM (SELECT doc_id, {sql_content('text')} AS w FROM documents))""")
def token_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.shingles(T.content_words(F.col("text"))).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_shingles"), F.coalesce(F.array_min("s"), F.lit("")).alias("first_shingle"))


@query(r"""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_eval_words,
  len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains(['the', 'of', 'and', 'book', 'rulebook', 'official', 'rules', 'game'], w)))) AS n_title_words FROM documents""")
def word_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation tokenizer (dots part words) and the title tokenizer (a set without generic words)."""
    generic = F.array(*map(F.lit, ("the", "of", "and", "book", "rulebook", "official", "rules", "game")))
    w = T.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_eval_words"), F.size(F.array_except(F.array_distinct(w), generic)).cast("long").alias("n_title_words"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(replace(replace(text, chr(8203), ''), chr(160), ' '), ' {2,}', ' ', 'g'), ' ')) AS tidy_md5,
  md5(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS flat_md5, length(text) AS n FROM documents""")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.tidy(T.strip_invisible(t)).cast("binary")).alias("tidy_md5"), F.md5(T.flat(t).cast("binary")).alias("flat_md5"), F.length(t).cast("long").alias("n"))


@query(r"""SELECT doc_id, len(s) AS n_sentences, s[1] AS first_sentence FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x, ' ') <> '') AS s FROM documents)""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.get("s", F.lit(0)).alias("first_sentence"))


@query(r"""SELECT doc_id, regexp_replace(regexp_extract(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), '^.*?(?:[.!?]\s|$)'), '\s$', '') AS lead FROM documents""")
def lead_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.lead(F.col("text")).alias("lead"))


_ANSWER = r"""answers AS (
  SELECT chunk_id, 'As held (' || game_title || ' - Article ' || article || ', p. ' || page || '; see below) and again (' || game_title || ' — p.' || (page + 1) || ').' AS answer,
    game_title, article, page FROM chunks
)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    text = F.concat(F.lit("As held ("), "game_title", F.lit(" - Article "), "article", F.lit(", p. "), "page", F.lit("; see below) and again ("), "game_title", F.lit(" — p."), F.col("page") + 1, F.lit(")."))
    return c.select("chunk_id", text.alias("answer"), "game_title", "article", "page")


@query(rf"""WITH {CHUNKS}, {_ANSWER}
SELECT chunk_id, CASE WHEN article <> '' THEN game_title || ' — Article ' || article || ', p.' || page || '|' ELSE '' END || game_title || ' — p.' || (page + 1) AS locators FROM answers""")
def citations_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in generated answers; the aside between them is none, nor is one with an empty article."""
    return _answers(spark, sf_dir).select("chunk_id", F.array_join(T.cited_locators(F.col("answer")), "|").alias("locators"))


@query(rf"""WITH {CHUNKS}, {_ANSWER}
SELECT chunk_id, game_title || ' — p.' || (page + 1) AS unsupported FROM answers""")
def citations_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array(T.locator(T.citation(F.col("game_title"), F.col("article"), F.col("page"))))
    return _answers(spark, sf_dir).select("chunk_id", F.array_join(T.unsupported(F.col("answer"), allowed), "|").alias("unsupported"))


@query(rf"""WITH {CHUNKS} SELECT chunk_id,
  CASE WHEN article <> '' THEN '(' || game_title || ' — Article ' || article || ', p.' || page || ')' ELSE '(' || game_title || ' — p.' || page || ')' END AS citation,
  CASE WHEN article <> '' THEN game_title || ' (Article ' || article || ', p.' || page || ')' ELSE game_title || ' (p.' || page || ')' END AS cite,
  '[' || game_title || CASE WHEN article <> '' THEN ' · Article ' || CASE WHEN part <> '' THEN part || ' § ' ELSE '' END || article || CASE WHEN heading <> '' THEN ' — ' || heading ELSE '' END WHEN heading <> '' THEN ' · ' || heading ELSE '' END || ']' AS label
FROM chunks""")
def citation_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return chunks(spark, sf_dir).select("chunk_id", T.citation(c("game_title"), c("article"), c("page")).alias("citation"), T.finding_cite(c("game_title"), c("article"), c("page")).alias("cite"), T.context_label(c("game_title"), c("article"), c("heading"), c("part")).alias("label"))


@query(rf"""WITH {CHUNKS}, {_ANSWER}
SELECT chunk_id, game_title AS book, CASE WHEN article <> '' THEN article END AS cited_article, CASE WHEN article <> '' THEN page ELSE page + 1 END AS cited_page FROM answers""")
def citation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book, article and page of the first citation."""
    first = F.get(T.cited_locators(F.col("answer")), F.lit(0))
    article = F.regexp_extract(first, r"— Article (\S+?), p", 1)
    return _answers(spark, sf_dir).select("chunk_id", F.regexp_extract(first, r"^(.+?) — ", 1).alias("book"), F.when(article != "", article).alias("cited_article"), F.regexp_extract(first, r"p\.(\d+)$", 1).cast("int").alias("cited_page"))


@query(rf"""WITH {CHUNKS} SELECT chunk_id, CASE WHEN position('.' IN article) > 0 THEN regexp_replace(article, '\.[^.]*$', '') END AS parent,
  row_number() OVER (ORDER BY list_transform(string_split(nullif(article, ''), '.'), lambda x: CAST(x AS INTEGER)) NULLS FIRST, chunk_id) AS place FROM chunks""")
def article_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents, and the place of each chunk in the numeric order of articles; ranges of the order are sorted each for itself."""
    c = chunks(spark, sf_dir).select("chunk_id", "article")
    placed = M.ordinals(c, [T.article_key(F.col("article")), F.col("chunk_id")], "place")
    return placed.select("chunk_id", T.article_parent(F.col("article")).alias("parent"), "place")


#: What is no date or a strange one, with the day-first reading of it.
_ODD_DATES = {"soon": None, "45 March 2026": "2026-03-45", "2026-02-31": "2026-02-31", "2026-01-05 or later": None, "5 March 2026 at noon": None, " 5 Mar. 2026. ": "2026-03-05", "5 Marchtowards 2026": None, "5 Smarch 2026": None}
_MONTH_FIRST = len(_ODD_DATES) + 3


def _date_case(of: str) -> str:
    return f"CASE event_id % {_MONTH_FIRST + 1} " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else repr(v)}" for k, v in enumerate(_ODD_DATES if of == "raw" else _ODD_DATES.values(), 3))


@query(f"""SELECT event_id, {_date_case("read")} WHEN {_MONTH_FIRST} THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day_first, CASE WHEN event_id % {_MONTH_FIRST + 1} = {_MONTH_FIRST} THEN strftime(ts, '%Y-%m-%d') END AS month_first FROM events""")
def dates_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of the events in three spellings, month-first ones, and texts that are no dates or strange ones."""
    e, k, ts = table(spark, sf_dir, "events"), F.col("event_id") % (_MONTH_FIRST + 1), F.col("ts")
    month, day, year = F.date_format(ts, "MMMM"), F.dayofmonth(ts).cast("string"), F.year(ts).cast("string")
    raw = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd")).when(k == 1, F.concat_ws(" ", day, month, year)).when(k == 2, F.concat_ws(" ", day, F.substring(month, 1, 4), year)).when(k == _MONTH_FIRST, F.concat(month, F.lit(" "), day, F.lit(", "), year))
    for i, odd in enumerate(_ODD_DATES, 3):
        raw = raw.when(k == i, odd)
    return e.select("event_id", raw.alias("raw")).select("event_id", T.normalise_date(F.col("raw")).alias("day_first"), T.month_first_date(F.when(k == _MONTH_FIRST, F.col("raw"))).alias("month_first"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '\.[^.]*$', '') AS stem FROM pages)
SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, regexp_matches(lower(url), '\.pdf$') AS is_pdf, regexp_matches(lower(regexp_extract(url, '://([^/?#]+)', 1)), '(^|\.)example\.(org|com)$') AS official,
  CASE WHEN regexp_matches(stem, '^[0-9a-fA-F]{8,}$') THEN stem ELSE 'u' || left(sha1(url), 16) END AS content_key FROM p""")
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(F.parse_url("url", F.lit("HOST")))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.lower("url").rlike(r"\.pdf$").alias("is_pdf"), host.rlike(r"(^|\.)example\.(org|com)$").alias("official"), T.url_content_hash(F.col("url")).alias("content_key"))


@query(r"""SELECT doc_id, sha256(text) AS digest, left(text, 5) = '%PDF-' AS is_pdf, octet_length(encode(text)) AS size FROM documents""")
def binary_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, magic number and size of a file's bytes."""
    b = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(b, 256).alias("digest"), (F.substring("text", 1, 5) == "%PDF-").alias("is_pdf"), F.octet_length(b).cast("long").alias("size"))


@query(r"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM s)
SELECT doc_id, line_no, (line_no - 1) // 20 + 1 AS page, (line_no - 1) % 20 AS pos_in_page, count(*) OVER (PARTITION BY doc_id, (line_no - 1) // 20) AS n_in_page, length(line) AS n FROM b""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their page (20 lines a page), place in it and its number of lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    pages = F.floor((F.size("l") - 1) / 20)
    i = F.col("i")
    return d.select("doc_id", F.size("l").alias("lines"), pages.alias("last"), F.posexplode("l").alias("i", "line")).select(
        "doc_id", (i + 1).cast("long").alias("line_no"), (F.floor(i / 20) + 1).alias("page"), (i % 20).cast("long").alias("pos_in_page"),
        F.when(F.floor(i / 20) == F.col("last"), F.col("lines") - F.col("last") * 20).otherwise(20).cast("long").alias("n_in_page"), F.length("line").cast("long").alias("n"))


@query(r"""SELECT doc_id, CASE WHEN left(t, 1) = '[' AND position(chr(10) IN t) > 0 THEN substr(t, position(chr(10) IN t) + 1) ELSE t END AS body_text, length(t) AS n
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[Label]' || chr(10) || text ELSE text END AS t FROM documents)""")
def body_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("[Label]\n"), "text")).otherwise(F.col("text")).alias("t"))
    return d.select("doc_id", T.body_text(F.col("t")).alias("body_text"), F.length("t").cast("long").alias("n"))


@query(rf"""SELECT doc_id, regexp_matches(text, '(?i){X.RESTATES}') AS restates, regexp_matches(text, '(?i)licen[cs]ed? under') AS licensed FROM documents""")
def pattern_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.rlike(f"(?i){X.RESTATES}").alias("restates"), t.rlike("(?i)licen[cs]ed? under").alias("licensed"))
