"""Crawled pages, document structure and gate verdicts over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import aliases as A
from quarry.operators import metrics as M
from quarry.operators import structure as S
from quarry.plans.corpus import CHUNKS, as_long, chunks, query, table
from quarry.plans.text_queries import text_lines
from quarry.sources import pages as G

_LINKS = r"""links AS (SELECT page_id, url, h[i] AS href, i - 1 AS pos FROM (SELECT page_id, url, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS h FROM pages)))"""


@query(rf"WITH {_LINKS} SELECT page_id, pos, href, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href AS target FROM links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.links(table(spark, sf_dir, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "target")


@query(rf"WITH {_LINKS} SELECT slug, arg_min(href, page_id * 1000000 + pos) AS href, min(page_id) AS page_id FROM (SELECT *, lower(regexp_extract(href, '^/([^/]+)/?$', 1)) AS slug FROM links) WHERE slug <> '' GROUP BY slug")
def title_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first_slugs(G.links(table(spark, sf_dir, "pages")), "^/([^/]+)/?$")


@query(as_long("SELECT count(*) AS pages, count_if(regexp_matches(lower(url), '\\.(html|pdf)([?#].*)?$')) AS documents, count_if(NOT regexp_matches(lower(url), '\\.(html|pdf)([?#].*)?$')) AS skipped FROM pages", "documents skipped"))
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = G.skip_reason(F.col("url"), F.col("html"))
    return table(spark, sf_dir, "pages").agg(F.count("*").alias("pages"), F.count_if(reason.isNull()).alias("documents"), F.count_if(reason.isNotNull()).alias("skipped"))


@query("SELECT DISTINCT source || '-' || lang AS name FROM documents WHERE source || '-' || lang NOT IN (SELECT source || '-' || lang FROM documents WHERE length(text) > 20000)")
def stale_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached names (source and language) that no long document refers to."""
    d = table(spark, sf_dir, "documents").withColumn("name", F.concat_ws("-", "source", "lang"))
    return G.orphans(d, d.where(F.length("text") > 20000))


_LINES = r"""lines AS (SELECT doc_id AS doc, line, line_no, (line_no - 1) // 20 + 1 AS page, (line_no - 1) % 20 AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)),
numbered AS (SELECT *, count(*) OVER (PARTITION BY doc, page) AS n_in_page, max(page) OVER (PARTITION BY doc) AS page_count FROM lines),
running AS (SELECT doc, lower(line) AS key FROM numbered WHERE pos < 3 OR n_in_page - 1 - pos < 3 GROUP BY doc, lower(line) HAVING count(DISTINCT page) >= greatest(4, max(page_count) // 2))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.split("text", "\n").alias("l"))
    i, n = F.col("i"), F.col("n")
    last = F.floor((n - 1) / 20)
    return d.select("doc", F.size("l").alias("n"), F.posexplode("l").alias("i", "text")).select("doc", (i + 1).alias("line_no"), (F.floor(i / 20) + 1).cast("int").alias("page"), (i % 20).alias("pos"), F.when(F.floor(i / 20) == last, n - last * 20).otherwise(20).alias("n_in_page"), (last + 1).alias("page_count"), "text")


#: What is put on the last line of some pages: two of it go, two only look like it.
_TRAPS = ["1234", "12345", "Rules ..... 5", "and . . . . so on … …"]


@query(rf"""WITH {_LINES.replace("numbered AS (SELECT *,", "numbered AS (SELECT * REPLACE (CASE WHEN pos = 19 AND page % 2 = 0 THEN " + str(_TRAPS) + "[(page // 2) % 4 + 1] ELSE line END AS line),")} SELECT doc, line_no FROM numbered WHERE NOT ((pos < 3 OR n_in_page - 1 - pos < 3) AND EXISTS (SELECT 1 FROM running r WHERE r.doc = numbered.doc AND r.key = lower(line)))
  AND NOT ((pos < 2 OR n_in_page - 1 - pos < 2) AND regexp_matches(line, '^\d{{1,4}}$')) AND NOT regexp_matches(line, '\.{{4,}}')""")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = F.array(*map(F.lit, _TRAPS))[(F.floor(F.col("page") / 2) % 4).cast("int")]
    lines = _lines(spark, sf_dir).withColumn("text", F.when((F.col("pos") == 19) & (F.col("page") % 2 == 0), trap).otherwise(F.col("text")))
    return S.strip_boilerplate(lines).select("doc", F.col("line_no").cast("long").alias("line_no"))


_SHAPED = """shaped AS (
  SELECT doc, line_no, page, line_no // 4 + 1 AS k, CASE WHEN line_no % 4 = 1 THEN (line_no - 1) // 4 % 4 END AS shape,
    CASE WHEN line_no % 4 <> 1 THEN line ELSE CASE (line_no - 1) // 4 % 4 WHEN 0 THEN k || '. Heading of part' WHEN 1 THEN k || '.1 (Optional) rules' WHEN 2 THEN k || ' (see above)' ELSE k || '. Purpose. Players behave well' END END AS t
  FROM lines
), trimmed AS (SELECT doc, line_no, page, k, shape <> 2 AND k <= 99 AS head, shape, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM shaped),
placed AS (SELECT *, sum(CAST(coalesce(head, false) AS INTEGER)) OVER (PARTITION BY doc ORDER BY line_no) - 1 AS ordinal FROM trimmed WHERE t <> '')"""


@query(rf"""WITH {_LINES}, {_SHAPED}
SELECT doc, CAST(ordinal AS INTEGER) AS ordinal, CASE min(shape) FILTER (head) WHEN 1 THEN min(k) FILTER (head) || '.1' ELSE CAST(min(k) FILTER (head) AS VARCHAR) END AS article,
  CASE min(shape) FILTER (head) WHEN 0 THEN 'Heading of part' WHEN 1 THEN '(Optional) rules' ELSE 'Purpose. Players behave well' END AS heading, '' AS part,
  CAST(coalesce(sum(length(t) + 1) FILTER (head IS NOT true) - 1, 0) AS INTEGER) AS n_chars, CAST(min(page) AS INTEGER) AS page, CAST(max(page) AS INTEGER) AS page_end
FROM placed GROUP BY doc, ordinal""")
def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each document; each fourth line is made a heading of one of three shapes, or an aside that is none, as the texts have no numbers."""

    def made(x: Column, i: Column) -> Column:
        k, shape = (F.floor((i + 1) / 4) + 1).cast("string"), F.floor(i / 4) % 4
        heading = F.when(shape == 0, F.concat(k, F.lit(". Heading of part"))).when(shape == 1, F.concat(k, F.lit(".1 (Optional) rules"))).when(shape == 2, F.concat(k, F.lit(" (see above)"))).otherwise(F.concat(k, F.lit(". Purpose. Players behave well")))
        return F.struct(F.when(i % 4 == 0, heading).otherwise(x["text"]).alias("text"), x["page"].alias("page"))

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.transform(S.paged_lines(F.col("text"), 20), made).alias("lines"))
    return S.segment(docs).select("doc", "ordinal", "article", "heading", "part", F.length("body").alias("n_chars"), "page", "page_end")


@query()
def split_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies in pieces of at most 1200 characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return S.split_bodies(d).select("doc_id", "chunk", F.length("piece").alias("n_chars"))


@query(rf"WITH {_LINES}, f AS (SELECT doc, line_no, length(line) < 200 AS short FROM lines), w AS (SELECT *, sum(CAST(NOT short AS INTEGER)) OVER (PARTITION BY doc ORDER BY line_no) AS island FROM f) SELECT doc, min(line_no) AS first, max(line_no) AS last, count(*) AS n FROM w WHERE short GROUP BY doc, island")
def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines shorter than 200 characters."""
    f = text_lines(spark, sf_dir).select(F.col("doc_id").alias("doc"), "line_no", (F.col("n") < 200).alias("short"))
    return S.islands(f, "doc", "line_no", "short")


_RUNS = "SELECT user_id AS case_id, event_type AS assertion, event_id % 3 AS run, bool_and(value < 190) AS passed FROM events GROUP BY ALL"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("assertion"), (F.col("event_id") % 3).alias("run")).agg(F.bool_and(F.col("value") < 190).alias("passed"))


@query(f"SELECT case_id, assertion, round(avg(CAST(passed AS INTEGER)), 6) AS rate, bool_and(passed) AS all_passed, CASE WHEN avg(CAST(passed AS INTEGER)) = 1 THEN 'stable' WHEN avg(CAST(passed AS INTEGER)) = 0 THEN 'always_fail' ELSE 'unstable' END AS state FROM ({_RUNS}) GROUP BY case_id, assertion")
def gate_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stability(_runs(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(r"""WITH v AS (SELECT * FROM (VALUES ('the', ['the', 'of']), ('from', ['from', 'the', 'of']), ('und', ['und', 'der'])) t(slug, v)), t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
h AS (SELECT doc_id, slug, v FROM t, v WHERE list_has_all(w, v))
SELECT doc_id, slug FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id = h.doc_id AND o.slug <> h.slug AND len(o.v) > len(h.v) AND list_has_all(o.v, h.v))""")
def named_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose name's words a text holds; a name within a longer matched name goes."""
    variants = spark.createDataFrame([("the", ["the", "of"]), ("from", ["from", "the", "of"]), ("und", ["und", "der"])], "slug string, words array<string>")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0).alias("words"))
    return A.named_titles(texts, variants).withColumnRenamed("id", "doc_id")
