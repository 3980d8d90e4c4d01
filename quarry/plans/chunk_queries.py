"""Sources, document structure and chunks over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import fixed as X
from quarry.functions import text as T
from quarry.operators import aliases as A
from quarry.operators import amendments as N
from quarry.operators import metrics as M
from quarry.operators import records as R
from quarry.operators import structure as S
from quarry.plans.corpus import CHUNKS, as_long, chunks, query, table
from quarry.plans.source_queries import _LINES, _lines
from quarry.sources import pages as G
from quarry.sources import store

#: Ten documents make one book, each 900 characters of a text a segment; numbers repeat in it and lie under each other.
_SEGS = r"""segs AS (SELECT doc_id // 10 AS doc, CAST(doc_id % 10 * 100000 + k AS INTEGER) AS ordinal, CASE WHEN doc_id % 10 = 0 THEN '' ELSE ['2', '2.1', '2.1.3', '4'][doc_id % 4 + 1] END AS article,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'Heading ' || doc_id END AS heading, CASE WHEN doc_id % 10 >= 8 THEN 'Appendix I' ELSE '' END AS part, CASE WHEN doc_id % 3 = 0 THEN '  short ' ELSE substr(text, k * 900 + 1, 900) END AS body, CAST(doc_id % 40 + 1 AS INTEGER) AS page FROM (SELECT *, unnest(range(0, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE greatest((length(text) - 1) // 900, 0) END + 1)) AS k FROM documents)),
sized AS (SELECT *, length(regexp_replace(body, '^\s+|\s+$', '', 'g')) < 20 AS thin FROM segs),
stored AS (SELECT * FROM sized s WHERE NOT thin OR (article <> '' AND NOT EXISTS (SELECT 1 FROM segs c WHERE c.doc = s.doc AND c.part = s.part AND starts_with(c.article, s.article || '.')))),
titles AS (SELECT doc, part, article, arg_max(heading, ordinal) AS title FROM segs WHERE article <> '' GROUP BY ALL),
crumbs AS (SELECT s.doc, s.ordinal, string_agg(t.article || ' ' || t.title, ' > ' ORDER BY length(t.article)) AS path FROM segs s JOIN titles t ON t.doc = s.doc AND t.part = s.part AND (s.article = t.article OR starts_with(s.article, t.article || '.')) WHERE t.title <> '' GROUP BY ALL),
paths AS (SELECT segs.doc, segs.ordinal, coalesce(path, heading) AS heading_path FROM segs LEFT JOIN crumbs USING (doc, ordinal))"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    article = F.when(i % 10 == 0, "").otherwise(F.array(*map(F.lit, ("2", "2.1", "2.1.3", "4")))[(i % 4).cast("int")])
    last = F.when(i % 3 == 0, 0).otherwise(F.greatest(F.floor((F.length("text") - 1) / 900), F.lit(0))).cast("int")
    return table(spark, sf_dir, "documents").withColumn("k", F.explode(F.sequence(F.lit(0), last))).select(
        F.floor(i / 10).alias("doc"), (i % 10 * 100_000 + F.col("k")).cast("int").alias("ordinal"), article.alias("article"), F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("Heading "), i)).alias("heading"), F.when(i % 10 >= 8, "Appendix I").otherwise("").alias("part"),
        F.when(i % 3 == 0, "  short ").otherwise(F.substring("text", F.col("k") * 900 + 1, F.lit(900))).alias("body"), (i % 40 + 1).cast("int").alias("page"), (i % 40 + 2).cast("int").alias("page_end"), F.array(F.struct(F.lit(0).alias("at"), (i % 40 + 1).cast("int").alias("page"))).alias("offsets"))


@query(f"WITH {_SEGS} SELECT * FROM paths")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of an article and those above it; of a number given twice the last."""
    return S.breadcrumbs(_segments(spark, sf_dir))


@query(f"WITH {_SEGS} SELECT doc, ordinal, thin AS rescued FROM stored")
def thin_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments to store: with twenty characters of text, or thin with no article below."""
    return S.rescue_thin(_segments(spark, sf_dir)).select("doc", "ordinal", "rescued")


@query(rf"""WITH {_SEGS}, b AS (SELECT *, CASE WHEN part <> '' AND article <> '' THEN part || ' § ' || article ELSE article END AS article_id FROM stored),
ids AS (SELECT *, 'g' || doc || ':' || coalesce(nullif(article_id, ''), 'front') || ':0' AS base FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ordinal) - 1 AS nth, row_number() OVER (PARTITION BY doc, base ORDER BY ordinal) AS seen,
  CASE WHEN thin THEN array_to_string(list_filter([heading, regexp_replace(body, '^\s+|\s+$', '', 'g')], lambda x: x <> ''), chr(10)) ELSE regexp_replace(body, '^\s+|\s+$', '', 'g') END AS piece FROM ids)
SELECT CASE WHEN seen > 1 THEN base || ':' || nth ELSE base END AS chunk_id, article_id, heading_path, page, page + 1 AS page_end, 1 AS chunk_of, length(piece) AS n_chars, 'Book ' || n.doc AS doc_title, false AS external_host,
  md5(CASE WHEN article <> '' THEN '[Book ' || n.doc || ' · Article ' || article_id || ' — ' || heading || ']' ELSE '[Book ' || n.doc || ' · ' || heading || ']' END || chr(10) || piece) AS text_md5 FROM n JOIN paths USING (doc, ordinal)""")
def assembled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the segments: label, breadcrumb, ids, pages and the metadata of their book."""
    s = _segments(spark, sf_dir)
    books = s.select("doc").distinct().select("doc", F.concat(F.lit("g"), "doc").alias("game"), F.concat(F.lit("Book "), "doc").alias("game_title"), F.lit("title").alias("scope"), F.lit(1).alias("authority"))
    c = S.assemble_chunks(s, books)
    return c.select("chunk_id", "article_id", "heading_path", "page", "page_end", "chunk_of", F.col("n_chars").cast("long").alias("n_chars"), "doc_title", "external_host", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def long_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole documents, split; pieces and the pages they start on are checked by unit tests."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    heading = lambda x, i: F.struct(F.when(i % 30 == 0, F.concat(F.floor((i + 1) / 30) + 1, F.lit(". Heading of part"))).otherwise(x["text"]).alias("text"), x["page"].alias("page"))
    lines = d.select(F.col("doc_id").alias("doc"), F.transform(S.paged_lines(F.col("text"), 20), heading).alias("lines"))
    books = d.select(F.col("doc_id").alias("doc"), F.col("lang").alias("game"), F.concat(F.lit("Book "), "lang").alias("game_title"), F.lit("title").alias("scope"), F.lit(1).alias("authority"))
    c = S.assemble_chunks(S.segment(lines), books)
    return c.select("doc", "chunk_id", "article", "page", "page_end", "chunk", "chunk_of", "n_chars")


@query(r"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
o AS (SELECT doc, (line_no - 1) // 20 + 1 AS page, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, length(line) AS n FROM l WHERE line <> '')
SELECT doc, count(*) AS n_lines, CAST(max(pos) AS BIGINT) AS last_at, CAST(arg_max(page, pos) FILTER (pos <= half) AS BIGINT) AS page FROM (SELECT *, max(pos + n) OVER (PARTITION BY doc) // 2 AS half FROM o) GROUP BY doc""")
def body_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the lines of a body begin, and the page that its middle is on."""
    lines = _lines(spark, sf_dir)
    at = S.line_offsets(lines).join(lines.select("doc", "line_no", F.length("text").alias("n")), ["doc", "line_no"])
    g = at.groupBy("doc").agg(F.count("*").alias("n_lines"), F.max("at").alias("last_at"), F.floor(F.max(F.col("at") + F.col("n")) / 2).alias("half"), F.sort_array(F.collect_list(F.struct("at", "page"))).alias("offsets"))
    return g.select("doc", "n_lines", "last_at", S.page_of(F.col("offsets"), F.col("half"), F.lit(1)).cast("long").alias("page"))


_FAULTY = r"faulty AS (SELECT CAST(CASE WHEN doc_id % 10 = 1 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) AS chunk_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '1.0' END AS version, doc_id % 40 AS page, CASE WHEN doc_id % 3 = 0 THEN '[Book]' || chr(10) ELSE '' END || text AS text FROM documents)"


@query(f"""WITH {_FAULTY} SELECT chunk_id, 'version is null' AS violation FROM faulty WHERE version IS NULL UNION ALL SELECT chunk_id, 'page below 1' FROM faulty WHERE page < 1 UNION ALL SELECT chunk_id, 'no label' FROM faulty WHERE NOT starts_with(text, '[')
UNION ALL SELECT chunk_id, 'id given again' FROM faulty GROUP BY chunk_id HAVING count(*) > 1 UNION ALL SELECT chunk_id, unnest(['source_url missing', 'chunk is string']) FROM faulty""")
def contract_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the chunk contract, one row each."""
    i = F.col("doc_id")
    c = table(spark, sf_dir, "documents").select(F.when(i % 10 == 1, i - 1).otherwise(i).cast("string").alias("chunk_id"), F.when(i % 7 != 0, "1.0").alias("version"), (i % 40).cast("int").alias("page"), F.concat(F.when(i % 3 == 0, "[Book]\n").otherwise(""), "text").alias("text"), *(F.lit("x").alias(k) for k in ("game", "game_title", "scope", "article", "heading", "effective_date", "chunk")), F.lit(1).alias("authority"))
    return S.violations(c)


@query(f"WITH {CHUNKS} SELECT scope, count(*) AS n, count(CASE WHEN scope = 'amendment' THEN 'notice ' || chunk_id END) AS with_text FROM chunks GROUP BY scope UNION ALL SELECT 'only de', count(*), 0 FROM chunks WHERE game = 'de' AND scope <> 'amendment'")
def union_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books and notices in one corpus; of some games alone without the notices."""
    c = chunks(spark, sf_dir)
    notices = c.where("scope = 'amendment'").withColumn("new_text", F.concat(F.lit("notice "), "chunk_id")).drop("heading")
    books = c.where("scope <> 'amendment'")
    whole = S.union_corpora(books, notices).groupBy("scope").agg(F.count("*").alias("n"), F.count("new_text").alias("with_text"))
    some = S.union_corpora(books, notices, ["de"]).agg(F.lit("only de").alias("scope"), F.count("*").alias("n"), F.lit(0).cast("long").alias("with_text"))
    return whole.unionByName(some)


@query(rf"WITH {CHUNKS} SELECT CAST(chunk_id AS VARCHAR) AS chunk_id, game, game_title, scope, authority, article, CASE WHEN part <> '' AND article <> '' THEN part || ' § ' || article ELSE article END AS article_id, heading, part, page, CAST(NULL AS VARCHAR) AS version, CAST(NULL AS VARCHAR) AS effective_date, CAST(NULL AS VARCHAR) AS source_url FROM chunks")
def metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    article_id = F.when((F.col("part") != "") & (F.col("article") != ""), F.concat_ws(" § ", "part", "article")).otherwise(F.col("article"))
    return R.metadata_rows(c.withColumn("article_id", article_id).withColumn("article", F.concat(F.lit(" "), "article", F.lit(" "))))


@query(rf"WITH {CHUNKS} SELECT CAST(chunk_id AS VARCHAR) AS chunk_id, game, scope, article, CASE WHEN part <> '' AND article <> '' THEN part || ' § ' || article ELSE article END AS article_id, heading, page FROM chunks")
def qrels_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.qrels_corpus(chunks(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT chunk_id, game, md5(text) AS text_md5, game IN ('global', 'fr') AS source_available, CASE game WHEN 'global' THEN 40 WHEN 'fr' THEN 41 WHEN 'de' THEN 42 END AS page_count FROM chunks")
def api_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with what is known of their book's file: there, absent, no PDF, or no such book."""
    books = spark.createDataFrame([("global", "a.pdf", True, 40), ("fr", "b.pdf", True, 41), ("de", "c.pdf", False, 42), ("es", "d.html", True, 43)], "game string, source_path string, present boolean, pages int")
    return R.api_docs(chunks(spark, sf_dir), books).select("chunk_id", "game", F.md5(F.col("text").cast("binary")).alias("text_md5"), "source_available", "page_count")


@query(as_long(f"WITH {CHUNKS} SELECT count(*) AS chunks, count(DISTINCT game) AS books, count_if(scope = 'amendment') AS amendments, sum(greatest(1, length(text) // 4)) AS tokens, round(sum(greatest(1, length(text) // 4)) * 0.02 / 1000000, 6) AS usd, true AS built FROM chunks", "amendments tokens"))
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row on an index, written and read back."""
    s = store.write_stats(chunks(spark, sf_dir), M.tokens_estimate(F.col("text")), 0.02, store.work_path(spark, "stats"))
    return s.select("chunks", "books", "amendments", "tokens", "usd", (F.col("built_at").isNotNull() & F.col("path").isNotNull()).alias("built"))


# Pages


def _decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with what rulebook pages have: a download link in an article, its record in a script, a news feed."""
    i = F.col("page_id").cast("string")
    link = F.concat(F.lit('<article><p>v1.2 Effective: 5 March 2026</p><a class="x" href="/f/book-'), i, F.lit('.pdf"><b>Download</b>\n Rulebook</a></article><a href="/later.pdf">download rulebook</a>'))
    script = F.concat(F.lit('<script>a={fileUrl:"/f/book-'), i, F.lit('.pdf",version:"2.0",effectiveDate:void 0};b={fileUrl:"/other.pdf",version:"9"}</script>'))
    feed = F.concat(F.lit('<script>n=[{id:"n'), i, F.lit('",badge:1,title:"It\\u2019s \\"new\\"",href:"/news/'), i, F.lit("\",body:'a\\nb'},{id:\"m"), i, F.lit('",badge:2,title:"Second",publishedDate:"July 17, 2026"}]</script>'))
    k = F.col("page_id") % 3
    body = F.when(k == 0, link).when(k == 1, F.concat(link, script)).otherwise(feed)
    return table(spark, sf_dir, "pages").withColumn("html", F.concat("html", body))


@query(r"SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || '/f/book-' || page_id || '.pdf' AS href, CASE WHEN page_id % 3 = 1 THEN '2.0' ELSE '1.2' END AS version, '2026-03-05' AS effective_date FROM pages WHERE page_id % 3 < 2")
def global_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The download of a listing; what the script says of it comes before what is shown."""
    return G.global_book(_decorated(spark, sf_dir))


@query(r"""SELECT page_id, id, title, body, published FROM (SELECT page_id, unnest([{'id': 'n' || page_id, 'title': 'It’s "new"', 'body': 'a' || chr(10) || 'b', 'published': NULL}, {'id': 'm' || page_id, 'title': 'Second', 'body': '', 'published': '2026-07-17'}], recursive := true) FROM pages WHERE page_id % 3 = 2)""")
def news_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the news feeds in pages' scripts, their string literals decoded."""
    f = G.feed(_decorated(spark, sf_dir))
    return f.select("page_id", "id", "title", "body", T.month_first_date(F.col("publishedDate")).alias("published"))


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>([^<·]*)', 1), '\s+', ' ', 'g'), ' '), ''), 'page ' || page_id) AS title, nullif(regexp_extract(html, 'track\((\d+)\)', 1), '0') AS version,
  CASE WHEN page_id % 5 = 0 THEN 'page unreachable' WHEN page_id % 5 = 1 THEN 'page unparseable' WHEN page_id % 5 = 2 THEN 'no link' WHEN NOT regexp_matches(lower(url), '\.(html|pdf)([?#].*)?$') THEN 'not a document' END AS reason,
  CASE page_id % 6 WHEN 0 THEN 'page unreachable' WHEN 1 THEN 'download failed' WHEN 2 THEN 'not PDF bytes' WHEN 3 THEN 'unwritable' END AS download, CASE WHEN page_id % 2 = 0 THEN 'in' ELSE 'out' END AS block FROM pages""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, a value from the page's script, why the page or its download would be skipped, and where its link is looked for."""
    i = F.col("page_id")
    p = table(spark, sf_dir, "pages")
    seen = F.when(i % 5 == 1, "no tags").when(i % 5 == 2, "<html><p>x</p></html>").when(i % 5 > 2, F.col("html"))
    status = F.when(i % 6 == 1, 404).when(i % 6 > 1, 200)
    download = G.download_status(status, F.when(i % 6 != 2, F.lit(b"%PDF-1.7")).otherwise(F.lit(b"<html>")), i % 6 != 3)
    block = G.detail_block(F.when(i % 2 == 0, F.lit('<p>out</p><article aria-labelledby="rulebook-pdf-heading">in</article>')).otherwise("out"))
    version = F.nullif(G.payload_value(F.col("html"), r"track\((\d+)\)"), F.lit("0"))
    return p.select("page_id", G.title_name(F.col("html"), F.concat(F.lit("page "), "page_id")).alias("title"), version.alias("version"), G.skip_reason(F.col("url"), seen).alias("reason"), download.alias("download"), block.alias("block"))


@query(r"""WITH p AS (SELECT page_id, html, page_id % 11 AS k, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS root FROM pages)
SELECT page_id, CASE WHEN k > 2 THEN nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>([^<·]*)', 1), '\s+', ' ', 'g'), ' '), '') END AS name,
  CASE WHEN k = 4 THEN root || '/f/book-' || page_id || '.html?v=1.pdf' WHEN k > 4 THEN root || '/f/book-' || page_id || '.pdf' END AS href, CASE WHEN k BETWEEN 4 AND 9 THEN '1.2' END AS version, CASE WHEN k BETWEEN 4 AND 9 THEN '2026-03-05' END AS effective_date,
  CASE k WHEN 0 THEN 'page unreachable' WHEN 1 THEN 'page refused' WHEN 2 THEN 'page unparseable' WHEN 3 THEN 'no link' WHEN 4 THEN 'not a PDF' WHEN 5 THEN 'download unreachable' WHEN 6 THEN 'download failed' WHEN 7 THEN 'not PDF bytes' WHEN 8 THEN 'unwritable' END AS reason FROM p""")
def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resolution for each page, altered so that every outcome occurs: the link of the labelled article comes before one elsewhere, and each reason is a value."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 11
    book = F.concat(F.lit("/f/book-"), i, F.when(k == 4, ".html?v=1.pdf").otherwise(".pdf"))
    decoy = F.lit('<a>download rulebook</a><article><a href="/decoy.pdf">Download rulebook</a></article>')
    link = F.concat(F.lit('<a class="x" href="'), book, F.lit('"><b>Download</b>\n Rulebook</a>'))
    labelled = F.concat(decoy, F.lit('<article class="c" aria-labelledby="rulebook-pdf-heading"><p>v1.2 Effective: 5 March 2026</p><a href="/x.pdf">Appendix</a>'), link, F.lit("</article>"))
    html = F.when(k == 2, "no tags").when(k == 3, F.col("html")).when(k == 10, F.concat("html", link)).otherwise(F.concat("html", labelled))
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.when(k == 1, 500).when(k > 1, 200).alias("status"), html.alias("html"))
    files = p.where(k > 5).select(G.resolve_url(F.concat(F.lit("/f/book-"), i, F.lit(".pdf")), F.col("url")).alias("href"), F.when(k == 6, 404).otherwise(200).alias("status"), F.when(k == 7, F.lit(b"<html>")).otherwise(F.lit(b"%PDF-1.7")).alias("content"), (k != 8).alias("written"))
    return G.resolve_detail(p, files)


@query(r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://a.org/x' WHEN 1 THEN regexp_replace(rtrim(split_part(split_part(url, '?', 1), '#', 1), '/'), '/[^/]*$', '') || '/rulebooks/' || page_id ELSE rtrim(split_part(split_part(url, '?', 1), '#', 1), '/') || '/detail' END AS target FROM pages""")
def locale_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a listing resolved against the root of its language."""
    k = F.col("page_id") % 3
    href = F.when(k == 0, "https://a.org/x").when(k == 1, F.concat(F.lit("/rulebooks/"), "page_id")).otherwise("detail")
    return table(spark, sf_dir, "pages").select("page_id", G.resolve_locale(href, F.regexp_replace("url", "[?#].*$", "")).alias("target"))


@query("SELECT 'book-' || page_id AS name, page_id % 4 IN (1, 2) AS held FROM pages")
def download_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that need not be fetched again: there, and PDFs."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("book-"), "page_id").alias("name"), "url", "page_id")
    files = p.where("page_id % 4 < 3").select("name", F.when(F.col("page_id") % 4 > 0, F.lit(b"%PDF-1.4 x")).otherwise(F.lit(b"<html>")).alias("content"))
    return store.cached(files, p.select("name", "url")).select("name", "held")


# Lines


@query(r"""WITH s AS (SELECT doc_id AS doc, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc, unnest(range(1, (len(l) - 1) // 20 + 2)) AS page, l, (len(l) - 1) // 20 + 1 AS of FROM s),
x AS (SELECT doc, page, list_filter(list_transform(list_concat(l[(page - 1) * 20 + 1:least(page * 20, len(l))], CASE doc % 5 WHEN 0 THEN ['Page ' || page || ' of ' || of, '  '] WHEN 1 THEN ['- ' || page || ' -' || chr(8203)] WHEN 2 THEN ['7'] WHEN 3 THEN ['Page ' || page, 'a', 'b', 'c'] ELSE ['section 4'] END), lambda x: trim(regexp_replace(replace(replace(x, chr(8203), ''), chr(160), ' '), '\s+', ' ', 'g'), ' ')), lambda x: x <> '') AS l FROM p),
t AS (SELECT doc, page, list_filter(list_reverse(l[greatest(len(l) - 2, 1):]), lambda x: regexp_matches(x, '(?i)^[\s\-–—_.·|]*(?:page\s*)?(\d{1,4})(?:\s*(?:of|/)\s*\d{1,4})?[\s\-–—_.·|]*$'))[1] AS label FROM x)
SELECT doc, page, label, label IS NOT NULL AND count(*) OVER (PARTITION BY doc, label) > 1 AS ambiguous FROM t""")
def footer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers printed at the foot of pages, in several shapes; one that several pages have is ambiguous."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.split("text", "\n").alias("l"))
    last = (F.floor((F.size("l") - 1) / 20) + 1).cast("int")
    p = d.select("doc", "l", last.alias("of"), F.explode(F.sequence(F.lit(1), last)).alias("page"))
    k, n = F.col("doc") % 5, F.col("page").cast("string")
    foot = F.when(k == 0, F.array(F.concat(F.lit("Page "), n, F.lit(" of "), "of"), F.lit("  "))).when(k == 1, F.array(F.concat(F.lit("- "), n, F.lit(" -​")))).when(k == 2, F.array(F.lit("7"))).when(k == 3, F.array(F.concat(F.lit("Page "), n), F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("section 4")))
    lines = F.concat(F.slice("l", (F.col("page") - 1) * 20 + 1, F.lit(20)), foot)
    return R.page_labels(p.select("doc", "page", lines.alias("lines"))).withColumn("page", F.col("page").cast("long"))


@query(rf"""WITH {_LINES}, m AS (SELECT doc, line_no, CASE WHEN line_no % 7 = 3 THEN 'Appendix A - Title ' || line_no ELSE line END AS line FROM lines),
k AS (SELECT doc, line_no, line, CASE WHEN line_no % 7 = 3 THEN line END AS mark FROM m)
SELECT doc AS doc_id, line_no, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS part, coalesce(lag(line) OVER w <> '' AND NOT regexp_matches(lag(line) OVER w, '[.!?:;”"'']$'), false) AS wraps, lead(line_no, 1, n + 1) OVER w AS next_line
FROM (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM k) WINDOW w AS (PARTITION BY doc ORDER BY line_no)""")
def running_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The appendix that each line lies in, whether it carries on the sentence of the line before, and the line after it."""
    w, whole = W.partitionBy("doc").orderBy("line_no"), W.partitionBy("doc")
    l = _lines(spark, sf_dir).withColumn("text", F.when(F.col("line_no") % 7 == 3, F.concat(F.lit("Appendix A - Title "), "line_no")).otherwise(F.col("text")))
    mark = F.when(F.col("text").rlike(S.PART.pattern) & (F.length("text") <= X.MAX_PART), F.col("text"))
    before = F.lag("text").over(w)
    wraps = F.coalesce((before != "") & ~before.rlike("[.!?:;”\"']$"), F.lit(False))
    return l.select(F.col("doc").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.coalesce(F.last(mark, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit("")).alias("part"), wraps.alias("wraps"), F.coalesce(F.lead("line_no").over(w), F.count("*").over(whole) + 1).cast("long").alias("next_line"))


# Notices


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    quote = F.concat(F.lit("\""), F.regexp_replace("text", "[\"“”\\n#]", " "), F.lit("\""))
    body = F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("Intro\n# Change\n"), quote, F.lit("\n## Scope\nArticle "), i % 9 + 1, F.lit(".2 of Book "), F.upper("lang"), F.lit("26")))
    return table(spark, sf_dir, "documents").select(i.alias("notice_id"), F.when(i % 4 == 1, F.regexp_replace(body, "Article", "Clause")).otherwise(body).alias("text"), "lang")


_NOTICES = r"""notices AS (SELECT doc_id AS notice_id, lang, regexp_replace(text, '["“”\n#]', ' ', 'g') AS quote FROM documents)"""


@query(rf"""WITH {_NOTICES} SELECT notice_id, CASE notice_id % 4 WHEN 0 THEN 'no body' WHEN 1 THEN 'no target' END AS reason, CASE WHEN notice_id % 4 = 0 THEN '' ELSE ',Change,Scope' END AS headings, CASE WHEN notice_id % 4 = 0 OR length(quote) NOT BETWEEN 40 AND 2000 THEN '' ELSE regexp_replace(quote, '^\s+|\s+$', '', 'g') END AS quoted,
  CASE WHEN notice_id % 4 < 2 THEN '' ELSE lang || ' ' || (notice_id % 9 + 1) || '.2' END AS targets FROM notices""")
def amendment_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, quoted rules and targets of notices, and why some amend nothing."""
    n = _notices(spark, sf_dir)
    aimed = N.amendment_targets(n, [(g, ["book", f"{g}26"]) for g in ("de", "en", "es", "fr")])
    t = aimed.groupBy("notice_id").agg(F.array_join(F.collect_list(F.concat_ws(" ", "game", "article")), ",").alias("targets"), F.count("*").alias("n"))
    j = n.join(t, "notice_id", "left")
    return j.select("notice_id", N.status(F.col("text"), F.coalesce("n", F.lit(0))).alias("reason"), F.array_join(N.headings_of(F.col("text")), ",").alias("headings"), N.quoted_of(F.col("text"), "change").alias("quoted"), F.coalesce("targets", F.lit("")).alias("targets"))


@query(rf"WITH {_NOTICES} SELECT 'amendment:' || notice_id || ':' || lang || ':' || (notice_id % 9 + 1) || '.2' AS chunk, lang AS game, (notice_id % 9 + 1) || '.2' AS article, true AS numbered FROM notices WHERE notice_id % 4 >= 2")
def amendment_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each notice and target: whole texts, so long ones have several pieces, numbered from 0."""
    n = _notices(spark, sf_dir)
    aimed = N.amendment_targets(n, [(g, ["book", f"{g}26"]) for g in ("de", "en", "es", "fr")])
    piece = F.regexp_extract("chunk_id", ":([0-9]+)$", 1).cast("int")
    c = N.amendment_chunks(n.select("notice_id", "text"), aimed).groupBy(F.regexp_replace("chunk_id", ":[0-9]+$", "").alias("chunk"), "game", "article")
    return c.agg((F.max(piece) + 1 == F.countDistinct(piece)).alias("numbered"))


@query(as_long(rf"WITH {_NOTICES} SELECT (SELECT count(*) FROM notices WHERE notice_id % 4 >= 2) AS amendments, (SELECT count_if(notice_id % 4 >= 2) FROM notices) AS stated, (SELECT count_if(notice_id % 4 < 2) FROM notices) AS skipped, 0 AS absent", "amendments stated skipped"))
def amendments_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices written with those skipped and the counts of both, and read back; a file that is not there is empty."""
    n = _notices(spark, sf_dir)
    amends = F.col("notice_id") % 4 >= 2
    path = store.work_path(spark, "amendments")
    store.write_amendments(n.where(amends), n.where(~amends).select("notice_id", F.lit("no target").alias("reason")), path)
    counts = {r["of"]: r["n"] for r in store.manifest_counts(spark, path).collect()}
    schema = "notice_id long, text string, lang string"
    return store.read_amendments(spark, path, schema).agg(F.count("*").alias("amendments"), F.lit(counts["document"]).cast("long").alias("stated"), F.lit(counts["skipped"]).cast("long").alias("skipped"), F.lit(store.read_amendments(spark, f"{path}-none", schema).count()).cast("int").alias("absent"))


@query("SELECT lang AS game, count(*) AS documents, (SELECT count(*) FROM documents WHERE length(text) < 100) AS skipped, (SELECT count(DISTINCT source) FROM documents) AS stale FROM documents WHERE length(text) >= 100 GROUP BY lang")
def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources accepted, written as a manifest with those skipped, stale files and the counts of each, and read back; one without a path is left out."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("game"), "doc_id", F.length("text").alias("size"), F.concat(F.lit("p/"), "doc_id").alias("path"), "source")
    nameless = d.limit(1).withColumn("path", F.lit(None).cast("string"))
    path = store.work_path(spark, "manifest")
    store.write_manifest(d.where("size >= 100").unionByName(nameless), d.where("size < 100").select("game", "doc_id", F.lit("too short").alias("reason")), path, d.select(F.col("source").alias("name")).distinct())
    n = {r["of"]: r["n"] for r in store.manifest_counts(spark, path).collect()}
    return store.read_manifest(spark, path).groupBy("game").agg(F.count("*").alias("documents")).select("game", "documents", F.lit(n["skipped"]).cast("long").alias("skipped"), F.lit(n["stale"]).cast("long").alias("stale"))


# Books and their names

_BOOKS = "books AS (SELECT DISTINCT lang || '-' || source AS slug, 'Book ' || upper(lang) || ': ' || source AS title, CASE WHEN source = 'src1' THEN 'https://x.org/rulebooks/' || lang || '-page/' ELSE 'https://x.org/' END AS detail_url FROM documents UNION SELECT 'src2', 'Second', NULL)"


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    own = d.select(F.concat_ws("-", "lang", "source").alias("slug"), F.concat(F.lit("Book "), F.upper("lang"), F.lit(": "), "source").alias("title"), F.lit(None).cast("string").alias("doc_title"), F.when(F.col("source") == "src1", F.concat(F.lit("https://x.org/rulebooks/"), "lang", F.lit("-page/"))).otherwise("https://x.org/").alias("detail_url"))
    return own.unionByName(spark.createDataFrame([("src2", "Second", None, None)], own.schema))


_ALIASES = rf"""{_BOOKS}, n AS (SELECT slug, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'), ' ') AS alias FROM (SELECT slug, unnest([slug, title, CASE WHEN contains(detail_url, '/rulebooks/') THEN regexp_extract(rtrim(detail_url, '/'), '([^/]*)$', 1) END]) AS x FROM books) WHERE x IS NOT NULL
UNION SELECT slug, p FROM (SELECT slug, unnest(string_split(slug, '-')) AS p FROM books) WHERE NOT EXISTS (SELECT 1 FROM books o WHERE o.slug = p AND o.slug <> books_slug(slug))),
named AS (SELECT DISTINCT slug, alias FROM n WHERE length(alias) >= 3)""".replace("books_slug(slug)", "slug").replace("FROM (SELECT slug, unnest(string_split(slug, '-')) AS p FROM books) WHERE NOT EXISTS (SELECT 1 FROM books o WHERE o.slug = p AND o.slug <> slug)", "FROM (SELECT slug, unnest(string_split(slug, '-')) AS p FROM books) b WHERE NOT EXISTS (SELECT 1 FROM books o WHERE o.slug = b.p AND o.slug <> b.slug)")


@query(f"WITH {_ALIASES} SELECT * FROM named")
def derived_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What books are called: slugs, titles, pages and parts of slugs that are no other book's slug."""
    return A.derived(_books(spark, sf_dir))


@query(f"WITH {_ALIASES} SELECT slug, alias FROM named WHERE alias IN (SELECT alias FROM named GROUP BY alias HAVING count(*) = 1)")
def book_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that one book alone carries."""
    return A.unambiguous(A.derived(_books(spark, sf_dir)))


@query(rf"""WITH {CHUNKS}, i AS (SELECT game AS slug, min(game_title) AS own, count(*) AS n FROM chunks WHERE scope <> 'amendment' GROUP BY game), m AS (SELECT * FROM (VALUES ('global', 'Global', 'ok'), ('de', 'DE', 'ok'), ('xx', 'Only listed', 'not a PDF')) t(slug, title, status))
SELECT coalesce(i.slug, m.slug) AS slug, coalesce(own, title) AS title, coalesce(n, 0) AS n_chunks, own IS NOT NULL AS in_corpus, status, CASE coalesce(i.slug, m.slug) WHEN 'global' THEN 'book of all,global' WHEN 'xx' THEN 'only' ELSE '' END AS aliases FROM i FULL JOIN m ON i.slug = m.slug""")
def rich_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed books beside those that the manifest alone knows, with the names that no other book carries."""
    m = spark.createDataFrame([("global", "Global", "ok"), ("de", "DE", "ok"), ("xx", "Only listed", "not a PDF")], "slug string, title string, status string")
    names = spark.createDataFrame([("global", "global"), ("global", "book of all"), ("de", "book"), ("fr", "book"), ("xx", "only")], "slug string, alias string")
    return R.catalog(chunks(spark, sf_dir), m, names).withColumn("aliases", F.array_join("aliases", ","))


@query(f"WITH {CHUNKS} SELECT slug, alias FROM (SELECT DISTINCT game AS slug, 'the ' || lower(game_title) AS alias FROM chunks) WHERE slug <> 'es'")
def alias_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from the first file that is there; books that the catalog lacks are left out."""
    c = chunks(spark, sf_dir)
    path = store.work_path(spark, "aliases")
    c.select(F.col("game").alias("slug"), F.concat(F.lit("the "), F.lower("game_title")).alias("alias")).distinct().coalesce(1).write.json(path)
    return store.alias_supplement(spark, [f"{path}-none", path], c.where("game <> 'es'").select(F.col("game").alias("slug")))


@query(r"SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'), ' ') AS slug FROM (SELECT doc_id, left(text, 200) AS text FROM (SELECT doc_id, 'Pokémon: Ünïted—' || doc_id AS text FROM documents))")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without accents, in lower case, parted by single spaces."""
    return table(spark, sf_dir, "documents").select("doc_id", A.slugify(F.concat(F.lit("Pokémon: Ünïted—"), "doc_id")).alias("slug"))


@query(f"WITH {CHUNKS} SELECT game || '.chunks' AS name, count(*) AS found, CASE WHEN game = 'es' THEN NULL WHEN game = 'fr' THEN -1 ELSE count(*) END AS expected, game NOT IN ('es', 'fr') AS ok FROM chunks GROUP BY game UNION ALL SELECT 'xx.chunks', NULL, 5, false")
def offline_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per book against the pins; a book on one side only is not ok."""
    found = chunks(spark, sf_dir).groupBy(F.concat("game", F.lit(".chunks")).alias("name")).agg(F.count("*").alias("value"))
    pins = found.where("name <> 'es.chunks'").withColumn("value", F.when(F.col("name") == "fr.chunks", -1).otherwise(F.col("value"))).unionByName(spark.createDataFrame([("xx.chunks", 5)], "name string, value long"))
    return store.check_pins(found, pins)
