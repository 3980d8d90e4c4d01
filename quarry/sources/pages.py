"""Crawled pages as a source: links, titles, payload values and skip reasons, by expressions in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T

HREF = r"<a\s[^>]*href=\"([^\"]*)\""


def resolve_url(href: Column, page_url: Column) -> Column:
    """Absolute stays; ``/x`` joins the host; anything else joins the page's folder."""
    root = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(page_url, r"^([^?#]*)", 1), r"(?<=[^/:])/[^/]*$", "")
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, F.lit("/"), href))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, target) of every anchor, in page order."""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("pos", "href"))
    return found.withColumn("target", resolve_url(F.col("href"), F.col("url")))


def first_slugs(links_: DataFrame, pattern: str) -> DataFrame:
    """(slug, href, page_id): of each lower-case slug that ``pattern`` finds in a link, the first link."""
    slug = F.lower(F.regexp_extract("href", pattern, 1))
    first = F.struct("page_id", "pos")
    return links_.withColumn("slug", slug).where("slug <> ''").groupBy("slug").agg(F.min_by("href", first).alias("href"), F.min("page_id").alias("page_id"))


def title_name(html: Column, fallback: Column) -> Column:
    """The title before its first dot sign without a closing ``Rulebook [year]``; else the first heading; else ``fallback``."""
    title = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>([^<·]*)", 1), r"(?i)\s*rulebook(\s+\d{4})?\s*$", ""))
    heading = T.flat(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]*>", ""))
    return F.coalesce(F.nullif(T.flat(title), F.lit("")), F.nullif(heading, F.lit("")), fallback)


def payload_value(html: Column, pattern: str) -> Column:
    """A value from a page's script; ``void 0`` and the empty string are null."""
    got = F.regexp_extract(html, pattern, 1)
    return F.when(~got.isin("", "void 0"), got)


def skip_reason(url: Column, html: Column) -> Column:
    """Why a page is no source, or null: reasons are rows, not exceptions."""
    return F.when(html.isNull(), "page unreachable").when(~html.rlike("(?i)<html"), "page unparseable").when(~html.rlike("(?i)href=\"[^\"]*\""), "no link").when(~F.lower(url).rlike(r"\.(html|pdf)([?#].*)?$"), "not a document")


def download_status(status: Column, content: Column, written: Column) -> Column:
    """Why a fetched file is not kept, or null; ``status``: of the reply, null without one; ``written``: could it be stored."""
    return F.when(status.isNull(), "page unreachable").when((status < 200) | (status > 299), "download failed").when(F.coalesce(F.substring(content, 1, 5) != F.lit(b"%PDF-"), F.lit(True)), "not PDF bytes").when(~written, "unwritable")


def detail_block(html: Column) -> Column:
    """The article labelled as the download's, if the page has it; else the whole page."""
    own = F.regexp_extract(html, r"(?is)<article[^>]*aria-labelledby=\"rulebook-pdf-heading\"[^>]*>(.*?)</article>", 1)
    return F.when(own != "", own).otherwise(html)


def enclosing_article(html: Column, href: Column) -> Column:
    """The article element around the first link to ``href``; null if there is none."""
    articles = F.regexp_extract_all(html, F.lit(r"(?is)<article\b[^>]*>(?:(?!</article>).)*</article>"), 0)
    return F.get(F.filter(articles, lambda a: F.contains(a, F.concat(F.lit('href="'), href, F.lit('"')))), F.lit(0))


def meta_line(text: Column) -> tuple[Column, Column]:
    """(version, date): ``v1.0`` and the date after ``Effective`` in a line, each null if absent."""
    version = F.nullif(F.regexp_extract(text, r"(?i)\bv(\d+(?:\.\d+)*)\b", 1), F.lit(""))
    raw = F.regexp_extract(text, r"(?i)effective\s*(?:date)?\s*:?\s*(\d{4}-\d{2}-\d{2}|\d{1,2}\s+[A-Za-z]+\.?\s+\d{4})", 1)
    return version, T.normalise_date(F.nullif(raw, F.lit("")))


def payload_record(html: Column, url: Column, field: str) -> Column:
    """``field`` of the script record whose externalUrl or fileUrl is ``url``; ``void 0`` and the empty string are null."""
    records = F.regexp_extract_all(html, F.lit(r"\{[^{}]*(?:externalUrl|fileUrl):[^{}]*\}"), 0)
    own = F.get(F.filter(records, lambda r: F.contains(r, F.concat(F.lit('externalUrl:"'), url, F.lit('"'))) | F.contains(r, F.concat(F.lit('fileUrl:"'), url, F.lit('"')))), F.lit(0))
    got = F.regexp_extract(own, rf'\b{field}:(?:"([^"]*)"|void 0)', 1)
    return F.nullif(got, F.lit(""))


#: A link to a PDF whose text, tags aside, is the download's.
_DOWNLOAD = r"(?is)<a\s[^>]*href=\"([^\"]*\.pdf(?:[?#][^\"]*)?)\"[^>]*>(?:\s|<[^>]*>)*download(?:\s|<(?!/a>)[^>]*>)+rulebook"


def global_book(pages: DataFrame) -> DataFrame:
    """(page_id, href, version, effective_date) of the first download link of each page that has one; the script's values come before those that are shown."""
    raw = F.regexp_extract("html", _DOWNLOAD, 1)
    p = pages.withColumn("raw", raw).where("raw <> ''").withColumn("href", resolve_url(F.col("raw"), F.col("url")))
    block = F.regexp_replace(F.coalesce(enclosing_article(F.col("html"), F.col("raw")), F.lit("")), "<[^>]*>", " ")
    version, date = meta_line(T.flat(block))
    return p.select("page_id", "href", F.coalesce(payload_record(F.col("html"), F.col("raw"), "version"), version).alias("version"), F.coalesce(payload_record(F.col("html"), F.col("raw"), "effectiveDate"), date).alias("effective_date"))


def resolve_locale(href: Column, listing: Column) -> Column:
    """Absolute stays; ``/x`` joins the listing without its last segment (the root of its language); anything else joins the listing."""
    base = F.rtrim(listing, F.lit("/"))
    root = F.regexp_replace(base, "/[^/]*$", "")
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(base, F.lit("/"), href))


def orphans(cached: DataFrame, wanted: DataFrame, name: str = "name") -> DataFrame:
    """Cached names that no wanted document refers to; reported, never deleted."""
    return cached.select(name).distinct().join(wanted.select(name).distinct(), name, "left_anti")


def position_in_page(lines: DataFrame) -> DataFrame:
    w = W.partitionBy("doc", "page")
    return lines.withColumn("pos", F.row_number().over(w.orderBy("line_no")) - 1).withColumn("n_in_page", F.count("*").over(w))


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


def js_string(source: str, start: int) -> tuple[str, int]:
    """The literal whose opening quote is at ``start``, decoded, and the place after its closing quote."""
    quote, i, out = source[start], start + 1, []
    while i < len(source) and source[i] != quote:
        if source[i] != "\\":
            out.append(source[i])
            i += 1
            continue
        code = source[i + 1 : i + 2]
        if m := re.match(r"u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})", source[i + 1 : i + 12]):
            out.append(chr(int(m[1] or m[2] or m[3], 16)))
            i += 1 + m.end()
        else:
            out.append(_ESCAPES.get(code, code))
            i += 2
    text = "".join(out)
    try:  # escapes may give surrogate pairs, which are one character
        text = text.encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeDecodeError:
        pass
    return text, i + 1


_RECORD = re.compile(r'\{id:"([^"]*)",badge:')


def feed_records(html: str) -> list[dict[str, str]]:
    """Records of a news feed in a page's script; each reaches to the next one's start."""
    starts = [m.start() for m in _RECORD.finditer(html)]
    out = []
    for lo, hi in zip(starts, [*starts, len(html)][1:], strict=True):
        part = html[lo:hi]
        row = {"id": _RECORD.match(part)[1]}
        for field in ("title", "excerpt", "href", "publishedDate", "label", "body"):
            m = re.search(rf"\b{field}:(?=[\"'`])", part)
            row[field] = js_string(part, m.end())[0] if m else ""
        out.append(row)
    return out


_FEED = ("id", "title", "excerpt", "href", "publishedDate", "label", "body")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([(k, pa.string()) for k in _FEED])
    for batch in batches:
        for i in range(batch.num_rows):  # a page's records at a time
            found = feed_records(batch.column("html")[i].as_py() or "")
            if found:
                own = batch.select(["page_id", "url"]).take(pa.array([i] * len(found), pa.int64()))
                rows = pa.RecordBatch.from_pylist(found, schema=kinds)
                yield pa.RecordBatch.from_arrays([*own.columns, *rows.columns], names=["page_id", "url", *_FEED])


def feed(pages: DataFrame) -> DataFrame:
    """(page_id, url, id, title, excerpt, href, publishedDate, label, body): one row per feed record of each page."""
    p = pages.select("page_id", "url", "html")
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema.fields[:2])
    return p.mapInArrow(_records, f"{own}, {', '.join(f'{k} string' for k in _FEED)}")


def resolve_detail(pages: DataFrame, downloads: DataFrame) -> DataFrame:
    """(page_id, name, href, version, effective_date, reason) of detail pages: the rulebook that each one publishes, or why there is none.

    ``pages``: page_id, url, status (null: no reply) and html; ``downloads``:
    href, status, content and written (could it be stored), each href once.
    The link is the first whose text asks to download the rulebook, looked for
    in the article labelled so, else in the whole page.  A reason is a value,
    never an exception: of the page (unreachable, refused, unparseable), of
    its link (none, not a PDF), or of the download (unreachable, failed, not
    PDF bytes, unwritable); null where the document is there.
    """
    anchors = F.regexp_extract_all(detail_block(F.col("html")), F.lit(r"(?is)<a\b[^>]*>.*?</a>"), 0)
    asked = F.filter(anchors, lambda a: T.flat(F.regexp_replace(a, "<[^>]*>", " ")).rlike(r"(?i)download\s+rulebook") & a.rlike(r"(?is)^<a\b[^>]*\bhref\s*=\s*\"[^\"]"))
    raw = F.regexp_extract(F.get(asked, F.lit(0)), r"(?is)^<a\b[^>]*\bhref\s*=\s*\"([^\"]*)\"", 1)
    p = pages.select("page_id", "url", F.col("status").alias("page_status"), "html", F.nullif(raw, F.lit("")).alias("raw"))
    p = p.withColumn("href", F.when(F.col("raw").isNotNull(), resolve_url(F.col("raw"), F.col("url"))))
    d = downloads.select(F.col("href").alias("got"), F.col("status").alias("file_status"), "content", "written")
    j = p.join(d, p["href"] == d["got"], "left")
    of_page = F.when(F.col("page_status").isNull(), "page unreachable").when((F.col("page_status") < 200) | (F.col("page_status") > 299), "page refused").when(~F.coalesce(F.col("html").rlike(r"(?i)<[a-z!]"), F.lit(False)), "page unparseable")
    of_link = F.when(F.col("href").isNull(), "no link").when(~F.lower(F.regexp_replace("href", "[?#].*$", "")).rlike(r"\.pdf$"), "not a PDF")
    status = download_status(F.col("file_status"), F.col("content"), F.coalesce("written", F.lit(False)))
    of_file = F.when(status == "page unreachable", "download unreachable").otherwise(status)
    version, date = meta_line(T.flat(F.regexp_replace(F.coalesce(enclosing_article(F.col("html"), F.col("raw")), F.lit("")), "<[^>]*>", " ")))
    found = F.col("raw").isNotNull() & of_page.isNull()
    return j.select(
        "page_id",
        F.when(of_page.isNull(), title_name(F.col("html"), F.lit(None).cast("string"))).alias("name"),
        F.when(found, F.col("href")).alias("href"),
        F.when(found, F.coalesce(payload_record(F.col("html"), F.col("raw"), "version"), version)).alias("version"),
        F.when(found, F.coalesce(payload_record(F.col("html"), F.col("raw"), "effectiveDate"), date)).alias("effective_date"),
        F.coalesce(of_page, of_link, of_file).alias("reason"),
    )


def download_link(html: Column, page_url: Column, text: str = r"download\s+rulebook") -> Column:
    """The first link to a PDF whose text matches, resolved; null if there is none."""
    href = F.regexp_extract(html, rf"(?is)<a\s[^>]*href=\"([^\"]*\.pdf(?:[?#][^\"]*)?)\"[^>]*>(?:(?!</a>).)*?{text}", 1)
    return F.when(href != "", resolve_url(href, page_url))
