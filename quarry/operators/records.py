"""Records of the service: chunks, answers and findings as its readers get them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import fixed as X
from quarry.functions import text as T
from quarry.operators import metrics as M
from quarry.operators import precedence as P
from quarry.operators.aliases import unambiguous

METADATA = {"chunk_id": "string", "game": "string", "game_title": "string", "scope": "string", "authority": "int", "article": "string", "article_id": "string", "heading": "string", "part": "string", "page": "int", "version": "string", "effective_date": "string", "source_url": "string"}


def metadata_rows(chunks: DataFrame) -> DataFrame:
    """The thirteen columns of ``METADATA``, null where the chunks have none; articles trimmed."""
    c = chunks
    if "article_id" not in c.columns:
        c = c.withColumn("article_id", F.when((F.col("part") != "") & (F.col("article") != ""), F.concat_ws(" § ", "part", "article")).otherwise(F.col("article")))
    out = c.select(*((F.col(k) if k in c.columns else F.lit(None)).cast(kind).alias(k) for k, kind in METADATA.items()))
    return out.withColumn("article", F.trim("article"))


def qrels_corpus(chunks: DataFrame) -> DataFrame:
    """The seven columns by which labels find chunks."""
    return metadata_rows(chunks).select("chunk_id", "game", "scope", "article", "article_id", "heading", "page")


def api_docs(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """Chunks as they are, with ``source_available`` (is the book's file there?) and ``page_count`` (null if it is no PDF).

    ``books``: game, source_path, present (boolean) and pages, a row a book.
    """
    j = chunks.join(books.select("game", "source_path", "present", "pages"), "game", "left")
    pdf = F.coalesce(F.col("source_path").endswith(".pdf"), F.lit(False))
    return j.withColumns({"source_available": pdf & F.coalesce("present", F.lit(False)), "page_count": F.when(pdf, F.col("pages"))}).drop("source_path", "present", "pages")


def find_cited(cites: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, cite, chunk_id or null) of findings' places such as ``Title (Article 2.1, p.3)``: the first of the question's excerpts in reading order that stands there."""
    article = F.regexp_extract("cite", r"\((?:Article (\S+?), )?p\.\d+\)$", 1)
    parsed = cites.select("query_id", "cite", F.regexp_extract("cite", r"^(.+) \((?:Article \S+?, )?p\.\d+\)$", 1).alias("game_title"), article.alias("article"), F.regexp_extract("cite", r"p\.(\d+)\)$", 1).cast("int").alias("page"))
    places = docs.select("query_id", "game_title", F.trim(F.coalesce("article", F.lit(""))).alias("article"), "page", "chunk_id", "read_pos")
    j = parsed.join(places, ["query_id", "game_title", "article", "page"], "left")
    return j.groupBy("query_id", "cite").agg(F.min_by("chunk_id", "read_pos").alias("chunk_id"))


def view(turns: DataFrame, docs: DataFrame) -> DataFrame:
    """``turns`` (turn_id, chunk_id) with ``found``: the chunk among the turn's own excerpts (turn_id, chunk_id), else null."""
    own = docs.select("turn_id", "chunk_id", F.col("chunk_id").alias("found")).distinct()
    return turns.join(own, ["turn_id", "chunk_id"], "left")


#: A response record, in this order.
RESPONSE = """turn_id conversation_id asked_at question mode outcome answer citation_spans game forced_scope scope query docs ranks accountable findings
top_findings note citation_errors usage cost_usd cost_basis model duration_ms retried corpus_fingerprint""".split()


def responses(turns: DataFrame, evidence: DataFrame, findings: DataFrame, notes: DataFrame, spans: DataFrame, fingerprint: str, model: str) -> DataFrame:
    """One row a question with the columns of ``RESPONSE``.

    ``turns``: query_id, turn_id, conversation_id, asked_at, question, game,
    forced_scope, scope, answer, outcome, errors (arrays), usage (array of
    struct(node, input, output)), duration_ms; a null answer is a search.  The
    rest are tables of the pipeline.  What a search has not is null or empty.
    """
    doc = F.struct("read_pos", "chunk_id", "game", "game_title", "scope", "authority", "article", "page", "heading", "text")
    rank = F.struct("chunk_id", "rel_rank")
    e = evidence.groupBy("query_id").agg(F.sort_array(F.collect_list(doc)).alias("docs"), F.map_from_entries(F.collect_list(rank)).alias("ranks"))
    f = findings.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "kind", "article", "cite", "other", "chunk_ids"))).alias("findings"))
    s = spans.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text", "locator", "chunk_ids"))).alias("citation_spans"))
    j = turns
    for other in (e, P.accountable_of(evidence).select("query_id", "accountable"), f, P.top_findings(findings), notes, s):
        j = j.join(other, "query_id", "left")
    asked = F.col("answer").isNotNull()

    def total(kind: str) -> Column:
        return F.aggregate("usage", F.lit(0).cast("long"), lambda acc, u: acc + u[kind])

    def listed(name: str, frame: DataFrame) -> Column:
        return F.coalesce(name, F.array().cast(dict(frame.dtypes)[name]))

    cells = {
        "mode": F.when(asked, "ask").otherwise("search"), "outcome": F.when(asked, F.col("outcome")), "citation_spans": F.when(asked, listed("citation_spans", s)).otherwise(F.array().cast(dict(s.dtypes)["citation_spans"])),
        "query": F.col("question"), "docs": listed("docs", e), "accountable": F.coalesce("accountable", F.array().cast(f"array<{dict(evidence.dtypes)['chunk_id']}>")), "findings": listed("findings", f),
        "top_findings": F.coalesce("top_findings", T.empty_strings()), "note": F.coalesce("note", F.lit("")), "citation_errors": F.coalesce("errors", T.empty_strings()), "cost_usd": M.usd(total("input"), total("output"), F.lit(model)),
        "cost_basis": F.lit("chat only; embeddings of questions are not metered"), "model": F.lit(model), "retried": F.exists("usage", lambda u: u["node"] == "answer.recite"), "corpus_fingerprint": F.lit(fingerprint),
    }
    return j.select("query_id", *(cells.get(c, F.col(c)).alias(c) for c in RESPONSE))


def page_labels(pages: DataFrame) -> DataFrame:
    """(doc, page, label, ambiguous) of every page (doc, page, lines): the page number printed in its last three lines that are not blank, the lowest first; null if none.

    ``ambiguous``: another page of the document has the label too.
    """
    lines = F.filter(F.transform("lines", lambda x: T.flat(T.strip_invisible(x))), lambda x: x != "")
    label = F.get(F.filter(F.reverse(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), F.lit(3))), lambda x: x.rlike(f"(?i){X.FOOTER}")), F.lit(0))
    p = pages.select("doc", "page", label.alias("label"))
    again = p.where("label is not null").groupBy("doc", "label").agg(F.count("*").alias("n")).where("n > 1").select("doc", "label", F.lit(True).alias("ambiguous"))
    return p.join(again, ["doc", "label"], "left").select("doc", "page", "label", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def catalog(chunks: DataFrame, manifest: DataFrame, aliases: DataFrame) -> DataFrame:
    """A row a book, indexed or only in the manifest: (slug, title, n_chunks, in_corpus, status, aliases).

    ``manifest``: slug, title, status; ``aliases``: (slug, alias), of which
    those that several books carry are left out of all of them.
    """
    indexed = chunks.where("scope <> 'amendment'").groupBy(F.col("game").alias("slug")).agg(F.min("game_title").alias("own"), F.count("*").alias("n_chunks"))
    names = unambiguous(aliases).groupBy("slug").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    j = indexed.join(manifest, "slug", "full").join(names, "slug", "left")
    return j.select("slug", F.coalesce("own", "title").alias("title"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.col("own").isNotNull().alias("in_corpus"), "status", F.coalesce("aliases", T.empty_strings()).alias("aliases"))
