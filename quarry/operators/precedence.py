"""How the books in evidence relate: article groups, findings and the note on them.

``evidence`` has query_id, chunk_id, game, game_title, scope, authority,
article, page, part, heading, text, rel_rank and read_pos, and may have
article_id, heading_path, external_host, amends_game, amends_article, new_text,
caveat and effective_date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import fixed as X
from quarry.functions import text as T

_OPTIONAL = {"article_id": "string", "heading_path": "string", "external_host": "boolean", "amends_game": "string", "amends_article": "string", "new_text": "string", "caveat": "string", "effective_date": "string"}


def completed(evidence: DataFrame) -> DataFrame:
    """``evidence`` with all the optional columns, null where it has none; ``article_id`` is the part and the article."""
    own = F.when((F.col("part") != "") & (F.col("article") != ""), F.concat_ws(" § ", "part", "article")).otherwise(F.col("article"))
    e = evidence.withColumns({c: F.lit(None).cast(kind) for c, kind in _OPTIONAL.items() if c not in evidence.columns})
    return e.withColumn("article_id", F.coalesce(F.nullif("article_id", F.lit("")), own))


def cite_of(prefix: str = "") -> Column:
    return T.finding_cite(*(F.col(prefix + c) for c in ("game_title", "article", "page")))


def group_articles(evidence: DataFrame) -> DataFrame:
    """One row per article of a question's evidence: what it is by its first member in reading order, its texts joined by a space.

    An article is told by its id (part and number), else its number, its
    heading, its chunk.
    """
    key = F.coalesce(*(F.nullif(c, F.lit("")) for c in ("article_id", "article", "heading")), F.col("chunk_id").cast("string"))
    body = T.body_text(F.col("text"))
    members = F.sort_array(F.collect_list(F.struct("read_pos", "chunk_id", body.alias("body"))))
    g = completed(evidence).withColumns({"key": key, "cite": cite_of()}).groupBy("query_id", "game", "key").agg(
        F.min("read_pos").alias("ordinal"),
        *(F.min_by(c, "read_pos").alias(c) for c in ("scope", "game_title", "heading", "article", "page", "part", "heading_path", "cite")),
        F.min_by("text", "read_pos").alias("first_text"),
        members.alias("m"),
    )
    return g.withColumns({"article": F.trim("article"), "chunk_ids": F.col("m.chunk_id"), "text": F.array_join("m.body", " ")}).drop("m")


def features(groups: DataFrame) -> DataFrame:
    """The word sets that articles are compared by."""
    words = T.content_words(F.col("text"))
    return groups.withColumns({
        "h": F.array_distinct(T.content_words(F.coalesce("heading", F.lit("")))),
        "l": F.array_distinct(T.content_words(T.lead(F.col("text")))),
        "s": T.shingles(words),
    })


def subject_score(a: str, b: str) -> Column:
    """How far two articles are about one point: the best of heading, lead and body likeness that reaches its threshold."""
    c = F.col
    heading, body = T.jaccard(c(f"{a}.h"), c(f"{b}.h")), T.jaccard(c(f"{a}.s"), c(f"{b}.s"))
    lead = F.when(F.least(F.size(c(f"{a}.l")), F.size(c(f"{b}.l"))) >= X.MIN_LEAD_WORDS, T.containment(c(f"{a}.l"), c(f"{b}.l"))).otherwise(F.lit(0.0))
    return F.greatest(*(F.when(v >= least, v).otherwise(F.lit(0.0)) for v, least in ((heading, X.SAME_HEADING), (lead, X.SAME_LEAD), (body, X.SAME_BODY))))


def cross_references(text: Column, own: Column) -> Column:
    """Articles other than ``own`` that sentences naming the global rulebook refer to as a section or an article."""
    naming = F.filter(F.split(T.flat(text), r"(?<=[.!?])\s+"), lambda s: s.rlike(f"(?i){X.XREF_BOOK}"))
    found = F.flatten(F.transform(naming, lambda s: F.regexp_extract_all(s, F.lit(f"(?i){X.XREF_ARTICLE}"), 1)))
    return F.array_except(F.array_distinct(found), F.array(F.trim(own)))


def crossed(groups: DataFrame) -> DataFrame:
    """(query_id, game, title, global): the title articles whose first member defers to a global article in evidence, the first such in order."""
    refs = groups.where("scope = 'title'").select("query_id", "game", F.col("key").alias("title"), F.explode(cross_references(F.col("first_text"), F.col("article"))).alias("article"))
    base = groups.where("scope = 'global' AND article <> ''").select("query_id", "article", F.col("key").alias("global"), "ordinal")
    return refs.join(base, ["query_id", "article"]).groupBy("query_id", "game", "title").agg(F.min_by("global", "ordinal").alias("global"))


def title_findings(groups: DataFrame) -> DataFrame:
    """Each title article's one relation: with the global article it defers to, else with the one it scores best against (the first on ties).

    (query_id, kind, subject, title, global, title_cite, global_cite, score, chunk_ids, ordinal)
    """
    f = features(groups)
    t, g = f.where("scope = 'title'").alias("t"), f.where("scope = 'global'").alias("g")
    pre = crossed(groups).select(F.col("query_id").alias("xq"), F.col("game").alias("xg"), F.col("title").alias("xt"), F.col("global").alias("target"))
    pairs = t.join(g, F.col("t.query_id") == F.col("g.query_id")).join(pre, (F.col("t.query_id") == F.col("xq")) & (F.col("t.game") == F.col("xg")) & (F.col("t.key") == F.col("xt")), "left")
    hit = F.col("target") == F.col("g.key")
    pairs = pairs.where(F.col("target").isNull() | hit).select(
        *(F.col(f"t.{c}").alias(c) for c in ("query_id", "game", "part", "heading_path", "ordinal")), F.col("t.key").alias("title"), F.col("g.key").alias("global"), F.col("t.cite").alias("title_cite"), F.col("g.cite").alias("global_cite"),
        F.concat("t.chunk_ids", "g.chunk_ids").alias("chunk_ids"), F.col("g.ordinal").alias("g_ordinal"), F.coalesce(F.nullif("t.heading", F.lit("")), F.col("g.heading")).alias("subject"),
        F.coalesce(hit, F.lit(False)).alias("crossed"), subject_score("t", "g").alias("score"), T.jaccard(F.col("t.s"), F.col("g.s")).alias("body"))
    best = W.partitionBy("query_id", "game", "title").orderBy(F.desc("score"), "g_ordinal")
    top = pairs.withColumn("r", F.row_number().over(best)).where("r = 1 AND (score > 0 OR crossed)")
    reprint = F.coalesce(F.col("part").rlike(f"(?i){X.RESTATES}"), F.lit(False)) | F.coalesce(F.col("heading_path").rlike(f"(?i){X.RESTATES}"), F.lit(False))
    kind = F.when(F.col("crossed"), "cross_ref").when(reprint, "restatement").when(F.col("body") >= X.AGREEMENT, "agreement").otherwise("conflict")
    return top.select("query_id", kind.alias("kind"), "subject", "game", "title", "global", "title_cite", "global_cite", F.when(~F.col("crossed"), F.round("score", 3)).alias("score"), "chunk_ids", "ordinal")


def amended_findings(evidence: DataFrame) -> DataFrame:
    """Each amendment in evidence with the base articles that it targets, and whether they hold its new wording already; a notice without one is never incorporated."""
    e = completed(evidence).withColumn("cite", cite_of())
    a = e.where("scope = 'amendment'").select("query_id", F.col("chunk_id").alias("amendment"), F.coalesce("amends_game", "game").alias("game"), F.trim(F.coalesce(F.nullif("amends_article", F.lit("")), F.col("article"))).alias("article"), "cite", "caveat", "effective_date", F.col("read_pos").alias("ordinal"), T.shingles(T.content_words(F.coalesce("new_text", F.lit("")))).alias("new"))
    base = e.where("scope <> 'amendment'").select("query_id", "game", F.trim("article").alias("article"), F.struct("read_pos", F.col("chunk_id"), F.col("cite").alias("base_cite")).alias("b"), T.shingles(T.content_words(T.body_text(F.col("text")))).alias("old"))
    j = a.join(base, ["query_id", "game", "article"], "left")
    same = F.coalesce(T.containment(F.col("new"), F.col("old")) >= X.INCORPORATED, F.lit(False))
    g = j.groupBy("query_id", "amendment", "game", "article", "cite", "caveat", "effective_date", "ordinal").agg(F.sort_array(F.collect_list("b")).alias("b"), F.bool_or(same).alias("incorporated"))
    return g.withColumns({"base": F.col("b.chunk_id"), "base_cites": F.col("b.base_cite")}).drop("b")


def express_primacy(text: Column) -> Column:
    """The clause by which a text puts itself above the title books, or null."""
    hit = F.trim(F.regexp_extract(T.flat(text), f"(?i)({X.EXPRESS_PRIMACY})", 1))
    return F.when(hit != "", hit)


def primacy_findings(evidence: DataFrame, accountable: DataFrame) -> DataFrame:
    """(query_id, article, cite, quote, chunk_ids, ordinal): of each article the first relevant text that puts itself first, global ones before amendments."""
    e = completed(evidence).where("scope IN ('global', 'amendment')").withColumns({"quote": express_primacy(F.col("text")), "cite": cite_of(), "at": F.struct((F.col("scope") == "amendment").alias("late"), F.col("read_pos"))}).where("quote IS NOT NULL")
    key = F.trim(F.concat_ws(" ", F.coalesce("amends_game", "game"), F.coalesce("article", F.lit(""))))
    kept = e.join(accountable, "query_id", "left").where(relevant(F.array("chunk_id"), F.col("accountable"))).withColumn("key", key)
    one = kept.groupBy("query_id", "key").agg(F.min_by(F.struct("cite", "quote", "chunk_id"), "at").alias("x"), F.min("at").alias("at"))
    place = F.when(F.col("at.late"), F.col("at.read_pos") + 1_000_000).otherwise(F.col("at.read_pos"))
    return one.select("query_id", F.col("key").alias("article"), "x.cite", "x.quote", F.array("x.chunk_id").alias("chunk_ids"), place.alias("ordinal"))


def provenance_findings(evidence: DataFrame) -> DataFrame:
    """(query_id, cite, chunk_ids): the first book from elsewhere that would outrank the global one; only beside a global article."""
    e = completed(evidence).withColumn("cite", cite_of())
    beside = e.where("scope = 'global'").select("query_id").distinct()
    outside = e.where("external_host AND authority > 0").join(beside, "query_id", "left_semi")
    return outside.groupBy("query_id").agg(F.min_by(F.struct("cite", "chunk_id"), "read_pos").alias("x")).select("query_id", "x.cite", F.array("x.chunk_id").alias("chunk_ids"))


def accountable_of(evidence: DataFrame) -> DataFrame:
    """(query_id, accountable, first): the chunks that retrieval ranked highest, sorted, and the one ranked first."""
    rank = F.coalesce("rel_rank", F.lit(X.MISSING_RANK))
    return evidence.groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(rank <= X.ACCOUNTABLE_RANK, F.col("chunk_id")))).alias("accountable"), F.max(F.when(rank == 1, F.col("chunk_id"))).alias("first"))


def relevant(chunk_ids: Column, accountable: Column) -> Column:
    """Does a finding touch what retrieval ranked highest (or is nothing ranked)?"""
    return F.coalesce((F.size(accountable) <= 0) | F.arrays_overlap(chunk_ids, accountable), F.lit(True))


#: Findings are told in this order; those of title articles in reading order among themselves.
STAGES = {"amended": 0, "primacy": 1, "cross_ref": 2, "restatement": 2, "agreement": 2, "conflict": 2, "provenance": 3}
_FINDING = "query_id kind stage ordinal article cite other quote subject score incorporated base_in_evidence caveat effective_date chunk_ids".split()


def resolve(evidence: DataFrame) -> DataFrame:
    """All findings of every question that touch what retrieval ranked highest (provenance always), in the order of ``place``.

    ``cite`` is where the finding stands, ``other`` what it is held against;
    ``top``: does it touch the chunk ranked first.
    """
    ranked = accountable_of(evidence)
    gate = ranked.select("query_id", "accountable")
    amended = amended_findings(evidence)
    amended = amended.select("query_id", F.lit("amended").alias("kind"), "ordinal", F.concat_ws(" ", "game", "article").alias("article"), "cite", F.array_join("base_cites", "; ").alias("other"), "incorporated", (F.size("base") > 0).alias("base_in_evidence"), "caveat", "effective_date", F.concat(F.array("amendment"), "base").alias("chunk_ids"))
    titles = title_findings(group_articles(evidence)).select("query_id", "kind", "ordinal", F.col("title_cite").alias("cite"), F.col("global_cite").alias("other"), "subject", "score", "chunk_ids")
    gated = [d.join(gate, "query_id", "left").where(relevant(F.col("chunk_ids"), F.col("accountable"))).drop("accountable") for d in (amended, titles)]
    primacy = primacy_findings(evidence, gate).withColumn("kind", F.lit("primacy"))
    outside = provenance_findings(evidence).withColumns({"kind": F.lit("provenance"), "ordinal": F.lit(0)})
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*gated, primacy, outside])
    stage = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in STAGES.items()))
    placed = every.withColumn("stage", stage).select(*_FINDING)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("stage", "ordinal", "cite"))
    top = placed.join(ranked.select("query_id", "first"), "query_id", "left").withColumn("top", F.coalesce(F.array_contains("chunk_ids", F.col("first")), F.lit(False)))
    return top.withColumn("place", place).drop("first", "stage", "ordinal")


def top_findings(found: DataFrame) -> DataFrame:
    """(query_id, top_findings): ``kind at where`` of the findings that touch the chunk ranked first."""
    where = F.when(F.col("kind") == "amended", F.col("article")).otherwise(F.col("cite"))
    said = F.struct("place", F.concat(F.col("kind"), F.lit(" at "), where).alias("said"))
    return found.where("top").groupBy("query_id").agg(F.sort_array(F.collect_list(said))["said"].alias("top_findings"))


def _told() -> Column:
    """A finding as one line of the note."""
    c = F.col
    opening = F.concat(F.lit("AMENDED. "), c("article"), F.lit(" is changed by "), c("cite"), F.coalesce(F.concat(F.lit(", in force from "), F.nullif("effective_date", F.lit(""))), F.lit("")), F.lit(". "))
    state = (
        F.when(c("incorporated"), F.concat(F.lit("The excerpts ("), c("other"), F.lit(") hold the new wording already: present it as amended and cite both.")))
        .when(c("base_in_evidence"), F.concat(F.lit("The excerpts ("), c("other"), F.lit(") are older than it: the notice's wording is the rule in force, the older text is history.")))
        .otherwise(F.lit("The article itself was not retrieved: state the rule from the notice and say so."))
    )
    caveat = F.coalesce(F.concat(F.lit(' The notice carries a caveat that the answer repeats: "'), F.nullif("caveat", F.lit("")), F.lit('"')), F.lit(""))
    said = {
        "amended": F.concat(opening, state, caveat),
        "primacy": F.concat(F.lit("GLOBAL PRIMACY. "), c("cite"), F.lit(' puts itself above the title books: "'), c("quote"), F.lit('" On this point the global book governs.')),
        "conflict": F.concat(F.lit("CONFLICT. "), c("cite"), F.lit(" and "), c("other"), F.lit(" differ on one point ("), F.coalesce("subject", F.lit("")), F.lit("). The title book governs; give both rules and both citations.")),
        "agreement": F.concat(F.lit("AGREEMENT. "), c("cite"), F.lit(" and "), c("other"), F.lit(" state one rule. Cite both, claim no precedence.")),
        "restatement": F.concat(F.lit("RESTATEMENT. "), c("cite"), F.lit(" reprints global rules and agrees with "), c("other"), F.lit("; it does not outrank them.")),
        "cross_ref": F.concat(F.lit("CROSS-REFERENCE. "), c("cite"), F.lit(" defers to "), c("other"), F.lit(", which has the detail. Cite both, claim no precedence.")),
        "provenance": F.concat(F.lit("PROVENANCE. "), c("cite"), F.lit(" is hosted by others; say so where it is held against the global book.")),
    }
    return F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in said.items()))


def render_note(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, note): a line for each finding in order, a default where there is none, then what was ranked highest and what was not searched."""
    lines = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", _told().alias("l"))))["l"].alias("lines"))
    listed = F.concat(F.lit("["), F.col("read_pos"), F.lit("] "), "game_title", F.lit(" Article "), F.coalesce(F.nullif("article", F.lit("")), F.lit("-")))
    rank = F.coalesce("rel_rank", F.lit(X.MISSING_RANK))
    e = evidence.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.when(rank <= X.ACCOUNTABLE_RANK, F.struct("read_pos", listed.alias("l")))))["l"].alias("high"),
        F.bool_or(F.col("scope") == "title").alias("title"),
        F.bool_or(F.col("scope") == "global").alias("global"),
    )
    j = e.join(lines, "query_id", "left")
    default = F.when(F.col("title") & F.col("global"), "PRECEDENCE. No difference between the books was found. State each rule from its own book and claim no precedence.").otherwise("PRECEDENCE. One tier of books is in evidence, so there is no question of precedence.")
    coverage = F.when(F.size("high") > 0, F.concat(F.lit("COVERAGE. Ranked highest: "), F.array_join("high", "; "), F.lit(". Each is used and cited, or set aside with a reason.")))
    scope = F.when((F.size("high") > 0) & ~F.col("title"), F.lit("SCOPE. No title book is in evidence. A question about one title is not answered from the global book."))
    every = F.array_compact(F.concat(F.coalesce("lines", F.array(default)), F.array(coverage, scope)))
    return j.select("query_id", F.array_join(every, "\n").alias("note"))
