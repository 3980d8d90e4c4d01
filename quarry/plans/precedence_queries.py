"""Precedence relations and answer checks over the retrieved evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fixed as X
from quarry.functions import text as T
from quarry.operators import precedence as P
from quarry.operators import verify as V
from quarry.plans.corpus import CHUNKS, chunks, query, questions, sql_content, sql_shingles
from quarry.plans.retrieval_queries import EVIDENCE, evidence, inputs
from quarry.sources import store

_PRIMACY = "This clause shall prevail over any game-title rules in force."
#: The evidence with relations that the test texts lack: half of the amendments have a new wording, that of the article they amend where it is there; title chunks that defer to, repeat, contradict or reprint the first global article beside them, and global ones that put themselves first.
STAGED = EVIDENCE.replace("evidence AS (SELECT fused", "raw AS (SELECT fused") + rf""",
g0 AS (SELECT query_id, arg_min(article, read_pos) AS ga, arg_min(text, read_pos) AS gt, arg_min(heading, read_pos) AS gh FROM raw WHERE scope = 'global' AND article <> '' GROUP BY query_id),
evidence AS (SELECT raw.* REPLACE (
    CASE WHEN scope = 'title' AND chunk_id % 5 = 0 AND ga IS NOT NULL THEN text || '. As defined in Section ' || ga || ' of the Global Rulebook.' WHEN scope = 'title' AND chunk_id % 5 = 1 AND gt IS NOT NULL THEN gt WHEN scope = 'global' AND chunk_id % 4 = 0 THEN text || '. {_PRIMACY}' ELSE text END AS text,
    CASE WHEN scope = 'title' AND chunk_id % 5 IN (2, 3) AND gh IS NOT NULL THEN gh ELSE heading END AS heading,
    CASE WHEN scope = 'title' AND chunk_id % 5 = 3 THEN 'Global Rules' ELSE part END AS part), chunk_id % 5 = 4 AS external_host, CASE WHEN scope = 'amendment' AND chunk_id % 2 = 0 THEN coalesce(bt, text) END AS new_text,
    game_title || CASE WHEN article <> '' THEN ' (Article ' || article || ', p.' || page || ')' ELSE ' (p.' || page || ')' END AS cite
  FROM raw LEFT JOIN g0 USING (query_id) LEFT JOIN (SELECT query_id, game, article, arg_min(text, read_pos) AS bt FROM raw WHERE scope <> 'amendment' GROUP BY ALL) USING (query_id, game, article))"""


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence with the relations, and :func:`resolved` what is found in it; tables like the evidence itself."""
    return store.once("staged", inputs(spark, sf_dir), lambda: stage_relations(evidence(spark, sf_dir)))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.once("resolved", inputs(spark, sf_dir), lambda: P.resolve(staged(spark, sf_dir)))


def stage_relations(e: DataFrame) -> DataFrame:
    g0 = e.where("scope = 'global' AND article <> ''").groupBy("query_id").agg(*(F.min_by(c, "read_pos").alias(n) for c, n in (("article", "ga"), ("text", "gt"), ("heading", "gh"))))
    k, title, held = F.col("chunk_id") % 5, F.col("scope") == "title", F.col("ga").isNotNull()
    text = F.when(title & (k == 0) & held, F.concat("text", F.lit(". As defined in Section "), "ga", F.lit(" of the Global Rulebook."))).when(title & (k == 1) & held, F.col("gt")).when((F.col("scope") == "global") & (F.col("chunk_id") % 4 == 0), F.concat("text", F.lit(f". {_PRIMACY}"))).otherwise(F.col("text"))
    heading = F.when(title & k.isin(2, 3) & held, F.col("gh")).otherwise(F.col("heading"))
    part = F.when(title & (k == 3), "Global Rules").otherwise(F.col("part"))
    base = e.where("scope <> 'amendment'").groupBy("query_id", "game", "article").agg(F.min_by("text", "read_pos").alias("bt"))
    new = F.when((F.col("scope") == "amendment") & (F.col("chunk_id") % 2 == 0), F.coalesce("bt", "text"))
    return e.join(g0, "query_id", "left").join(base, ["query_id", "game", "article"], "left").withColumns({"new_text": new, "text": text, "heading": heading, "part": part, "external_host": k == 4}).drop("ga", "gt", "gh", "bt")


_KEY = "CASE WHEN article <> '' THEN CASE WHEN part <> '' THEN part || ' § ' || article ELSE article END WHEN heading <> '' THEN heading ELSE CAST(chunk_id AS VARCHAR) END"
GROUPS = rf"""{STAGED}, groups AS (
  SELECT query_id, game, {_KEY} AS key, min(read_pos) AS ordinal, arg_min(scope, read_pos) AS scope, arg_min(heading, read_pos) AS heading, arg_min(article, read_pos) AS article,
    arg_min(part, read_pos) AS part, arg_min(cite, read_pos) AS cite, arg_min(text, read_pos) AS first_text, list(chunk_id ORDER BY read_pos) AS chunk_ids, string_agg(text, ' ' ORDER BY read_pos) AS text
  FROM evidence GROUP BY query_id, game, {_KEY})"""
_LEAD = r"regexp_replace(regexp_extract(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), '^.*?(?:[.!?]\s|$)'), '\s$', '')"
_JACCARD = "CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"
FOUND = rf"""{GROUPS}, feats AS (SELECT *, list_distinct({sql_content("heading")}) AS h, list_distinct({sql_content(_LEAD)}) AS l, {sql_shingles("w")} AS s FROM (SELECT *, {sql_content("text")} AS w FROM groups)),
refs AS (SELECT query_id, game, key, article, unnest(regexp_extract_all(first_text, 'Section (\d{{1,2}}(?:\.\d{{1,3}})+) of the Global Rulebook', 1)) AS ref FROM groups WHERE scope = 'title'),
xhit AS (SELECT r.query_id, r.game, r.key AS title, arg_min(g.key, g.ordinal) AS target FROM refs r JOIN groups g ON g.query_id = r.query_id AND g.scope = 'global' AND g.article = r.ref WHERE r.ref <> r.article GROUP BY ALL),
pairs AS (SELECT t.query_id, t.game, t.key AS title, t.part, t.ordinal, t.cite, g.cite AS other, t.chunk_ids AS t_ids, g.key AS global, g.chunk_ids AS g_ids, g.ordinal AS g_ordinal, {_JACCARD.format(a="t.h", b="g.h")} AS hs, {_JACCARD.format(a="t.s", b="g.s")} AS bs,
    CASE WHEN least(len(t.l), len(g.l)) >= {X.MIN_LEAD_WORDS} THEN len(list_intersect(t.l, g.l)) / least(len(t.l), len(g.l)) ELSE 0 END AS ls
  FROM feats t JOIN feats g USING (query_id) WHERE t.scope = 'title' AND g.scope = 'global'),
scored AS (SELECT *, greatest(CASE WHEN hs >= {X.SAME_HEADING} THEN hs ELSE 0 END, CASE WHEN ls >= {X.SAME_LEAD} THEN ls ELSE 0 END, CASE WHEN bs >= {X.SAME_BODY} THEN bs ELSE 0 END) AS score FROM pairs LEFT JOIN xhit USING (query_id, game, title)),
found AS (SELECT query_id, CASE WHEN target IS NOT NULL THEN 'cross_ref' WHEN regexp_matches(part, '(?i)global\s+rul') THEN 'restatement' WHEN bs >= {X.AGREEMENT} THEN 'agreement' ELSE 'conflict' END AS kind, game, title, global, CASE WHEN target IS NULL THEN round(score, 3) END AS score, list_concat(t_ids, g_ids) AS chunk_ids, cite, other, ordinal
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, game, title ORDER BY score DESC, g_ordinal) AS r FROM scored WHERE target IS NULL OR target = global) WHERE r = 1 AND (score > 0 OR target IS NOT NULL))"""


def _csv(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


@query(rf"WITH {GROUPS} SELECT query_id, game, key, ordinal, scope, cite, array_to_string(chunk_ids, ',') AS chunk_ids, md5(text) AS text_md5 FROM groups")
def group_by_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.group_articles(staged(spark, sf_dir))
    return g.select("query_id", "game", "key", F.col("ordinal").cast("long").alias("ordinal"), "scope", "cite", _csv("chunk_ids").alias("chunk_ids"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(rf"WITH {FOUND} SELECT query_id, game, title, global, round(score, 6) AS score, round(bs, 6) AS body FROM scored")
def subject_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.features(P.group_articles(staged(spark, sf_dir)))
    t, g = f.where("scope = 'title'").alias("t"), f.where("scope = 'global'").alias("g")
    return t.join(g, F.col("t.query_id") == F.col("g.query_id")).select(F.col("t.query_id").alias("query_id"), F.col("t.game").alias("game"), F.col("t.key").alias("title"), F.col("g.key").alias("global"), F.round(P.subject_score("t", "g"), 6).alias("score"), F.round(T.jaccard(F.col("t.s"), F.col("g.s")), 6).alias("body"))


@query(rf"WITH {FOUND} SELECT query_id, kind, game, title, global, score, array_to_string(chunk_ids, ',') AS chunk_ids FROM found")
def title_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one relation of each title article: deferring comes before likeness."""
    f = P.title_findings(P.group_articles(staged(spark, sf_dir)))
    return f.select("query_id", "kind", "game", "title", "global", "score", _csv("chunk_ids").alias("chunk_ids"))


@query(rf"WITH {FOUND} SELECT query_id, game, title, target AS global FROM xhit")
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title articles that defer by number to a global article in evidence."""
    return P.crossed(P.group_articles(staged(spark, sf_dir)))


_AMENDED = rf"""a AS (SELECT query_id, chunk_id AS amendment, game, trim(article) AS article, cite, read_pos, {sql_shingles("w")} AS new FROM (SELECT *, {sql_content("coalesce(new_text, '')")} AS w FROM evidence WHERE scope = 'amendment')),
b AS (SELECT query_id, game, trim(article) AS article, chunk_id AS base, cite AS base_cite, read_pos AS base_pos, {sql_shingles("w")} AS old FROM (SELECT *, {sql_content("text")} AS w FROM evidence WHERE scope <> 'amendment')),
amended AS (SELECT query_id, amendment, game, article, cite, read_pos, list(base ORDER BY base_pos) FILTER (base IS NOT NULL) AS base, coalesce(string_agg(base_cite, '; ' ORDER BY base_pos), '') AS other,
  bool_or(coalesce(CASE WHEN len(new) > 0 AND len(old) > 0 THEN len(list_intersect(new, old)) / least(len(new), len(old)) >= {X.INCORPORATED} ELSE false END, false)) AS incorporated FROM a LEFT JOIN b USING (query_id, game, article) GROUP BY ALL)"""


@query(rf"WITH {STAGED}, {_AMENDED} SELECT query_id, amendment, game, article, coalesce(array_to_string(base, ','), '') AS base, incorporated FROM amended")
def amended_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.amended_findings(staged(spark, sf_dir)).select("query_id", "amendment", "game", "article", _csv("base").alias("base"), "incorporated")


RESOLVED = rf"""{FOUND}, {_AMENDED},
acc AS (SELECT query_id, list(chunk_id ORDER BY chunk_id) FILTER (rel_rank <= {X.ACCOUNTABLE_RANK}) AS ids, max(CASE WHEN rel_rank = 1 THEN chunk_id END) AS one FROM evidence GROUP BY query_id),
prim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY late, read_pos) AS r FROM (SELECT e.query_id, trim(game || ' ' || article) AS key, cite, chunk_id, scope = 'amendment' AS late, read_pos FROM evidence e JOIN acc USING (query_id) WHERE scope IN ('global', 'amendment') AND ends_with(text, '{_PRIMACY}') AND list_contains(ids, chunk_id))) WHERE r = 1),
prov AS (SELECT query_id, arg_min(cite, read_pos) AS cite, arg_min(chunk_id, read_pos) AS chunk_id FROM evidence WHERE external_host AND authority > 0 AND query_id IN (SELECT query_id FROM evidence WHERE scope = 'global') GROUP BY query_id),
every AS (
  SELECT query_id, 'amended' AS kind, 0 AS stage, read_pos AS ordinal, game || ' ' || article AS article, cite, other, list_concat([amendment], coalesce(base, [])) AS chunk_ids FROM amended
  UNION ALL SELECT query_id, kind, 2, ordinal, NULL, cite, other, chunk_ids FROM found),
gated AS (SELECT every.* FROM every JOIN acc USING (query_id) WHERE len(list_intersect(chunk_ids, ids)) > 0
  UNION ALL SELECT query_id, 'primacy', 1, read_pos + CASE WHEN late THEN 1000000 ELSE 0 END, key, cite, NULL, [chunk_id] FROM prim
  UNION ALL SELECT query_id, 'provenance', 3, 0, NULL, cite, NULL, [chunk_id] FROM prov),
resolved AS (SELECT gated.*, list_contains(chunk_ids, one) AS top, row_number() OVER (PARTITION BY gated.query_id ORDER BY stage, ordinal, cite) AS place FROM gated JOIN acc USING (query_id))"""


@query(rf"WITH {RESOLVED} SELECT query_id, place, kind, article, cite, other, array_to_string(chunk_ids, ',') AS chunk_ids, top FROM resolved")
def resolve_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every question in the order it is told; seven kinds."""
    f = resolved(spark, sf_dir)
    return f.select("query_id", F.col("place").cast("long").alias("place"), "kind", "article", "cite", "other", _csv("chunk_ids").alias("chunk_ids"), "top")


@query(rf"WITH {RESOLVED} SELECT query_id, string_agg(kind || ' at ' || CASE WHEN kind = 'amended' THEN article ELSE cite END, '; ' ORDER BY place) AS top_findings FROM resolved WHERE top GROUP BY query_id")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_findings(resolved(spark, sf_dir)).select("query_id", F.array_join("top_findings", "; ").alias("top_findings"))


@query(rf"""WITH {RESOLVED}, k AS (SELECT query_id, string_agg(CASE kind WHEN 'cross_ref' THEN 'CROSS-REFERENCE' WHEN 'primacy' THEN 'GLOBAL PRIMACY' ELSE upper(kind) END, ',' ORDER BY place) AS kinds FROM resolved GROUP BY query_id)
SELECT e.query_id, coalesce(kinds, 'PRECEDENCE') || ',COVERAGE' || CASE WHEN bool_or(scope = 'title') THEN '' ELSE ',SCOPE' END AS openings FROM evidence e LEFT JOIN k USING (query_id) GROUP BY e.query_id, kinds""")
def findings_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lines of every question's note open with: its findings, else the default; coverage; scope."""
    note = P.render_note(resolved(spark, sf_dir), staged(spark, sf_dir))
    return note.select("query_id", F.array_join(F.regexp_extract_all("note", F.lit(r"(?m)^([A-Z -]+)\. "), 1), ",").alias("openings"))


@query(rf"WITH {CHUNKS} SELECT chunk_id, '5.1.' || (chunk_id % 3 + 1) AS xrefs, CASE WHEN chunk_id % 2 = 0 THEN 'shall prevail over any game-title rules in force.' END AS quote FROM chunks")
def references_and_primacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross references other than to itself, and express primacy, in texts with such a clause at their end; numbers that no section or article names are none."""
    clause = F.concat("text", F.lit(". See version 2.1 of the Global Rulebook on 10.12. As defined in Section 5.1."), F.col("chunk_id") % 3 + 1, F.lit(" and article "), "article", F.lit(" of the Global Rulebook. "), F.when(F.col("chunk_id") % 2 == 0, _PRIMACY).otherwise(""))
    return chunks(spark, sf_dir).select("chunk_id", _csv(P.cross_references(clause, F.col("article"))).alias("xrefs"), P.express_primacy(clause).alias("quote"))


@query(rf"WITH {RESOLVED} SELECT query_id, cite, chunk_id AS provenance FROM prov")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first externally hosted book above the global one; only beside a global article."""
    return P.provenance_findings(staged(spark, sf_dir)).select("query_id", "cite", F.col("chunk_ids")[0].alias("provenance"))


_LADDER = rf"""ladder AS (SELECT * REPLACE (CASE WHEN query_id % 2 = 0 THEN '2.8.' || rel_rank ELSE article END AS article, CASE WHEN query_id % 2 = 0 THEN 'Global Book' ELSE game_title END AS game_title) FROM evidence),
cited AS (SELECT DISTINCT query_id, game_title, article FROM ladder WHERE rel_rank IN (1, 2, 5) AND article <> ''),
used AS (SELECT query_id, game_title, regexp_replace(article, '\.[^.]*$', '') AS parent FROM cited WHERE position('.' IN article) > 0 GROUP BY ALL HAVING count(*) >= {X.SIBLINGS_IN_USE})"""


@query(rf"""WITH {EVIDENCE}, {_LADDER} SELECT DISTINCT l.query_id, l.game_title, l.article FROM ladder l JOIN used u ON l.query_id = u.query_id AND l.game_title = u.game_title AND regexp_replace(l.article, '\.[^.]*$', '') = u.parent
WHERE l.rel_rank <= {X.ACCOUNTABLE_RANK} AND position('.' IN l.article) > 0 AND NOT EXISTS (SELECT 1 FROM cited c WHERE c.query_id = l.query_id AND c.game_title = l.game_title AND c.article = l.article)""")
def skipped_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles ranked high and left uncited although two of their siblings are cited (answers cite ranks 1, 2 and 5); even questions have one ladder."""
    even = F.col("query_id") % 2 == 0
    e = evidence(spark, sf_dir).withColumns({"article": F.when(even, F.concat(F.lit("2.8."), "rel_rank")).otherwise(F.col("article")), "game_title": F.when(even, "Global Book").otherwise(F.col("game_title"))})
    cites = T.citation(F.col("game_title"), F.col("article"), F.col("page"))
    answers = e.where("rel_rank IN (1, 2, 5)").groupBy("query_id").agg(F.array_join(F.collect_list(cites), " and ").alias("answer"))
    return V.skipped_siblings(e, answers).select("query_id", "game_title", "article")


@query(rf"""WITH {EVIDENCE}, qw AS (SELECT query_id, w AS words FROM (SELECT query_id, regexp_extract_all(lower(question), '[a-z0-9]+(?:\.[a-z0-9]+)*') AS w FROM questions)),
a AS (SELECT query_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM qw),
ew AS (SELECT query_id, chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[a-z0-9]+)*') AS words FROM evidence),
b AS (SELECT query_id, chunk_id, unnest(words) AS word, unnest(range(len(words))) AS j FROM ew),
hit AS (SELECT query_id, chunk_id, i, j, i - row_number() OVER (PARTITION BY query_id, chunk_id, i - j ORDER BY i) AS island FROM a JOIN b USING (query_id, word)),
run AS (SELECT query_id, chunk_id, max(n) AS run FROM (SELECT query_id, chunk_id, i - j AS d, island, count(*) AS n FROM hit GROUP BY ALL) GROUP BY ALL)
SELECT query_id, chunk_id, coalesce(run, 0) AS run, coalesce(run, 0) > {X.VERBATIM_LIMIT} AS violates FROM evidence LEFT JOIN run USING (query_id, chunk_id)""")
def verbatim_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of words that a question shares with each of its excerpts."""
    e = evidence(spark, sf_dir).join(questions(spark, sf_dir).select("query_id", "question"), "query_id")
    return e.select("query_id", "chunk_id", V.longest_common_run(F.col("question"), F.col("text"))["run"].alias("run")).withColumn("violates", F.col("run") > X.VERBATIM_LIMIT)


@query()
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence and gap claims in answers about each question's evidence; text spans, so checked by unit tests."""
    e = evidence(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_set("game_title")).alias("books"))
    book = F.get("books", F.lit(0))
    said = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("Under the "), book, F.lit(" it does not state a deadline."))).otherwise(F.concat(F.lit("There is no relevant text in the "), book, F.lit(".")))
    answer = F.concat(said, F.lit(" The excerpts do not state a fee for late entry of teams."))
    return e.select("query_id", V.silence_violations(answer, F.col("books")).alias("silence"), V.excerpt_framed_subjects(answer).alias("gaps")).select("query_id", F.size("silence").alias("n_silence"), F.array_join("silence", " | ").alias("sentences"), F.array_join(F.flatten("gaps"), " ").alias("gap_subject"))


@query(rf"WITH {EVIDENCE} SELECT query_id, CASE WHEN count(*) = 0 THEN 'no_evidence' WHEN max(CASE WHEN rel_rank = 1 THEN chunk_id END) % 4 = 0 THEN 'uncited' ELSE 'answered' END AS outcome, count(*) AS n FROM evidence GROUP BY query_id")
def outcome_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir).groupBy("query_id").agg(F.max(F.when(F.col("rel_rank") == 1, F.struct("chunk_id", "game_title", "article", "page"))).alias("top"), F.count("*").alias("n"))
    answer = F.when(F.col("top.chunk_id") % 4 == 0, "Nothing cited here.").otherwise(F.concat(F.lit("Held "), T.citation(F.col("top.game_title"), F.col("top.article"), F.col("top.page"))))
    return e.select("query_id", V.outcome(answer, F.col("n")).alias("outcome"), "n")


