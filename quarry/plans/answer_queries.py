"""Answers and what holds them to their evidence, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fixed as X
from quarry.functions import text as T
from quarry.operators import aliases as A
from quarry.operators import lexical as L
from quarry.operators import metrics as M
from quarry.operators import precedence as P
from quarry.operators import verify as V
from quarry.plans import ask
from quarry.plans.corpus import CHUNKS, QUESTIONS, as_long, chunks, query, questions, sql_content, table
from quarry.plans.precedence_queries import RESOLVED, resolved, stage_relations, staged
from quarry.plans.retrieval_queries import EVIDENCE, evidence, inputs, retriever
from quarry.plans.text_queries import _ANSWER, _answers
from quarry.sources import store


def _frequency(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    d = table(spark, sf_dir, "documents")
    return L.document_counts(d), d.count()


def _drafts(drafts: DataFrame):
    k, book = F.col("query_id") % 4, F.col("top.game_title")
    return F.when(k == 0, ask.quoting_writer(drafts)).when(k == 1, "Held (Nowhere Book — Article 9.9, p.3).").when(k == 2, F.concat(F.lit("The "), book, F.lit(" does not state a deadline."))).otherwise("Nothing to cite here.")


def _second(drafts: DataFrame):
    """Half of the writers mend what they are told."""
    return F.when(F.col("query_id") % 8 < 4, ask.quoting_writer(drafts)).otherwise(_drafts(drafts))


@query(rf"""WITH {RESOLVED}, e AS (SELECT DISTINCT query_id FROM evidence), k AS (SELECT q.query_id, e.query_id IS NOT NULL AS has, q.query_id % 4 AS k, q.query_id % 8 < 4 AS mends FROM questions q LEFT JOIN e USING (query_id))
SELECT query_id, CASE WHEN NOT has THEN 'no_evidence' WHEN k = 0 THEN 'answered' WHEN k = 3 THEN 'uncited' WHEN mends THEN 'answered' ELSE 'withheld' END AS outcome,
  CASE WHEN NOT has OR k IN (0, 3) THEN 0 WHEN mends THEN 1 ELSE 2 END AS n_errors, has AND k IN (1, 2) AS retried FROM k""")
def ask_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that cite well pass, others are written again once; those that still cite nothing real, or call a book in evidence silent, are withheld."""
    e = staged(spark, sf_dir)
    a = ask.answer(questions(spark, sf_dir), e, *_frequency(spark, sf_dir), resolved(spark, sf_dir), _drafts, _second)
    return a.select("query_id", "outcome", F.size("errors").alias("n_errors"), "retried")


@query(rf"""WITH {EVIDENCE}, t AS (SELECT query_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[a-z0-9]+)*')[1:40] AS w FROM evidence WHERE rel_rank = 1)
SELECT query_id, 1 AS cites, 0 AS silence, 0 AS gap, 0 AS skipped, CAST(len(w) > {X.VERBATIM_LIMIT} AS INTEGER) AS verbatim FROM t""")
def fault_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five checks of an answer that copies the first forty words of the best excerpt and cites a book that is not there."""
    e = evidence(spark, sf_dir)
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(X.CONTENT), 0), 1, 40)
    answers = e.where("rel_rank = 1").select("query_id", F.concat(F.array_join(words, " "), F.lit(" (Nowhere — p.1).")).alias("answer"))
    none = spark.createDataFrame([], "query_id long, top_findings array<string>")
    f = V.faults(answers, e, *_frequency(spark, sf_dir), none)
    return f.select("query_id", *(F.size(c).alias(c) for c in V.FAULTS))


@query(rf"""WITH {RESOLVED}, top AS (SELECT DISTINCT query_id FROM resolved WHERE top), w AS (SELECT query_id, len(list_distinct(({sql_content('text')})[1:6])) AS n FROM evidence WHERE rel_rank = 1),
c AS (SELECT w.query_id, CAST(top.query_id IS NOT NULL AND w.query_id % 3 < 2 AS INTEGER) + CAST(w.query_id % 3 = 0 AND n >= {X.GAP_MIN_TERMS} AS INTEGER) AS n_gaps FROM w LEFT JOIN top USING (query_id)) SELECT * FROM c WHERE n_gaps > 0""")
def false_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without citations that claim a gap: contradicted by a finding on the first excerpt, or by an excerpt with the very words said to be missing."""
    e = staged(spark, sf_dir)
    words = F.array_join(F.slice(T.content_words(F.col("text")), 1, 6), " ")
    k = F.col("query_id") % 3
    said = F.when(k == 0, F.concat(F.lit("The retrieved excerpts do not state "), words)).when(k == 1, "The retrieved excerpts do not state zzyzx qwertyx plughx.").otherwise("Nothing is claimed.")
    answers = e.where("rel_rank = 1").select("query_id", said.alias("answer"))
    gaps = V.false_gaps(answers, e, *_frequency(spark, sf_dir), P.top_findings(resolved(spark, sf_dir)))
    return gaps.select("query_id", F.size("gap").alias("n_gaps"))


@query(rf"""WITH {EVIDENCE}, h AS (SELECT query_id, bool_or(query_id % 4 = 0 OR regexp_matches(lower(text), 'typically|usually|generally|commonly')) AS hedged FROM evidence GROUP BY query_id)
SELECT query_id, CASE WHEN hedged OR query_id % 2 = 1 THEN '' ELSE 'typically,generally' END AS unattributable FROM h""")
def hedge_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hedges of the answers to even questions that no excerpt hedges with; those to each fourth question have one that says "usually"."""
    e = evidence(spark, sf_dir).withColumn("text", F.when((F.col("query_id") % 4 == 0) & (F.col("rel_rank") == 1), F.concat("text", F.lit(" It is Usually so."))).otherwise(F.col("text")))
    answer = F.when(F.col("query_id") % 2 == 0, "It is typically, and Generally, held.").otherwise("It is held.")
    g = e.groupBy("query_id").agg(F.collect_list("text").alias("texts"))
    return g.select("query_id", F.array_join(V.unattributable_hedges(answer, F.col("texts")), ",").alias("unattributable"))


_NAMED = "CASE query_id % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'es' END"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, searched, mentioned, said): books searched, named by the question, and named by the answer's prose."""
    k = F.col("query_id") % 3
    q = questions(spark, sf_dir).withColumn("question", F.concat("question", F.when(k == 0, " What of BOOK FR?").when(k == 1, " And in Book Es, or global?").otherwise("")))
    names = chunks(spark, sf_dir).select(F.col("game").alias("slug"), F.lower("game_title").alias("alias")).distinct()
    searched = evidence(spark, sf_dir).groupBy("query_id").agg(F.collect_set("game").alias("found"))

    def books(texts: DataFrame, name: str) -> DataFrame:
        return A.phrase_hits(texts, names).groupBy(F.col("id").alias("query_id")).agg(F.collect_set("slug").alias(name))

    asked = books(q.select(F.col("query_id").alias("id"), F.col("question").alias("text")), "mentioned")
    answer = F.when(F.col("query_id") % 2 == 0, "Under Book FR it is so (Book DE — p.1).").otherwise("It is so (Book FR — p.1).")
    prose = books(q.select(F.col("query_id").alias("id"), V.stripped(answer).alias("text")), "said")
    j = q.select("query_id", "game").join(searched, "query_id").join(asked, "query_id", "left").join(prose, "query_id", "left")
    none = T.empty_strings()
    return j.select("query_id", F.array_union("found", F.array_compact(F.array("game"))).alias("searched"), F.coalesce("mentioned", none).alias("mentioned"), F.coalesce("said", none).alias("said"))


_SEARCHED = "s AS (SELECT query_id, list_distinct(list_append(list(DISTINCT e.game), coalesce(any_value(q.game), 'global'))) AS searched FROM evidence e JOIN questions q USING (query_id) GROUP BY query_id)"


@query(rf"WITH {EVIDENCE}, {_SEARCHED} SELECT query_id, coalesce(CASE WHEN NOT list_contains(searched, {_NAMED}) THEN {_NAMED} END, '') AS unsearched FROM s")
def title_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that a question names and that were not searched (the global one aside)."""
    return _named(spark, sf_dir).select("query_id", F.array_join(A.mismatch(F.col("mentioned"), F.col("searched")), ",").alias("unsearched"))


@query(rf"WITH {EVIDENCE}, {_SEARCHED} SELECT query_id, CASE WHEN query_id % 2 = 0 AND query_id % 3 = 0 AND NOT list_contains(searched, 'fr') THEN 'fr' ELSE '' END AS misattributed FROM s")
def misattribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsearched books that the question names and the answer's prose uses; a book in a citation is not prose."""
    return _named(spark, sf_dir).select("query_id", F.array_join(A.misattribution(F.col("mentioned"), F.col("said"), F.col("searched")), ",").alias("misattributed"))


@query(rf"""WITH {CHUNKS}, {_ANSWER}, first AS (SELECT chunk_id, 0 AS n, 9 AS start, game_title || ' - Article ' || article || ', p. ' || page AS text, game_title || ' — Article ' || article || ', p.' || page AS locator, CAST(chunk_id AS VARCHAR) AS found FROM answers WHERE article <> ''),
again AS (SELECT chunk_id, CASE WHEN article <> '' THEN 1 ELSE 0 END AS n, position('(' || game_title || ' — p.' IN answer) AS start, game_title || ' — p.' || (page + 1) AS text, game_title || ' — p.' || (page + 1) AS locator, NULL AS found FROM answers)
SELECT chunk_id, n, start, start + length(text) AS "end", text, locator, found FROM (SELECT * FROM first UNION ALL SELECT * FROM again)""")
def citation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an answer's citations stand, and the excerpt that each means."""
    a = _answers(spark, sf_dir)
    answers = a.select(F.col("chunk_id").alias("query_id"), "answer")
    own = a.select(F.col("chunk_id").alias("query_id"), "chunk_id", "game_title", "article", "page", F.lit(1).alias("read_pos"))
    s = V.spans_of(answers, own)
    return s.select(F.col("query_id").alias("chunk_id"), F.col("n").cast("int").alias("n"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text", "locator", F.array_join("chunk_ids", ",").alias("found"))


@query(rf"WITH {CHUNKS}, {_ANSWER} SELECT chunk_id, replace(answer, '(' || game_title || ' — p.' || (page + 1) || ')', '') AS prose, CASE WHEN article <> '' THEN 2 ELSE 1 END AS n_cites, true AS whole FROM answers")
def claim_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without their citations, and cut at them into pieces that join to the whole again."""
    s = _answers(spark, sf_dir).withColumn("s", V.segments_of(F.col("answer")))
    return s.select("chunk_id", V.stripped(F.col("answer")).alias("prose"), F.size(F.filter("s", lambda x: x["kind"] == "cite")).alias("n_cites"), (F.array_join("s.text", "") == F.col("answer")).alias("whole"))


@query(rf"WITH {CHUNKS}, {_ANSWER} SELECT chunk_id, '0-3' || CASE WHEN length(answer) >= 8 THEN ',4-8' ELSE '' END AS spans FROM answers")
def usable_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of spans that are out of order, overlap, run out of the text or name another text, those that can be shown."""
    a = F.col("answer")

    def span(i, j, text=None):
        return F.struct(F.lit(i).alias("start"), F.lit(j).alias("end"), (F.substring(a, i + 1, j - i) if text is None else text).alias("text"))

    given = F.array(span(4, 8), span(0, 3), span(2, 6), span(9, 12, F.lit("???")), span(5, 100_000), span(8, 8))
    s = V.usable(a, given)
    return _answers(spark, sf_dir).select("chunk_id", F.array_join(F.transform(s, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"))


@query(r"""SELECT conv_id, turn, CASE WHEN t IS NULL OR t = '' THEN 0 ELSE len(regexp_extract_all(t, '\n{2,}')) + CASE WHEN regexp_matches(t, '\n{2,}$') THEN 0 ELSE 1 END END AS paragraphs, coalesce(length(t), 0) AS covered
FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || repeat(chr(10), 3) || 'Second' || repeat(chr(10), 2) ELSE repeat(chr(10), 2) || text END AS t FROM conversations)""")
def paragraph_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each turn with the blank lines after them, gapless; a null turn has none."""
    k, t = F.col("turn") % 3, F.col("text")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(k == 0, t).when(k == 1, F.concat(t, F.lit("\n\n\nSecond\n\n"))).otherwise(F.concat(F.lit("\n\n"), t)).alias("t")).withColumn("p", V.paragraphs(F.col("t")))
    return c.select("conv_id", "turn", F.size("p").cast("long").alias("paragraphs"), F.aggregate("p", F.lit(0), lambda acc, x: acc + x["end"] - x["start"]).cast("long").alias("covered"))


@query(rf"WITH {CHUNKS}, {_ANSWER} SELECT chunk_id, trim(answer) || chr(10) || chr(10) || 'Searched: ' || game_title || chr(10) || 'Corpus: abcd1234' || chr(10) || CASE WHEN chunk_id % 2 = 0 THEN 'Check: no fault found' ELSE 'Check: unsupported citation: ' || game_title || ' — p.' || (page + 1) END AS payload FROM answers")
def copy_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is put on the clipboard."""
    found = F.when(F.col("chunk_id") % 2 == 0, T.empty_strings()).otherwise(F.transform(F.slice(T.cited_locators(F.col("answer")), -1, 1), lambda c: F.concat(F.lit("unsupported citation: "), c)))
    return _answers(spark, sf_dir).select("chunk_id", V.copied(F.col("answer"), F.col("game_title"), F.lit("abcd1234"), found).alias("payload"))


@query(as_long(rf"""WITH {CHUNKS}, {_ANSWER} SELECT game_title, count(*) AS answers, count_if(chunk_id % 2 = 0) AS valid, round(avg(CASE WHEN chunk_id % 3 = 0 THEN 0.5 ELSE 1 END), 6) AS cited_fraction FROM answers WHERE article <> '' GROUP BY game_title""", "valid"))
def citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By book: answers all of whose citations are supported, and the mean share of paragraphs that carry one."""
    a = _answers(spark, sf_dir).where("article <> ''")
    own, other = T.citation(F.col("game_title"), F.col("article"), F.col("page")), T.citation(F.col("game_title"), F.col("article"), F.col("page") + 1)
    text = F.concat(F.lit("One "), F.when(F.col("chunk_id") % 2 == 0, own).otherwise(other), F.lit(".\n \n"), F.when(F.col("chunk_id") % 3 == 0, "No citation.").otherwise(F.concat(F.lit("Two "), own)))
    answers = a.select(F.col("chunk_id").alias("query_id"), text.alias("answer"), "game_title")
    allowed = a.select(F.col("chunk_id").alias("query_id"), F.array(T.locator(own)).alias("allowed"))
    c = M.citation_coverage(answers, allowed).join(answers.select("query_id", "game_title"), "query_id")
    return c.groupBy("game_title").agg(F.count("*").alias("answers"), F.count_if("valid").alias("valid"), F.round(F.avg(F.col("cited") / F.col("paragraphs")), 6).alias("cited_fraction"))


#: The questions as they are routed: one that names no game gets the one book whose slug is among its words.
_ROUTED = QUESTIONS.replace("questions AS (", "unrouted AS (", 1) + """, w AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+'))) AS slug FROM unrouted WHERE game IS NULL), h AS (SELECT query_id, min(slug) AS slug FROM w WHERE slug IN (SELECT game FROM chunks) GROUP BY query_id HAVING count(*) = 1),
questions AS (SELECT query_id, question, coalesce(game, slug) AS game FROM unrouted LEFT JOIN h USING (query_id))"""


def _of_route(sql: str) -> str:
    """SQL over evidence, with the questions routed before anything is retrieved."""
    return sql.replace(QUESTIONS, _ROUTED, 1)


def _retriever(spark: SparkSession, sf_dir: str) -> ask.Retriever:
    """Retrieves for the routed questions, with the relations that the test texts lack; written once, as it is read several times."""
    return lambda routed: store.once("routed", inputs(spark, sf_dir), lambda: stage_relations(retriever(spark, sf_dir)(routed)))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select(F.col("game").alias("slug")).distinct()


def _state(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return ask.search(questions(spark, sf_dir), _catalog(spark, sf_dir), _retriever(spark, sf_dir))


@query(_of_route(rf"""WITH {RESOLVED}, d AS (SELECT query_id, count(*) AS n_docs, count(DISTINCT game) FILTER (game <> 'global') AS n_books FROM evidence GROUP BY query_id), f AS (SELECT query_id, count(*) AS n FROM resolved GROUP BY query_id)
SELECT q.query_id, q.game AS routed, coalesce(n_docs, 0) AS n_docs, coalesce(n_books, 0) AS n_books, coalesce(f.n, 0) AS n_findings, n_docs IS NOT NULL AS noted FROM questions q LEFT JOIN d USING (query_id) LEFT JOIN f USING (query_id)"""))
def search_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route, retrieve from the book of the route, resolve, and stop."""
    s = _state(spark, sf_dir)
    docs = s["evidence"].groupBy("query_id").agg(F.count("*").alias("n_docs"), F.countDistinct(F.when(F.col("game") != "global", F.col("game"))).alias("n_books"))
    found = s["findings"].groupBy("query_id").agg(F.count("*").alias("n_findings"))
    j = s["routed"].select("query_id", F.col("game").alias("routed")).join(docs, "query_id", "left").join(found, "query_id", "left").join(s["notes"], "query_id", "left")
    return j.select("query_id", "routed", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_books", "n_findings")), F.col("note").isNotNull().alias("noted"))


@query(_of_route(rf"""WITH {RESOLVED}, top AS (SELECT query_id, arg_min(CAST(chunk_id AS VARCHAR) || ':' || game, read_pos) AS t, count(*) AS n FROM evidence GROUP BY query_id)
SELECT q.query_id, q.game AS routed, t AS read_first, coalesce(n, 0) AS n_docs, CASE WHEN n IS NULL THEN 'no_evidence' ELSE 'answered' END AS outcome, false AS retried FROM questions q LEFT JOIN top USING (query_id)"""))
def ask_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: a routed question is answered from the chunks of its book."""
    s = ask.ask(questions(spark, sf_dir), _catalog(spark, sf_dir), _retriever(spark, sf_dir), *_frequency(spark, sf_dir))
    first = s["evidence"].groupBy("query_id").agg(F.min_by(F.concat(F.col("chunk_id").cast("string"), F.lit(":"), "game"), "read_pos").alias("read_first"), F.count("*").alias("n_docs"))
    j = s["routed"].select("query_id", F.col("game").alias("routed")).join(first, "query_id", "left").join(s["answers"], "query_id", "left")
    return j.select("query_id", "routed", "read_first", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "outcome", "retried")


@query(_of_route(rf"WITH {EVIDENCE} SELECT 'route' AS node, (SELECT count(*) FROM questions) AS n_rows, true AS timed, false AS failed UNION ALL SELECT 'retrieve', (SELECT count(*) FROM evidence), true, false UNION ALL SELECT 'answer', NULL, false, true UNION ALL SELECT 'report', NULL, false, false"))
def instrumented_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and times of each step; the third fails, which its record says, and the fourth is not run."""
    s = _state(spark, sf_dir)

    def broken() -> DataFrame:
        raise RuntimeError("no model")

    _, records = ask.instrumented([("route", lambda: s["routed"]), ("retrieve", lambda: s["evidence"]), ("answer", broken), ("report", lambda: s["notes"])])
    rows = [(r["node"], r["rows"], r["seconds"] is not None, r["error"] is not None) for r in records]
    return spark.createDataFrame(rows, "node string, n_rows long, timed boolean, failed boolean")


@query(rf"""WITH {EVIDENCE} SELECT q.query_id, bool_or(e.game = coalesce(q.game, 'global') AND (e.article = p OR starts_with(e.article, p || '.'))) AS includes_below, bool_or(e.game = coalesce(q.game, 'global') AND e.article = p || '.3' AND e.scope = 'global') AS includes_exact,
  NOT bool_or(e.game = x) AS excludes, bool_and(e.scope IN ('global', 'title')) AS scopes_ok, coalesce(any_value(q.game), 'none') = CASE WHEN q.query_id % 2 = 0 THEN 'de' ELSE 'none' END AS routed_ok
FROM (SELECT *, CAST(query_id % 9 + 1 AS VARCHAR) AS p, ['de', 'fr', 'es'][query_id % 3 + 1] AS x FROM questions) q JOIN evidence e USING (query_id) GROUP BY q.query_id""")
def retrieval_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions of the gate on each pool, another article and another excluded game for each question: an article with all below it, one exactly and in a scope, a game's absence, scopes, the route."""
    q = questions(spark, sf_dir)
    p = (F.col("query_id") % 9 + 1).cast("string")
    spec = q.select("query_id", F.coalesce("game", F.lit("global")).alias("asked"), p.alias("prefix"), F.array(*map(F.lit, ("de", "fr", "es")))[(F.col("query_id") % 3).cast("int")].alias("banned"), (F.coalesce("game", F.lit("none")) == F.when(F.col("query_id") % 2 == 0, "de").otherwise("none")).alias("routed_ok"))
    e = evidence(spark, sf_dir).join(spec, "query_id")
    own = F.col("game") == F.col("asked")
    below = (F.col("article") == F.col("prefix")) | F.col("article").startswith(F.concat("prefix", F.lit(".")))
    exact = (F.col("article") == F.concat("prefix", F.lit(".3"))) & (F.col("scope") == "global")
    return e.groupBy("query_id").agg(F.bool_or(own & below).alias("includes_below"), F.bool_or(own & exact).alias("includes_exact"), (~F.bool_or(F.col("game") == F.col("banned"))).alias("excludes"), F.bool_and(F.col("scope").isin("global", "title")).alias("scopes_ok"), F.first("routed_ok").alias("routed_ok"))


@query(rf"""WITH {CHUNKS}, {_ANSWER}, w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[a-z0-9]+)*') AS w, regexp_matches(lower(text), 'typically|usually|generally|commonly') AS hedged FROM chunks)
SELECT chunk_id, regexp_matches(answer, '(?i)as held') AS required, regexp_matches(answer, '(?i)see below|see above') AS required_any, NOT regexp_matches(answer, '(?i)withdrawn') AS forbidden_absent, article <> '' AND page <= 20 AS cites_early_page,
  article NOT LIKE '2.%' AS forbidden_citation_absent, false AS auto_citations, hedged OR chunk_id % 2 = 1 AS auto_hedges, chunk_id % 2 = 1 OR len(w.w) <= {X.VERBATIM_GATE} AS auto_verbatim FROM answers JOIN w USING (chunk_id)""")
def answer_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions of the gate on each answer: patterns and citations required and forbidden, and the three that hold for every answer; even ones hedge and copy thirty words."""
    c = chunks(spark, sf_dir).select("chunk_id", "text")
    a = _answers(spark, sf_dir).join(c, "chunk_id")
    copy = F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit(X.CONTENT), 0), 1, 30), " ")
    full = a.withColumn("answer", F.when(F.col("chunk_id") % 2 == 0, F.concat("answer", F.lit(" It typically is. "), copy)).otherwise(F.col("answer")))
    cites = full.withColumn("cites", T.cited_locators(F.col("answer")))
    t = F.col("answer")
    early = F.exists("cites", lambda x: x.contains("— Article ") & (F.regexp_extract(x, r"p\.(\d+)$", 1).cast("int") <= 20))
    banned = F.exists("cites", lambda x: F.regexp_extract(x, r"— Article (\S+?), p", 1).startswith("2."))
    own = F.array(T.locator(T.citation(F.col("game_title"), F.col("article"), F.col("page"))))
    run = V.longest_common_run(t, F.col("text"))["run"]
    return cites.select("chunk_id", t.rlike("(?i)as held").alias("required"), (t.rlike("(?i)see below") | t.rlike("(?i)see above")).alias("required_any"), (~t.rlike("(?i)withdrawn")).alias("forbidden_absent"), early.alias("cites_early_page"), (~banned).alias("forbidden_citation_absent"),
                        (F.size(T.unsupported(t, own)) == 0).alias("auto_citations"), (F.size(V.unattributable_hedges(t, F.array("text"))) == 0).alias("auto_hedges"), (run <= X.VERBATIM_GATE).alias("auto_verbatim"))
