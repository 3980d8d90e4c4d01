"""Records, conversations, costs and gate reports over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fixed as X
from quarry.functions import text as T
from quarry.operators import history as H
from quarry.operators import metrics as M
from quarry.operators import precedence as P
from quarry.operators import records as R
from quarry.operators import verify as V
from quarry.plans import ask
from quarry.plans.corpus import CHUNKS, QUESTIONS, as_long, chunks, query, questions, table
from quarry.plans.precedence_queries import RESOLVED, resolved, staged
from quarry.plans.retrieval_queries import EVIDENCE, evidence
from quarry.plans.source_queries import _RUNS, _runs
from quarry.sources import store
from quarry.streaming import turns as U

# Records


@query(rf"""WITH {RESOLVED}, d AS (SELECT query_id, count(*) AS n_docs, string_agg(chunk_id || ':' || rel_rank, ',' ORDER BY read_pos) AS ranks, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY chunk_id) FILTER (rel_rank <= 4) AS accountable FROM evidence GROUP BY query_id),
f AS (SELECT query_id, count(*) AS n_findings, count_if(top) AS n_top FROM resolved GROUP BY query_id)
SELECT q.query_id, CASE WHEN q.query_id % 2 = 0 THEN 'ask' ELSE 'search' END AS mode, CASE WHEN q.query_id % 2 = 0 THEN 'answered' END AS outcome, CASE WHEN q.query_id % 2 = 0 THEN 1 ELSE 0 END AS n_spans, coalesce(n_docs, 0) AS n_docs, ranks, coalesce(accountable, '') AS accountable,
  coalesce(n_findings, 0) AS n_findings, CAST(coalesce(n_top, 0) AS BIGINT) AS n_top, n_docs IS NOT NULL AS noted, round(CASE WHEN q.query_id % 2 = 0 THEN 100 * 0.15 + 20 * 0.6 + CASE WHEN q.query_id % 4 = 0 THEN 50 * 0.15 + 10 * 0.6 ELSE 0 END ELSE 0 END / 1000000, 9) AS cost_usd, q.query_id % 4 = 0 AS retried, 26 AS n_fields
FROM questions q LEFT JOIN d USING (query_id) LEFT JOIN f USING (query_id)""")
def response_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each question: even ones are answered, every fourth in two goes; the others are searches."""
    e, found = staged(spark, sf_dir), resolved(spark, sf_dir)
    q, i = questions(spark, sf_dir), F.col("query_id")
    top = e.where("read_pos = 1").select("query_id", F.concat(F.lit("It is so "), T.citation(F.col("game_title"), F.col("article"), F.col("page")), F.lit(".")).alias("said"))
    call = lambda node, a, b: F.struct(F.lit(node).alias("node"), F.lit(a).cast("long").alias("input"), F.lit(b).cast("long").alias("output"))
    usage = F.when(i % 4 == 0, F.array(call("answer", 100, 20), call("answer.recite", 50, 10))).when(i % 2 == 0, F.array(call("answer", 100, 20))).otherwise(F.array().cast("array<struct<node:string,input:bigint,output:bigint>>"))
    turns = q.join(top, "query_id", "left").select(
        "query_id", F.concat(F.lit("t"), i).alias("turn_id"), F.lit("c1").alias("conversation_id"), F.lit("2026-01-01T00:00:00Z").alias("asked_at"), "question", "game", F.col("game").isNotNull().alias("forced_scope"), ask.scope_text(F.col("game"), F.lit(None).cast("string")).alias("scope"),
        F.when(i % 2 == 0, F.col("said")).alias("answer"), F.lit("answered").alias("outcome"), T.empty_strings().alias("errors"), usage.alias("usage"), F.lit(1).alias("duration_ms"))
    r = R.responses(turns, e, found, P.render_note(found, e), V.spans_of(turns.select("query_id", "answer"), e), "abcd1234", "gpt-4o-mini")
    ranks = F.array_join(F.transform("docs", lambda d: F.concat_ws(":", d["chunk_id"].cast("string"), F.col("ranks")[d["chunk_id"]].cast("string"))), ",")
    return r.select("query_id", "mode", "outcome", F.size("citation_spans").alias("n_spans"), F.size("docs").cast("long").alias("n_docs"), F.when(F.size("docs") > 0, ranks).alias("ranks"), F.array_join(F.transform("accountable", lambda x: x.cast("string")), ",").alias("accountable"),
                    F.size("findings").cast("long").alias("n_findings"), F.size("top_findings").cast("long").alias("n_top"), (F.col("note") != "").alias("noted"), F.round("cost_usd", 9).alias("cost_usd"), "retried", F.lit(len(r.columns) - 1).alias("n_fields"))


@query(rf"""WITH {RESOLVED} SELECT query_id, cite, arg_min(e.chunk_id, e.read_pos) AS found FROM (SELECT DISTINCT query_id, cite FROM resolved UNION SELECT query_id, 'Nowhere (p.1)' FROM questions) r LEFT JOIN evidence e USING (query_id, cite) GROUP BY query_id, cite""")
def finding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excerpt that a finding's place means; none for a place that is not in evidence."""
    cites = resolved(spark, sf_dir).select("query_id", "cite").unionByName(questions(spark, sf_dir).select("query_id", F.lit("Nowhere (p.1)").alias("cite"))).distinct()
    return R.find_cited(cites, staged(spark, sf_dir)).select("query_id", "cite", F.col("chunk_id").alias("found"))


@query(f"WITH {EVIDENCE} SELECT query_id AS turn_id, chunk_id, CASE WHEN query_id % 2 = 0 THEN chunk_id END AS found FROM evidence WHERE rel_rank = 1")
def turn_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's chunk among its own excerpts; odd turns have none of their own."""
    e = evidence(spark, sf_dir).select(F.col("query_id").alias("turn_id"), "chunk_id", "rel_rank")
    return R.view(e.where("rel_rank = 1").select("turn_id", "chunk_id"), e.where("turn_id % 2 = 0"))


@query(rf"WITH {CHUNKS} SELECT chunk_id, game || ':' || CASE WHEN article = '' THEN 'front' ELSE concat_ws(' § ', nullif(part, ''), article) END || ':' || (row_number() OVER (PARTITION BY game, part, article ORDER BY chunk_id) - 1) AS stored_id FROM chunks")
def chunk_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made of book, article and the place among the article's pieces.

    Pieces are numbered in ranges of the whole order; a piece's place is that
    less its article's first, so chunks without an article are in no one task.
    """
    article = F.when(F.col("article") == "", "front").otherwise(F.concat_ws(" § ", F.nullif("part", F.lit("")), "article"))
    c = chunks(spark, sf_dir).select("chunk_id", "game", "part", "article", F.concat_ws(":", "game", article).alias("base"))
    placed = M.ordinals(c, [F.col(x) for x in ("game", "part", "article", "chunk_id")], "place")
    first = placed.groupBy("game", "part", "article").agg(F.min("place").alias("first"))
    return placed.join(first, ["game", "part", "article"]).select("chunk_id", F.concat_ws(":", "base", (F.col("place") - F.col("first")).cast("string")).alias("stored_id"))


@query(rf"WITH {QUESTIONS} SELECT CAST(query_id AS VARCHAR) AS id, bucket FROM (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'gap' WHEN query_id % 3 = 1 THEN 'scope' ELSE 'plain' END AS bucket FROM questions) WHERE bucket IN ('gap', 'scope') AND query_id < 20")
def case_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of two buckets among those of given ids."""
    k = F.col("query_id") % 3
    cases = questions(spark, sf_dir).select(F.col("query_id").cast("string").alias("id"), F.when(k == 0, "gap").when(k == 1, "scope").otherwise("plain").alias("bucket"))
    return store.select_cases(cases, [str(i) for i in range(20)], ["gap", "scope"])


@query(rf"WITH {QUESTIONS} SELECT query_id, coalesce(game, 'global') || ':' || (query_id % 9 + 1) || CASE WHEN query_id % 2 = 0 THEN '.*' ELSE '' END || CASE WHEN query_id % 3 = 0 THEN ':[amendment]' ELSE '' END AS key FROM questions")
def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("query_id")
    return questions(spark, sf_dir).select("query_id", M.label_key(F.coalesce("game", F.lit("global")), (i % 9 + 1).cast("string"), i % 2 == 0, F.when(i % 3 == 0, "amendment")).alias("key"))


@query(rf"""WITH {CHUNKS}, {QUESTIONS} SELECT query_id AS label_id, chunk_id FROM questions q JOIN chunks c ON c.game = coalesce(q.game, 'global') AND (c.article = p OR (query_id % 2 = 0 AND starts_with(c.article, p || '.'))) AND (query_id % 3 <> 0 OR c.scope = 'amendment')""".replace("c.article = p OR", "c.article = (query_id % 9 + 1) || '.' || (query_id % 7 + 1) OR").replace("starts_with(c.article, p || '.')", "starts_with(c.article, (query_id % 9 + 1) || '.' || (query_id % 7 + 1) || '.')"))
def scoped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of one article exactly, or with all below it, some in one scope only."""
    i = F.col("query_id")
    article = F.concat_ws(".", (i % 9 + 1).cast("string"), (i % 7 + 1).cast("string"))
    labels = questions(spark, sf_dir).select(i.alias("label_id"), "query_id", F.coalesce("game", F.lit("global")).alias("game"), article.alias("prefix"), (i % 2 == 1).alias("exact"), F.when(i % 3 == 0, "amendment").alias("scope"))
    return M.resolve_labels(labels, chunks(spark, sf_dir)).select("label_id", "chunk_id")


# Conversations


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of conversations: a purchase deletes, each fourth row renames."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("conversation_id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "purchase", "delete").otherwise("turn").alias("action"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("title "), "event_id")).alias("title"))


_LOG = "log AS (SELECT CAST(user_id AS VARCHAR) AS cid, ts, CASE event_type WHEN 'purchase' THEN 'delete' ELSE 'turn' END AS what, CASE WHEN event_id % 4 = 0 THEN 'title ' || event_id END AS t FROM events), standing AS (SELECT cid, arg_max(t, ts) FILTER (WHERE t IS NOT NULL) AS title, min(ts) AS first, max(ts) AS last FROM log GROUP BY cid HAVING arg_max(what, ts) <> 'delete')"


@query(f"WITH {_LOG} SELECT cid AS conversation_id, title, row_number() OVER (ORDER BY last DESC, cid) AS place FROM standing")
def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing conversations of a log, the last changed first."""
    return M.ordinals(H.latest(_log(spark, sf_dir)), [F.desc("updated_at"), F.col("conversation_id")], "place").select("conversation_id", "title", "place")


@query(f"WITH {_LOG} SELECT cid AS conversation_id, title, first AS created_at, last AS updated_at FROM standing")
def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands of an append-only log: the last rename names a conversation, a deletion ends it."""
    return H.latest(_log(spark, sf_dir))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns with the games of their responses; each seventh response is no JSON, and some were asked of an older corpus."""
    c = table(spark, sf_dir, "conversations")
    games = F.when(F.col("turn") % 2 == 0, F.lit('{"docs":[{"game":"de"},{"game":"global"}]}')).otherwise(F.lit('{"docs":[{"game":"global"},{"game":"fr"}]}'))
    key = F.pmod(F.col("conv_id") * 10 + F.col("turn"), F.lit(7))
    return c.select(F.col("conv_id").cast("string").alias("conversation_id"), F.timestamp_seconds(F.col("turn")).alias("asked_at"), F.col("text").alias("question"), F.when(key == 0, "{broken").otherwise(games).alias("response_json"), F.when(F.col("conv_id") % 3 == 0, "old").otherwise("live").alias("fingerprint"), F.lit(0.001).alias("cost_usd"))


@query("""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS cid, conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS seq, (conv_id * 10 + turn) % 7 = 0 AS broken FROM conversations),
g AS (SELECT cid, seq, pos, CASE WHEN turn % 2 = 0 THEN ['de', 'global'] ELSE ['global', 'fr'] END[pos] AS game FROM t, (VALUES (1), (2)) v(pos) WHERE NOT broken),
f AS (SELECT cid, game, min(seq * 10 + pos) AS seen FROM g GROUP BY ALL), s AS (SELECT cid, string_agg(game, ',' ORDER BY seen) AS games FROM f GROUP BY cid)
SELECT cid AS conversation_id, count(*) AS turn_count, coalesce(any_value(games), '') AS games, any_value(conv_id) % 3 = 0 AS stale FROM t LEFT JOIN s USING (cid) GROUP BY cid""")
def conversation_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, games in the order first seen and staleness of conversations; a response that is no JSON counts for no game."""
    t = _turns(spark, sf_dir)
    seen = H.turns_of(t, t.select("conversation_id").distinct(), "live")
    return H.summaries(seen).withColumn("games", F.array_join("games", ","))


@query("SELECT conv_id || '-' || turn AS turn_id, CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id AS VARCHAR) END AS kept, conv_id % 2 = 1 AS created, CASE WHEN conv_id % 2 = 1 THEN left(trim(text, ' '), 60) END AS title FROM conversations")
def conversation_of_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations that stand stay in them; for the others a new one is made."""
    c = table(spark, sf_dir, "conversations")
    asked = c.select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), F.col("conv_id").cast("string").alias("conversation_id"), F.col("text").alias("question"))
    standing = c.where("conv_id % 2 = 0").select(F.col("conv_id").cast("string").alias("conversation_id")).distinct()
    g = H.get_or_create(asked, standing)
    return g.select("turn_id", F.when(~F.col("created"), F.col("conversation_id")).alias("kept"), "created", "title")


@query(f"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS cid, turn, turn % 3 AS batch, ceil(length(text) / 100) / 1000 AS usd FROM conversations),
n AS (SELECT *, row_number() OVER w AS n, coalesce(sum(usd) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, coalesce(turn < max(turn) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM t WINDOW w AS (PARTITION BY cid ORDER BY batch, turn))
SELECT cid AS conversation_id, CAST(turn AS VARCHAR) AS turn_id, CAST(batch AS BIGINT) AS batch, CASE WHEN spent + {X.BUDGET_ESTIMATE} <= {X.BUDGET_CONVERSATION} THEN n END AS seq,
  CASE WHEN spent + {X.BUDGET_ESTIMATE} > {X.BUDGET_CONVERSATION} THEN 'refused' WHEN late THEN 'late' ELSE 'recorded' END AS outcome FROM n
UNION ALL SELECT cid, '0', 1, 1, 'repeated' FROM t WHERE turn = 0""")
def recorded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as a stream of three runs, each going on from the checkpoint of the one before: turns arrive by their number modulo 3, the first ones again in the second run."""
    c = table(spark, sf_dir, "conversations")
    usd = F.ceil(F.length("text") / 100) / 1000
    turns = c.select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").cast("string").alias("turn_id"), F.timestamp_seconds(F.col("turn").cast("long")).alias("asked_at"), usd.alias("cost_usd"), (F.col("turn") % 3).alias("run"))
    path = store.work_path(spark, "turns")
    for run in range(3):
        arriving = turns.where(F.col("run") == run).drop("run")
        if run == 1:
            arriving = arriving.unionByName(turns.where("turn_id = '0'").drop("run"))
        arriving.write.mode("append").parquet(f"{path}/in")
        U.record(spark.readStream.schema(U.TURN).parquet(f"{path}/in"), path).awaitTermination()
    return U.log(spark, path).select("conversation_id", "turn_id", "batch", "seq", "outcome")


_SPEND = "s AS (SELECT CAST(user_id AS VARCHAR) AS cid, strftime(ts, '%Y-%m-%d') AS day, value / 1000000 AS usd, event_id % 2 = 0 AS session FROM events), d AS (SELECT max(day) AS today FROM s)"


@query(f"WITH {_SPEND} SELECT cid AS conversation_id, round((SELECT sum(usd) FROM s, d WHERE day = today), 9) AS day, round(sum(usd), 9) AS conversation, round((SELECT sum(usd) FROM s WHERE session), 9) AS session, round((SELECT sum(usd) + 0.5681 FROM s), 9) AS project FROM s GROUP BY cid")
def budget_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spent today, in each conversation, in this session and on the project."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("conversation_id"), F.col("ts").alias("asked_at"), (F.col("value") / 1_000_000).alias("usd"), (F.col("event_id") % 2 == 0).alias("session"))
    today = e.agg(F.date_format(F.max("asked_at"), "yyyy-MM-dd")).first()[0]
    s = H.budget_snapshot(e, today, 0.5681)
    return s.select("conversation_id", *(F.round(c, 9).alias(c) for c in ("day", "conversation", "session", "project")))


# Costs and times


@query("""SELECT conv_id, count(*) AS turns, round(sum(t * 0.15) / 1000000, 9) AS usd, CAST(NULL AS DOUBLE) AS usd_unpriced, 0.0 AS usd_counted, round((sum(t) * 0.15 + count(*) * 500 * 0.6) * 1.8 * 3 / 1000000 + count_if(turn % 2 = 0) * (700 * 0.15 + 15 * 0.6) / 1000000, 9) AS usd_ahead
FROM (SELECT conv_id, turn, greatest(1, length(coalesce(text, '')) // 4) AS t FROM conversations) GROUP BY conv_id""")
def chat_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of what was asked; of a model without a price unknown, or nothing where sums go on; and the estimate for three runs with retries, half of the cases routed."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", M.tokens_estimate(F.coalesce("text", F.lit(""))).alias("t"))
    zero = F.lit(0)
    ahead = M.generation_estimate(c.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("t").alias("prompt_tokens"), (F.col("turn") % 2 == 0).alias("auto")), 3, "gpt-4o-mini").groupBy(F.substring_index("query_id", "-", 1).alias("k")).agg(F.sum("usd").alias("ahead"))
    g = c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.round(F.sum(M.usd(F.col("t"), zero, F.lit("gpt-4o-mini"))), 9).alias("usd"), F.sum(M.usd(F.col("t"), zero, F.lit("unknown"))).alias("usd_unpriced"), F.sum(M.usd(F.col("t"), zero, F.lit("unknown"), 0.0)).alias("usd_counted"))
    return g.join(ahead, g["conv_id"].cast("string") == ahead["k"]).select("conv_id", "turns", "usd", "usd_unpriced", "usd_counted", F.round("ahead", 9).alias("usd_ahead"))


@query(as_long("SELECT role, count(*) AS model_calls, sum(t) AS tokens_in, sum(t) * 2 AS tokens_out, round(sum(t * 0.15 + t * 2 * 0.6) / 1000000, 9) AS total_usd, round(avg(t * 0.15 + t * 2 * 0.6) / 1000000, 9) AS mean_usd FROM (SELECT role, greatest(1, length(coalesce(text, '')) // 4) AS t FROM conversations) GROUP BY role", "tokens_in tokens_out"))
def cost_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("role", M.tokens_estimate(F.coalesce("text", F.lit(""))).alias("t"))
    usd = M.usd(F.col("t"), F.col("t") * 2, F.lit("gpt-4o-mini"))
    return c.groupBy("role").agg(F.count("*").alias("model_calls"), F.sum("t").alias("tokens_in"), F.sum(F.col("t") * 2).alias("tokens_out"), F.round(F.sum(usd), 9).alias("total_usd"), F.round(F.avg(usd), 9).alias("mean_usd"))


_TIMES = "times AS (SELECT event_type || CASE WHEN user_id % 2 = 0 THEN ' (forced)' ELSE ' (routed)' END AS node, CASE WHEN event_id % 10 > 0 THEN value END AS seconds FROM events UNION ALL SELECT 'total', sum(CASE WHEN event_id % 10 > 0 THEN value END) FROM events GROUP BY user_id)"
_PCT = "list_sort(list(seconds) FILTER (seconds IS NOT NULL))[CAST(greatest(1, least(count(seconds), round_even({q} * count(seconds) + 0.5, 0))) AS INTEGER)]"


@query(f"WITH {_TIMES} SELECT node, count(seconds) AS n, {_PCT.format(q='0.5')} AS p50, {_PCT.format(q='0.9')} AS p90, max(seconds) AS most, round(avg(seconds), 6) AS mean FROM times GROUP BY node")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of each node, those not run left out, split by how the question was routed; and totals per user."""
    e = table(spark, sf_dir, "events").withColumn("seconds", F.when(F.col("event_id") % 10 > 0, F.col("value")))
    branch = F.when(F.col("user_id") % 2 == 0, " (forced)").otherwise(" (routed)")
    each = e.select(F.concat("event_type", branch).alias("node"), "seconds")
    times = each.unionByName(e.groupBy("user_id").agg(F.sum("seconds").alias("seconds")).select(F.lit("total").alias("node"), "seconds"))
    p = M.percentiles(times, "node", "seconds", {"p50": 0.5, "p90": 0.9})
    g = times.groupBy("node").agg(F.max("seconds").alias("most"), F.round(F.avg("seconds"), 6).alias("mean"))
    return p.join(g, "node")


@query("SELECT event_type AS name, round(avg(value), 6) AS value, round(stddev_samp(value), 6) AS sd, count(value) AS n, 'mean of events' AS basis FROM events GROUP BY event_type UNION ALL SELECT 'first of ' || event_type, round(avg(value), 6), round(stddev_samp(value), 6), count(value), 'one event' FROM events WHERE event_id IN (SELECT min(event_id) FROM events GROUP BY event_type) GROUP BY event_type")
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and sample deviations, which one run does not have, with what they are based on."""
    e = table(spark, sf_dir, "events")
    first = e.groupBy("event_type").agg(F.min_by("value", "event_id").alias("value")).select(F.concat(F.lit("first of "), "event_type").alias("name"), "value", F.lit("one event").alias("basis"))
    m = M.measurements(e.select(F.col("event_type").alias("name"), "value", F.lit("mean of events").alias("basis")).unionByName(first).withColumn("unit", F.lit("ratio")))
    return m.select("name", F.round("value", 6).alias("value"), F.round("sd", 6).alias("sd"), "n", "basis")


@query("""WITH m AS (SELECT event_type AS name, avg(value) AS v, stddev_samp(value) AS sd, count(value) AS n FROM events GROUP BY event_type), u AS (SELECT * FROM m, (VALUES ('usd'), ('s'), ('ratio'), ('one'), ('none')) t(unit))
SELECT name, unit, CASE unit WHEN 'usd' THEN '$' || format('{:.6f}', v) || ' ± $' || format('{:.6f}', sd) WHEN 's' THEN format('{:.3f}', v) || ' s ± ' || format('{:.3f}', sd) || ' s' WHEN 'ratio' THEN format('{:.4f}', v) || ' ± ' || format('{:.4f}', sd) WHEN 'one' THEN format('{:.4f}', v) || ' (n=1)' ELSE 'not measured' END AS shown FROM u""")
def measurement_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements as text, by their unit, with their deviation or that there was one run."""
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("v"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
    u = g.withColumn("unit", F.explode(F.array(*map(F.lit, ("usd", "s", "ratio", "one", "none")))))
    return u.select("name", "unit", M.rendered(F.when(F.col("unit") != "none", F.col("v")), F.col("sd"), F.when(F.col("unit") == "one", 1).otherwise(F.col("n")), F.col("unit")).alias("shown"))


# Gate


@query("""WITH d AS (SELECT nullif(lang, 'es') AS routed, nullif(CASE WHEN doc_id % 10 = 0 THEN 'en' ELSE lang END, 'es') AS expected, doc_id FROM documents), a AS (SELECT count(*) AS n, round(avg(CAST(routed IS NOT DISTINCT FROM expected AS INTEGER)), 6) AS accuracy FROM d)
SELECT n, accuracy, 2 * n AS repeats, round(avg(CAST(routed IS NOT DISTINCT FROM again AS INTEGER)), 6) AS agreement FROM a, (SELECT routed, CASE WHEN k = 1 AND doc_id % 4 = 0 THEN 'xx' ELSE routed END AS again FROM d, (VALUES (1), (2)) v(k)) GROUP BY n, accuracy""")
def router_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the route is the one expected, and how often a repeat gives what the first gave; none agrees with none."""
    none = F.lit("es")
    d = table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", none).alias("routed"), F.nullif(F.when(F.col("doc_id") % 10 == 0, "en").otherwise(F.col("lang")), none).alias("expected"))
    runs = d.select(F.col("doc_id").alias("query_id"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("run"), "routed").withColumn("routed", F.when((F.col("run") == 1) & (F.col("query_id") % 4 == 0), "xx").otherwise(F.col("routed")))
    a = d.agg(F.count("*").alias("n"), F.round(F.avg(F.col("routed").eqNullSafe(F.col("expected")).cast("int")), 6).alias("accuracy"), F.lit(1).alias("one"))
    return a.join(M.self_agreement(runs).withColumn("one", F.lit(1)), "one").drop("one")


@query(as_long(f"""WITH r AS ({_RUNS}), p AS (SELECT assertion, case_id, bool_and(passed) AS ok, case_id % 2 = 0 AS known, bool_or(assertion = 'error' AND case_id % 5 = 0) AS broken FROM r GROUP BY ALL)
SELECT assertion, count_if(ok) AS passed, count_if(NOT ok AND NOT known AND NOT broken) AS failed, count_if(NOT ok AND known AND NOT broken) AS known_fail, count_if(broken) AS errors, CASE WHEN count_if(broken) > 0 THEN 2 WHEN count_if(NOT ok AND NOT known AND NOT broken) > 0 THEN 1 ELSE 0 END AS exit_code,
  CASE assertion WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS bucket_order FROM p GROUP BY assertion""", "passed failed known_fail errors"))
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies per bucket in a fixed order: a must-pass holds in all runs, a known failure is confirmed by any, a case that could not be run is an error and the exit code 2."""
    r = _runs(spark, sf_dir).withColumns({"known": F.col("case_id") % 2 == 0, "error": F.when((F.col("assertion") == "error") & (F.col("case_id") % 5 == 0), "failed to run")})
    place = F.when(F.col("assertion") == "error", 1).when(F.col("assertion") == "purchase", 2).otherwise(3)
    return M.verdict(r, "assertion").withColumn("bucket_order", place)


@query(f"WITH {EVIDENCE} SELECT query_id AS case_id, query_id % 4 <> 1 AS same_set, query_id % 4 NOT IN (1, 2) AS same_ranks, query_id % 4 NOT IN (1, 3) AS same_order FROM (SELECT DISTINCT query_id FROM evidence)")
def determinism_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does every repeat give the set, the ranks and the order that the first gave?  Some are made to differ."""
    e = evidence(spark, sf_dir).select(F.col("query_id").alias("case_id"), "chunk_id", F.col("rel_rank").alias("rank"), F.col("read_pos").alias("place"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("run"))
    k, late = F.col("case_id") % 4, F.col("run") == 2
    runs = e.where(~(late & (k == 1) & (F.col("rank") == 1))).withColumns({"rank": F.when(late & (k == 2), F.col("rank") + 1).otherwise(F.col("rank")), "place": F.when(late & (k == 3), -F.col("place")).otherwise(F.col("place"))})
    return M.probe(runs)
