"""Conversation history as an append-only log and views of its latest state.

Stock tables take no updates, so creating, renaming and deleting are rows; a
view keeps the latest of each conversation and drops those whose latest is a
deletion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TITLE = 60
LOG = "conversation_id string, at timestamp, action string, title string"
TURNS = "conversation_id string, asked_at timestamp, question string, response_json string, fingerprint string, cost_usd double"


def title_of(question: Column) -> Column:
    return F.substring(F.trim(question), 1, TITLE)


def latest(log: DataFrame) -> DataFrame:
    """(conversation_id, title, created_at, updated_at) of the conversations that stand; the last rename names them."""
    g = log.groupBy("conversation_id").agg(
        F.max_by("action", "at").alias("last"), F.max_by("title", F.when(F.col("title").isNotNull(), F.col("at"))).alias("title"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    return g.where("last <> 'delete'").drop("last")


def turns_of(turns: DataFrame, standing: DataFrame, live_fingerprint: str) -> DataFrame:
    """Turns of standing conversations, numbered by time; stale if asked of another corpus."""
    seq = F.row_number().over(W.partitionBy("conversation_id").orderBy("asked_at", "question"))
    kept = turns.join(standing.select("conversation_id"), "conversation_id", "left_semi")
    return kept.withColumns({"seq": seq, "stale": F.coalesce(F.col("fingerprint") != live_fingerprint, F.lit(True))})


def summaries(turns: DataFrame) -> DataFrame:
    """(conversation_id, turn_count, games, stale): games of the responses in the order first seen; bad JSON counts for none."""
    docs = F.from_json("response_json", "struct<docs:array<struct<game:string>>>")["docs"]["game"]
    seen = turns.select("conversation_id", "seq", F.posexplode_outer(docs).alias("pos", "game")).where("game is not null")
    first = seen.groupBy("conversation_id", "game").agg(F.min(F.struct("seq", "pos")).alias("at"))
    games = first.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("at", "game")))["game"].alias("games"))
    counts = turns.groupBy("conversation_id").agg(F.count("*").alias("turn_count"), F.bool_or("stale").alias("stale"))
    return counts.join(games, "conversation_id", "left").select("conversation_id", "turn_count", F.coalesce("games", F.array().cast("array<string>")).alias("games"), "stale")


def check_unique(turns: DataFrame) -> DataFrame:
    """(conversation_id, seq) given more than once: what a constraint would refuse."""
    return turns.groupBy("conversation_id", "seq").agg(F.count("*").alias("n")).where("n > 1")


def get_or_create(asked: DataFrame, standing: DataFrame) -> DataFrame:
    """(turn_id, conversation_id, created, title) of turns (turn_id, conversation_id or null, question): the conversation named if it stands, else a new one with the question as title."""
    known = standing.select(F.col("conversation_id").alias("found"))
    j = asked.join(known, asked["conversation_id"] == known["found"], "left")
    new = F.concat(F.lit("c"), F.sha2(F.concat_ws("|", "turn_id", "question"), 256).substr(1, 16))
    return j.select("turn_id", F.coalesce("found", new).alias("conversation_id"), F.col("found").isNull().alias("created"), F.when(F.col("found").isNull(), title_of(F.col("question"))).alias("title"))


def budget_snapshot(spend: DataFrame, today: str, earlier: float) -> DataFrame:
    """(conversation_id, day, conversation, session, project) of spend (conversation_id, asked_at, usd, session): sums in dollars; ``earlier``: the project's before the log begins."""
    day = F.substring(F.date_format("asked_at", "yyyy-MM-dd"), 1, 10)
    rows = spend.withColumn("today", F.when(day == today, F.col("usd")).otherwise(0.0))
    whole = rows.agg(F.coalesce(F.sum("today"), F.lit(0.0)).alias("day"), F.coalesce(F.sum(F.when(F.col("session"), F.col("usd"))), F.lit(0.0)).alias("session"), (F.coalesce(F.sum("usd"), F.lit(0.0)) + earlier).alias("project"), F.lit(1).alias("one"))
    each = rows.groupBy("conversation_id").agg(F.sum("usd").alias("conversation"), F.lit(1).alias("one"))
    return each.join(F.broadcast(whole), "one").drop("one")  # one row
