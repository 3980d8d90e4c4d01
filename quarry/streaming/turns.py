"""Turns of conversations as a stream: numbered, charged and refused by the state kept of each conversation.

A conversation's state is its last number, what it has spent, the time of its
latest turn and the number of each turn recorded.  A micro-batch's turns of one
conversation are taken in the order of their times; across micro-batches the
order is that of arrival.  Outcomes:

- ``recorded``: the turn has the next number and its cost is added;
- ``late``: as recorded, but it was asked before a turn that has a number already;
- ``repeated``: a turn of this id is recorded; nothing changes, its number is told;
- ``refused``: what is spent and the estimate together exceed the ceiling (strictly); nothing changes.

Every batch is written under its own number, so a batch that runs again after
a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quarry.functions import fixed as X

TURN = "conversation_id string, turn_id string, asked_at timestamp, cost_usd double"
OUTCOME = f"{TURN}, seq long, outcome string, spent_usd double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Recorder(StatefulProcessor):
    """Decides on the turns of one conversation after another."""

    def __init__(self, ceiling: float, estimate: float) -> None:
        self.ceiling, self.estimate = ceiling, estimate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "seq long, spent double, at timestamp")
        self.numbers = handle.getMapState("numbers", "turn_id string", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turns = pd.concat(list(rows)).sort_values(["asked_at", "turn_id"], kind="stable")
        seq, spent, at = self.latest.get() if self.latest.exists() else (0, 0.0, None)
        told, first = [], seq
        for r in turns.itertuples():
            number, outcome = None, "refused"
            if self.numbers.containsKey((r.turn_id,)):
                number, outcome = self.numbers.getValue((r.turn_id,))[0], "repeated"
            elif spent + self.estimate <= self.ceiling:
                seq += 1
                late = at is not None and r.asked_at < pd.Timestamp(at)
                number, outcome, spent = seq, "late" if late else "recorded", spent + r.cost_usd
                at = at if late else r.asked_at
                self.numbers.updateValue((r.turn_id,), (seq,))
            told.append((number, outcome, spent))
        if seq > first:
            self.latest.update((seq, spent, pd.Timestamp(at).to_pydatetime()))
        out = turns[["conversation_id", "turn_id", "asked_at", "cost_usd"]].reset_index(drop=True)
        out["seq"] = pd.array([t[0] for t in told], dtype="Int64")
        out["outcome"], out["spent_usd"] = [t[1] for t in told], [t[2] for t in told]
        yield out

    def close(self) -> None:
        pass


def outcomes(turns: DataFrame, ceiling: float = X.BUDGET_CONVERSATION, estimate: float = X.BUDGET_ESTIMATE) -> DataFrame:
    """A stream of turns (``TURN``) with what becomes of each (``OUTCOME``).

    A null cost is 0.  Turns without a conversation, an id or a time cannot be recorded and are left out.
    """
    t = turns.select("conversation_id", "turn_id", "asked_at", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd")).where("conversation_id is not null and turn_id is not null and asked_at is not null")
    return t.groupBy("conversation_id").transformWithStateInPandas(Recorder(ceiling, estimate), OUTCOME, "append", "none")


def record(turns: DataFrame, path: str, ceiling: float = X.BUDGET_CONVERSATION, estimate: float = X.BUDGET_ESTIMATE) -> StreamingQuery:
    """Takes what the stream ``turns`` has now into the log at ``path`` and ends; called again, it goes on from its checkpoint there."""
    spark = turns.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/turns/batch={number}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return outcomes(turns, ceiling, estimate).writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def log(spark: SparkSession, path: str) -> DataFrame:
    """What has become of all turns so far: ``OUTCOME`` and the number of the batch."""
    return spark.read.schema(f"{OUTCOME}, batch long").parquet(f"{path}/turns")


def replayed(turns: DataFrame, ceiling: float = X.BUDGET_CONVERSATION, estimate: float = X.BUDGET_ESTIMATE) -> DataFrame:
    """The log that turns of a finished table (``TURN`` and ``batch``, in which they arrived) come to, without state.

    Costs are not negative, so a conversation's recorded turns are its first
    ones of different ids, up to the ceiling.
    """
    arrival = ["batch", "asked_at", "turn_id"]
    each = turns.withColumn("again", F.row_number().over(W.partitionBy("conversation_id", "turn_id").orderBy(*arrival)) > 1)
    new = each.where("not again")
    order = W.partitionBy("conversation_id").orderBy(*arrival)
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    new = new.withColumns({"spent": F.coalesce(F.sum("cost_usd").over(earlier), F.lit(0.0)), "n": F.row_number().over(order), "late": F.coalesce(F.col("asked_at") < F.max("asked_at").over(earlier), F.lit(False))})
    over = F.col("spent") + estimate > ceiling
    new = new.withColumns({"seq": F.when(~over, F.col("n")), "outcome": F.when(over, "refused").when(F.col("late"), "late").otherwise("recorded")})
    told = new.where("seq is not null").select("conversation_id", "turn_id", F.col("seq").alias("known"))
    repeats = each.where("again").join(told, ["conversation_id", "turn_id"], "left").withColumn("outcome", F.when(F.col("known").isNull(), "refused").otherwise("repeated"))
    columns = ["conversation_id", "turn_id", "batch", "seq", "outcome"]
    return new.select(*columns).unionByName(repeats.withColumnRenamed("known", "seq").select(*columns)).withColumn("seq", F.col("seq").cast("long"))
