"""Turns recorded by a stream against the same turns judged at once."""

import datetime
import random

from quarry.streaming import turns as U

FIELDS = ["conversation_id", "turn_id", "batch", "seq", "outcome"]


def at(k):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=k)


def run(spark, path, batches, ceiling=0.25):
    for rows in batches:
        spark.createDataFrame(rows, U.TURN).repartition(2).write.mode("append").parquet(f"{path}/in")
        U.record(spark.readStream.schema(U.TURN).parquet(f"{path}/in"), path, ceiling).awaitTermination()
    return sorted((tuple(r[f] for f in FIELDS) for r in U.log(spark, path).collect()), key=str)


def test_runs_from_a_checkpoint_give_what_one_pass_gives(spark, tmp_path):
    r = random.Random(6)
    batches = [[(f"c{r.randint(0, 6)}", f"t{r.randint(0, 40)}", at(r.randint(0, 50) + 20 * b), r.choice([0.0, 0.01, 0.07])) for _ in range(40)] for b in range(3)]
    got = run(spark, str(tmp_path), batches)
    flat = [(*row, b) for b, rows in enumerate(batches) for row in rows]
    want = U.replayed(spark.createDataFrame(flat, f"{U.TURN}, batch long"))
    assert got == sorted((tuple(x[f] for f in FIELDS) for x in want.collect()), key=str)
    assert {x[4] for x in got} == {"recorded", "late", "repeated", "refused"}


def test_outcomes(spark, tmp_path):
    one = [("a", "t1", at(5), 0.1), ("a", "t2", at(6), 0.1), (None, "t", at(1), 0.1), ("a", None, at(1), 0.1), ("a", "t0", None, 0.1), ("b", "t1", at(1), None)]
    two = [("a", "t1", at(5), 0.1), ("a", "t3", at(2), 0.05), ("a", "t4", at(9), 0.1), ("a", "t4", at(10), 0.1), ("b", "t1", at(1), 9.0)]
    got = run(spark, str(tmp_path), [one, two], ceiling=0.25)
    assert got == sorted(
        [("a", "t1", 0, 1, "recorded"), ("a", "t2", 0, 2, "recorded"), ("b", "t1", 0, 1, "recorded"), ("a", "t1", 1, 1, "repeated"), ("a", "t3", 1, 3, "late"), ("a", "t4", 1, None, "refused"), ("a", "t4", 1, None, "refused"), ("b", "t1", 1, 1, "repeated")], key=str)


def test_a_run_without_new_turns_changes_nothing(spark, tmp_path):
    rows = [("a", "t1", at(1), 0.1)]
    first = run(spark, str(tmp_path), [rows])
    U.record(spark.readStream.schema(U.TURN).parquet(f"{tmp_path}/in"), str(tmp_path)).awaitTermination()
    assert sorted((tuple(r[f] for f in FIELDS) for r in U.log(spark, str(tmp_path)).collect()), key=str) == first
