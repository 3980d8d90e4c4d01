"""History and client-side text on small fixtures."""

import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarry.operators import history, verify
from quarry.sources import store


def at(k):
    return datetime.datetime(2026, 1, 1, 0, k)


def test_latest_state_and_tombstones(spark):
    log = spark.createDataFrame([("a", at(1), "create", "A"), ("a", at(2), "rename", "B"), ("b", at(3), "create", "C"), ("b", at(4), "delete", None), ("a", at(5), "turn", None)], history.LOG)
    rows = history.latest(log).collect()
    assert [(r["conversation_id"], r["title"], r["updated_at"]) for r in rows] == [("a", "B", at(5))]


def test_turns_and_summaries(spark):
    docs = '{"docs": [{"game": "x"}, {"game": "y"}, {"game": "x"}]}'
    turns = spark.createDataFrame([("a", at(2), "q2", docs, "f", 0.1), ("a", at(1), "q1", "not json", "g", 0.2), ("z", at(1), "q", docs, "f", None)], history.TURNS)
    numbered = history.turns_of(turns, spark.createDataFrame([("a",)], "conversation_id string"), "f")
    assert sorted((r["seq"], r["question"], r["stale"]) for r in numbered.collect()) == [(1, "q1", True), (2, "q2", False)]
    assert history.check_unique(numbered).count() == 0
    s = history.summaries(numbered).first()
    assert (s["turn_count"], s["games"], s["stale"]) == (2, ["x", "y"], True)


@given(st.text("ab\n", max_size=30))
def test_paragraphs_are_gapless(text):
    ranges = verify.paragraph_ranges(text)
    assert "".join(text[a:b] for a, b in ranges) == text


def test_spans_do_not_overlap():
    spans = [{"start": 0, "end": 2, "text": "ab"}, {"start": 1, "end": 3, "text": "bc"}, {"start": 3, "end": 9, "text": "de"}, {"start": 2, "end": 4, "text": "cd"}]
    assert [s["text"] for s in verify.usable_spans("abcd", spans)] == ["ab", "cd"]
    assert verify.copy_payload("A ", "de", "f1", []).endswith("Check: no fault found")


def test_guards(spark, tmp_path):
    store.require_fingerprint("a", "a")
    with pytest.raises(RuntimeError, match="pinned"):
        store.require_fingerprint("a", "b")
    runs = spark.createDataFrame([(1, "boom"), (2, None)], "id int, error string")
    with pytest.raises(RuntimeError, match="1 of 2"):
        store.require_few_errors(runs)
    (tmp_path / "s.json").write_text('{"slug": "x", "alias": "ex"}\n{"slug": "nope", "alias": "n"}\n')
    catalog = spark.createDataFrame([("x",)], "slug string")
    assert [r["alias"] for r in store.alias_supplement(spark, [f"file://{tmp_path}/none.json", f"file://{tmp_path}/s.json"], catalog).collect()] == ["ex"]
