"""Names in texts: one automaton against a pattern for each name."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import aliases

SF = "/root/testdata/sf0.001"


def brute(text, names):
    hits = {(m.start(), m.end(), slug) for slug, n in set(names) for m in re.finditer(rf"(?<![a-z0-9]){re.escape(n)}(?![a-z0-9])", text)}
    return sorted(h for h in hits if not any(o[2] != h[2] and o[0] <= h[0] and h[1] <= o[1] and o[1] - o[0] > h[1] - h[0] for o in hits))


PHRASE = st.lists(st.sampled_from(["a", "b", "ab", "é", "9"]), min_size=1, max_size=3).flatmap(lambda w: st.sampled_from([" ", "-", "  "]).map(lambda s: s.join(w)))


@settings(max_examples=500, deadline=None)
@given(st.lists(PHRASE, max_size=9).map(" ".join), st.lists(st.tuples(st.sampled_from("xyz"), PHRASE), max_size=8))
def test_automaton_matches_patterns(text, names):
    assert aliases.outermost(aliases.Phrases(names).found(text)) == brute(text, names)


def test_ten_thousand_names(spark):
    r = random.Random(7)
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id as id", "text").collect()
    words = sorted({w for d in docs for w in re.findall("[a-z0-9]+", (d["text"] or "").lower())})
    names = {(f"s{r.randint(0, 4000)}", " ".join(r.choices(words, k=r.choice([1, 1, 2])))) for _ in range(9_000)}
    for d in r.sample(docs, 150):
        held = (d["text"] or "").lower().split(" ")
        names |= {(f"s{k}", " ".join(held[k : k + 2])) for k in range(0, len(held) - 2, 5)}
    names = {(s, n) for s, n in names if n}
    automaton, few = aliases.Phrases(list(names)), r.sample(docs, 4)
    assert len(names) > 10_000
    for d in few:
        text = (d["text"] or "").lower()
        assert aliases.outermost(automaton.found(text)) == brute(text, [x for x in names if x[1] in text])


@pytest.mark.parametrize("most", [aliases.MOST_NAMES, 2])
def test_hits_of_slices_are_put_together(spark, most):
    texts = spark.createDataFrame([(1, "The Mega Women Cup, and Mega."), (2, None), (3, ""), (4, "mega-women cup")], "id long, text string")
    names = spark.createDataFrame([("mega", "mega"), ("women", "mega women"), ("cup", "women cup"), ("cup", "cup"), (None, "the"), ("x", None), ("odd", "cup,")], "slug string, alias string")
    got = sorted((h["id"], h["start"], h["end"], h["slug"]) for h in aliases.phrase_hits(texts, names, most).collect())
    every = [("mega", "mega"), ("women", "mega women"), ("cup", "women cup"), ("cup", "cup"), ("odd", "cup,")]
    assert got == [(i, *h) for i, t in ((1, "the mega women cup, and mega."), (4, "mega-women cup")) for h in brute(t, every)]
