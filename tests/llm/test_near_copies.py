"""The pipeline's near-dedup stage against exact Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline
import pytest

from quarry.llm import near_copies

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute_kept(rows):
    ids, sets, root = sorted(rows), {k: shingles(t) for k, t in rows.items()}, {k: k for k in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k for k in ids if find(k) == k}


def corpus(seed):
    """Texts with copies at all shares of edited words, chains of edits, short texts and a group with many copies."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(5000)]
    texts = [None, "", "a", "a b", "A  b", "a b c d e", "a b c d e f"]
    for size in (30, 120, 400, 900):
        for base in (r.choices(words, k=size) for _ in range(3)):
            texts.append(" ".join(base))
            for share in (0.002, 0.01, 0.02, 0.022, 0.03, 0.05):
                texts.append(" ".join("new" + w if r.random() < share else w for w in base))
    chain = r.choices(words, k=200)
    for k in range(0, 40, 2):
        chain[k * 5] = f"link{k}"
        texts.append(" ".join(chain))
    wide = r.choices(words, k=150)
    texts += [" ".join(f"e{r.random()}" if r.random() < 0.025 else w for w in wide) for _ in range(60)]
    ids = r.sample(range(-50, 5000), len(texts))
    return dict(zip(ids, texts, strict=True))


@pytest.mark.parametrize("cell", [near_copies.CELL, 7])
def test_near_dedup_matches_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(near_copies, "CELL", cell)
    rows = corpus(cell)
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows.items()], SCHEMA).repartition(3)
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_kept(rows)


def test_near_dedup_cuts_tiles_by_blocks_of_fingerprint_bits(spark, monkeypatch):
    """With many blocks and tiles cut into cells the result is that of comparing all pairs; no other hashes choose the pairs."""
    monkeypatch.setattr(near_copies, "TILE", 8)
    monkeypatch.setattr(near_copies, "HOT", 5)
    assert len(near_copies.blocks_for(160)) > 10 and all(len(b) == 4 and b.min() >= 64 for b in near_copies.blocks_for(160))
    assert not hasattr(near_copies, "band_keys")
    rows = corpus(11)
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows.items()], SCHEMA).repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == brute_kept(rows)


def test_near_dedup_finds_edited_words(spark):
    words = [f"w{k}" for k in range(400)]
    few, many = list(words), list(words)
    for k in range(0, 400, 60):
        few[k] = f"edit{k}"
    for k in range(0, 400, 20):
        many[k] = f"edit{k}"
    rows = [(1, " ".join(words)), (2, " ".join(few)), (3, " ".join(many)), (None, " ".join(words))]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA)
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == ["1", "3", "None"]
