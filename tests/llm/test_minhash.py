"""Circulant MinHash near-dedup against exact similarity of two-word shingles."""

import random

import numpy as np
import pytest

from quarry.llm import minhash

SCHEMA = "doc_id long, text string, c string, n long, root long"


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 2]) for i in range(len(words) - 1)) if len(words) > 1 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """doc_id -> (n_shingles, component_id), for ids that are not shared."""
    ids, sets, root = sorted(rows), {k: shingles(t) for k, t in rows.items()}, {k: k for k in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


def corpus(seed):
    """Copies at all shares of edits, chains of edits, a wide group of near copies, short, empty and null texts."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)] + ["É", "naïve"]
    texts = [None, None, "", " \n\t ", "a", "A", "a\x0bb", "a b", "b a", "a b a b", "\x1c \x1d", "q " * 300, "q q"]
    for size in (12, 40, 150, 600):
        for base in (r.choices(words, k=size) for _ in range(3)):
            texts.append(" ".join(base))
            for share in (0.01, 0.03, 0.05, 0.055, 0.06, 0.08, 0.15):
                texts.append(" ".join("New" + w if r.random() < share else w for w in base))
    chain = r.choices(words, k=100)
    for k in range(0, 90, 2):
        chain[k] = f"link{k}"
        texts.append(" ".join(chain))
    wide = r.choices(words, k=150)
    texts += [" ".join(f"e{r.random()}" if r.random() < 0.06 else w for w in wide) for _ in range(80)]
    texts += [" ".join(r.choices(words, k=60_000))] * 2
    return dict(zip(r.sample(range(-500, 5000), len(texts)), texts, strict=True))


def found(spark, rows, parts=3):
    docs = spark.createDataFrame([(k, t, "clash", 1, 7) for k, t in rows], SCHEMA).repartition(parts)
    return minhash.near_duplicates(docs).collect()


@pytest.mark.parametrize("cell", [minhash.CELL, 7])
def test_components_match_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(minhash, "CELL", cell)
    rows = corpus(cell)
    got = found(spark, rows.items())
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_the_border_of_a_link_is_exact(spark):
    """Nine shingles of which eight are common of ten in all: linked; of eleven: not."""
    nine = "a b c d e f g h i j"
    assert 100 * 8 >= 80 * 10
    rows = [(1, nine), (2, "a b c d e f g h i x"), (3, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10"), (4, "x1 x2 x3 x4 x5 x6 x7 x8 x9 y y2")]
    got = {r["doc_id"]: r["component_id"] for r in found(spark, rows)}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3 if 100 * 8 >= 80 * 11 else 4}


def test_null_and_shared_ids(spark):
    rows = [(None, "a b c d"), (9, "a b c d"), (5, "k l m n o p q r s t u v w"), (7, "k l m n o p q r s t u v w"), (7, "one two three four"), (3, "one two three four"), (7, ""), (8, "")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in found(spark, rows))
    assert got == [("3", 3, 3, True), ("5", 12, 3, False), ("7", 0, 3, False), ("7", 3, 3, False), ("7", 12, 3, False), ("8", 0, 8, True), ("9", 3, 9, True), ("None", 3, None, None)]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_coordinates_agree_as_often_as_sets_do():
    r = np.random.default_rng(1)
    shares = []
    for _ in range(200):
        pool = r.integers(0, 1 << 63, 120, dtype=np.int64).view(np.uint64) * np.uint64(2)
        m = np.array(list(minhash.circulant([pool[:100], pool[20:]])))
        shares.append((m[:, 0] == m[:, 1]).mean())
    assert abs(np.mean(shares) - 80 / 120) < 0.01
    assert np.var(shares) < 1.3 * (80 / 120) * (40 / 120) / (minhash.BANDS * minhash.ROWS)


def test_second_permutation_is_shifted_by_one_place():
    x = np.arange(1000, dtype=np.uint64) << np.uint64(32)
    rows = [np.array(list(minhash.circulant([np.array([v])], 4))).ravel() for v in x]
    # The rank of y at shift k + 1 is that of y - 1 at shift k.
    at = {int(minhash.scatter(np.array([v >> np.uint64(32)], dtype=np.uint32))[0]): row for v, row in zip(x, rows, strict=True)}
    pairs = [(at[y], at[y - 1]) for y in at if y - 1 in at]
    assert all((a[1:] == b[:-1]).all() for a, b in pairs)
