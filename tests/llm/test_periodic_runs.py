"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import periodic_runs, queries

SCHEMA = "doc_id long, text string, doc string, runs long, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """(start, period, length) of every run."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, q, length) for (a, length), q in found.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), min_size=1, max_size=4), st.sampled_from([2, 3, 5, 12]), st.integers(1, 6))
def test_runs_match_brute_force(texts, least, times):
    texts = [np.array((t * times)[:60], dtype=np.int64) for t in texts]
    got = periodic_runs.runs_of(texts, least)
    for k, words in enumerate(texts):
        start, length, period = got.get(k, ((), (), ()))
        assert [tuple(map(int, x)) for x in zip(start, period, length, strict=True)] == brute(words.tolist(), least)


def test_blocks_of_leaves_change_nothing(monkeypatch):
    r = random.Random(2)
    texts = [np.array([r.randrange(3) for _ in range(300)] * 2) for _ in range(5)]
    whole = periodic_runs.runs_of(texts)
    monkeypatch.setattr(periodic_runs, "BLOCK", 7)
    small = periodic_runs.runs_of(texts)
    assert whole.keys() == small.keys() and all(np.array_equal(a, b) for k in whole for a, b in zip(whole[k], small[k], strict=True))


def test_long_periodic_text():
    s = np.concatenate([np.arange(5, 40_005) % 10_000, np.zeros(30_000, np.int64), [-1]])
    start, length, period = periodic_runs.maximal_runs(s)
    assert (40_000, 30_000, 1) in set(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    assert (0, 40_000, 10_000) in set(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))


def texts_of(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["é", "naïve"]
    texts = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "ab\x0bcd " * 6, "\x1c \x1d " * 9, "x" * 10_000]
    for _ in range(60):
        piece = r.choices(words, k=r.randint(1, 9))
        texts.append(" ".join(r.choices(words, k=r.randint(0, 20)) + piece * r.randint(1, 6)) + "\n" + " ".join(r.choices(words, k=5)))
    texts.append(" ".join(r.choices(words, k=50_000)))
    return list(zip(r.sample(range(-100, 3000), len(texts)), texts, strict=True)) + [(None, "b c " * 9), (None, None)]


def kept(words, runs):
    gone = {i for a, q, length in runs for i in range(a + q, a + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_operator_on_edge_texts(spark):
    rows = texts_of(3)
    docs = spark.createDataFrame([(*x, "clash", 1, "c") for x in rows], SCHEMA).repartition(3)
    got = periodic_runs.find_runs(docs).collect()
    assert len(got) == len(rows)
    assert sorted(r["kept_text"] for r in got if r["doc_id"] is None) == ["", "b c"]
    by_id = {r["doc_id"]: r for r in got}
    for doc, text in rows:
        if doc is None or len(text or "") > 100_000:
            continue
        words, r = WORD.findall(text or ""), by_id[doc]
        runs = brute(words)
        assert (r["n_words"], [(x["start"], x["period"], x["length"]) for x in r["runs"]]) == (len(words), runs)
        assert r["kept_text"] == " ".join(kept(words, runs))


def test_query_makes_periodic_tails(spark, tmp_path):
    rows = [x for x in texts_of(4) if len(x[1] or "") < 100_000]
    spark.createDataFrame([(*x, "clash", 1, "c") for x in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect() if r["doc_id"] is not None}
    tails = 0
    for doc, text in rows:
        if doc is None:
            continue
        words, h = WORD.findall(text or ""), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            tails += 1
        runs = brute(words)
        top = min(runs, key=lambda x: (-x[2], x[0], x[1])) if runs else (None, None, None)
        lines = "".join(f"{a},{length},{q}\n" for a, q, length in runs)
        r = got[doc]
        assert (r["n_runs"], r["start"], r["period"], r["length"]) == (len(runs), *top)
        assert r["exponent_milli"] == (1000 * top[2] // top[1] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(kept(words, runs)).encode()).hexdigest()
    assert tails


def test_empty_table(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], SCHEMA)).collect() == []
