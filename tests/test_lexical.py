"""BM25 with block bounds against scoring every chunk."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import lexical
from quarry.sources import store

SCHEMA = "chunk_id long, scope string, game string, text string, score double"


def brute(chunks, questions, k):
    out = {}
    for q, text, game in questions:
        pool = "" if game in (None, "global") else game
        held = {}
        for c, scope, g, body in chunks:
            part = "" if scope == "global" or (scope == "amendment" and g == "global") else g if scope == "title" else None
            if part in ("", pool) and part is not None:
                held[c] = (body or "").lower().split()
        n, avgdl = len(held), sum(map(len, held.values())) / max(1, len(held))
        df = Counter(t for d in held.values() for t in set(d))
        idf = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
        mean = sum(idf.values()) / len(idf) if idf else 0.0
        scores = {}
        for c, d in held.items():
            tf, hit = Counter(d), [t for t in (text or "").lower().split() if t in d]
            if hit:
                scores[c] = round(sum((0.25 * mean if idf[t] < 0 else idf[t]) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for t in hit), 6)
        best = sorted(scores, key=lambda c: (-scores[c], c))[:k]
        out[q] = [(c, i + 1) for i, c in enumerate(best)]
    return {q: v for q, v in out.items() if v}


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    chunks = []
    for c in r.sample(range(10_000), n):
        scope = r.choice(["global", "title", "title", "amendment", "other"])
        game = "global" if scope == "global" else r.choice(["de", "fr", "global"])
        chunks.append((c, scope, game, " ".join(["the"] * r.randint(0, 3) + r.choices(words, weights, k=r.randint(0, 40)))))
    chunks += [(20_001, "global", "global", None), (20_002, "global", "global", ""), (20_003, "global", "global", chunks[0][3]), (20_004, "global", "global", chunks[0][3])]
    asked = [(q, " ".join(r.choices(words, weights, k=r.randint(1, 12)) + ["the"]), r.choice([None, "global", "de", "fr", "none"])) for q in range(30)]
    return chunks, asked + [(100, None, None), (101, "", "de"), (102, "nowhere", "de"), (103, "the", "fr"), (104, "the the w0", None)]


def found(spark, chunks, asked, k=5, block=4, seeds=12, direct=0):
    index = lexical.build(spark.createDataFrame([(*c, 9.0) for c in chunks], SCHEMA), block)
    return index, lexical.search(index, spark.createDataFrame(asked, "query_id long, question string, game string"), k, seeds=seeds, direct=direct)


@pytest.mark.parametrize(("seed", "seeds", "direct"), [(1, 12, 0), (2, 0, 0), (3, 10_000, 0), (4, 12, lexical.DIRECT)])
def test_best_chunks_are_those_of_a_full_scan(spark, seed, seeds, direct):
    chunks, asked = corpus(seed, 300)
    _, f = found(spark, chunks, asked, seeds=seeds, direct=direct)
    got = {}
    for r in f.best.orderBy("query_id", "lex_rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["lex_rank"]))
    assert got == brute(chunks, asked, 5)


def test_few_postings_of_a_stop_word_are_read(spark):
    """Every chunk has the stop word; of its postings the questions, passages of chunks, read less than a tenth."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(20_000)]
    weights = [1 / (k + 20) for k in range(20_000)]
    chunks = [(c, "global", "global", " ".join(["the"] * r.randint(1, 3) + r.choices(words, weights, k=30))) for c in range(20_000)]
    asked = [(q, " ".join(["the", *chunks[q * 37][3].split()[8:18]]), None) for q in range(20)]
    index, f = found(spark, chunks, asked, k=12, block=16, seeds=lexical.SEEDS)
    have = index.terms.where("term = 'the'").first()["df"]
    read = f.read.where("term = 'the'").agg(F.sum("n")).first()[0] or 0
    assert have == len(chunks)
    assert read < have * len(asked) / 10
    few = asked[:3]
    got = {q: [] for q, *_ in few}
    for x in f.best.where("query_id < 3").orderBy("query_id", "lex_rank").collect():
        got[x["query_id"]].append((x["chunk_id"], x["lex_rank"]))
    assert got == brute(chunks, few, 12)


def test_blocks_cover_all_postings_once(spark):
    chunks, asked = corpus(5, 200)
    index, _ = found(spark, chunks, asked)
    held = Counter()
    for r in index.postings.collect():
        assert r["n"] == len(r["ids"]) == len(r["tfs"]) == len(r["dls"]) <= 4
        assert r["max_tf"] == max(r["tfs"]) and r["min_dl"] == min(r["dls"])
        for c, tf in zip(r["ids"], r["tfs"], strict=True):
            held[c, r["term"]] += tf
    want = Counter((c, t) for c, scope, g, body in chunks if scope in ("global", "title") or scope == "amendment" and g == "global" for t in (body or "").split())
    assert held == want


def test_scores_are_added_up_where_the_blocks_lie(spark, monkeypatch):
    """By default no row is made of a posting, at any number of them: blocks are added up in tasks, which hand on k rows a question."""
    for name, few in (("SLICE", 9), ("ROWS", 7), ("CANDIDATES", 3)):
        monkeypatch.setattr(lexical, name, few)
    chunks, asked = corpus(6, 300)
    index = lexical.build(spark.createDataFrame([(*c, 9.0) for c in chunks], SCHEMA), 4)
    best = lexical.search(index, spark.createDataFrame(asked, "query_id long, question string, game string"), 5).best
    assert "Generate" not in best._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in best.orderBy("query_id", "lex_rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["lex_rank"]))
    assert got == brute(chunks, asked, 5)


def test_nothing_indexed_or_asked(spark):
    _, f = found(spark, [], [(1, "a", None)])
    assert f.best.collect() == []
    _, f = found(spark, [(1, "global", "global", "a b")], [])
    assert f.best.collect() == []


def test_tokens_are_those_of_the_column_function(spark):
    """Bytes classed in tasks give what the regular expression gives, prefixes and Unicode's lower case included."""
    texts = ["Rule 2.8.1.3 and 2.8.1.3, 4.1-7.2.9", "a.b", ".a.-b-.c..d--e", "x-1.y", None, "", "...", "été Kİ Ka.b.c", "9.9.9", "1.2.3", "a-", "-a", "end.", ".begin", "UP.Per.Case"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    want = {r["chunk_id"]: Counter(r["t"] or []) for r in df.select("chunk_id", text.tokens(F.col("text")).alias("t")).collect()}
    batch = df.select("chunk_id", F.lit("").alias("part"), F.lower("text").alias("text")).coalesce(1).orderBy("chunk_id").toArrow().combine_chunks().to_batches()[0]
    for lo in (0, 3):
        for r in lexical._counted(batch.slice(lo)).to_pylist():
            assert Counter(dict(zip(r["terms"], r["tfs"], strict=True))) == want[r["chunk_id"]]
            assert r["dl"] == want[r["chunk_id"]].total()


def test_index_shuffles_no_text_and_no_posting(spark, monkeypatch):
    plans, write = {}, store.written

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(store, "written", noted)
    chunks, _ = corpus(7, 100)
    lexical.build(spark.createDataFrame([(*c, 9.0) for c in chunks], SCHEMA), 4)
    assert set(plans) == {"postings", "terms", "parts"}
    assert "Exchange" not in plans["postings"]


def test_slices_of_questions_share_one_shuffle_of_the_postings(spark, monkeypatch):
    chunks, asked = corpus(8, 200)
    index = lexical.build(spark.createDataFrame([(*c, 9.0) for c in chunks], SCHEMA), 4)
    questions = spark.createDataFrame(asked, "query_id long, question string, game string")
    want = sorted(map(tuple, lexical.search(index, questions, 5).best.collect()))
    monkeypatch.setattr(lexical, "SLICE", 9)
    best = lexical.search(index, questions, 5).best
    assert sorted(map(tuple, best.collect())) == want
    plan = best._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 4
    assert plan.count("REPARTITION_BY_COL") - plan.count("ReusedExchange") == 1


def test_document_counts_are_those_of_the_content_words(spark):
    texts = ["The rule 2.8.1 and the Rule", "a b-c a.b", None, "", "x2 x2. x2-y9 .of", "KİK été", "rule"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    words = df.select(F.explode(F.array_distinct(text.content_words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    got = lexical.document_counts(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, words.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
