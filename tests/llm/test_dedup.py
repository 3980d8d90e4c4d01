"""Substring, suffix and SimHash dedup against brute force."""

import random

import pytest
import xxhash

from quarry.llm.components import smallest_reachable
from quarry.llm.simhash import near_duplicates
from quarry.llm.substring_dedup import dedup_windows
from quarry.llm.suffix_dedup import dedup_suffixes

SCHEMA = "doc_id long, text string, doc string, span long"


def corpus(seed):
    """Texts that share passages, repeat themselves, tie, and are null, empty, short, long or copies."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["é", "naïve", "x"]
    passage = [" ".join(r.choices(words, k=n)) for n in (60, 80, 51, 50, 49)]
    texts = [None, "", " \n\t", "a", "q " * 130, "ab" * 150, "xyz" * 40, "\x1c\x1d " * 60]
    for _ in range(40):
        parts = [" ".join(r.choices(words, k=r.randint(0, 70))) for _ in range(3)]
        texts.append("\n".join(p for pair in zip(parts, r.choices([*passage, ""], k=3), strict=True) for p in pair))
    texts += [texts[10], texts[10], texts[12] + " tail", "head " + texts[12], " ".join(r.choices(words, k=5000))]
    ids = r.sample(range(-50, 1000), len(texts))
    return [(i, t, "clash", 1) for i, t in zip(ids, texts, strict=True)]


def brute_windows(rows, width):
    words = {d: (t or "").encode().split() for d, t, *_ in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def brute_bytes(rows, width):
    data = {d: (t or "").encode() for d, t, *_ in rows}
    first = {}
    for d in sorted(data):
        for i in range(len(data[d]) - width + 1):
            first.setdefault(data[d][i : i + width], (d, i))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] != (d, i):
                gone[i : i + width] = b"\1" * width
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_match_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in dedup_windows(docs).collect()}
    assert got == brute_windows(rows, 50)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_match_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in dedup_suffixes(docs).collect()}
    assert got == brute_bytes(rows, 100)


def test_suffixes_of_repeated_lines_match_brute_force(spark):
    r = random.Random(9)

    def text(n):
        return "".join(r.choices("abcdefghijklmnop ", k=n))

    rows = []
    for k in range(240):
        line, before, after = text(100 + k % 77), text(130), text(130)
        again = before + line + after
        cut = [again[130 - r.randint(0, 24) : 130 + len(line) + r.randint(0, 24)] for _ in range(2)]
        rows += [(3 * k, text(40) + line + text(60) + again), *((3 * k + j + 1, text(50) + c + text(50)) for j, c in enumerate(cut))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in dedup_suffixes(docs).collect()}
    want = brute_bytes(rows, 100)
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert len(got) == len(rows)


@pytest.mark.parametrize("blocks", [(), (8,), (16, 4)])
def test_suffixes_rank_the_ends_of_runs_once(spark, monkeypatch, blocks):
    from quarry.llm import suffix_dedup

    rows, ranks = corpus(4), []

    def counted(df, label, write=suffix_dedup.materialise):
        ranks.extend([label] * (label == "suffix-ranks"))
        return write(df, label)

    def spans(docs, width, gram, of=suffix_dedup.removal_spans):
        return of(docs, width, gram, blocks)

    monkeypatch.setattr(suffix_dedup, "materialise", counted)
    monkeypatch.setattr(suffix_dedup, "removal_spans", spans)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in dedup_suffixes(docs).collect()}
    assert got == brute_bytes(rows, 100)
    assert len(ranks) == len(blocks) + 2


@pytest.mark.parametrize("chunk, bucket", [(1, 5), (200, 40), (1 << 17, 1 << 18)])
def test_suffixes_ask_for_the_anchors_of_a_chunk_at_once(spark, monkeypatch, chunk, bucket):
    from quarry.llm import suffix_dedup

    rows, written = corpus(6), {}
    # Texts that share an id and a passage, and one that has it later.
    passage = "".join(random.Random(6).choices("abcdefgh", k=300))
    rows += [(2000, "x" + passage, "c", 1), (2000, "other " + passage + passage[::-1], "c", 1), (2000, "x" + passage, "c", 1), (2001, passage[20:], "c", 1)]

    def counted(df, label, write=suffix_dedup.materialise):
        out = write(df, label)
        if label == "suffix-runs":
            written.update(rows=out.count(), runs=out.agg({"n": "sum"}).first()[0])
        return out

    def spans(docs, width, gram, of=suffix_dedup.removal_spans):
        return of(docs, width, gram, chunk=chunk, bucket=bucket)

    monkeypatch.setattr(suffix_dedup, "materialise", counted)
    monkeypatch.setattr(suffix_dedup, "removal_spans", spans)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in dedup_suffixes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    alone = [r for r in rows if r[0] < 2000]
    # Each text of id 2000 is compared with smaller ids only.
    want = [(d, *x) for d, x in brute_bytes(alone, 100).items()] + [(2000, *brute_bytes([*alone, r], 100)[2000]) for r in rows if r[0] == 2000] + [(2001, *brute_bytes(rows, 100)[2001])]
    assert sorted(got) == sorted(want)
    assert written["runs"] > 1000
    assert written["rows"] <= 3 + written["runs"] // chunk


def test_ranks_are_named_without_a_sort(spark):
    from quarry.llm import suffix_dedup

    windows = spark.createDataFrame([(d, -7, p, 1, 2, 3, 4 + p) for d in (5, 3, 9) for p in (0, 1)] + [(1, 8, 6, 1, 2, 3, 40)], "doc long, key long, pos long, q0 long, q1 long, q2 long, q3 long")
    named, _ = suffix_dedup.ranked(windows)
    assert "SortAggregate" not in named._jdf.queryExecution().toString()
    got = sorted((r["doc"], r["pos"], r["name"]["doc"], r["name"]["place"] & (1 << 31) - 1, r["name"]["place"] >> 31) for r in named.collect())
    assert got == sorted((d, p, 3, p, -7) for d in (5, 3, 9) for p in (0, 1))


def test_long_document_wraps_the_place_count(spark, monkeypatch):
    from quarry.llm import suffix_dedup

    r = random.Random(5)
    text = "".join(r.choices("abcdefgh", k=1 << 20)) + "ab" * 100
    rows = [(1, text), (2, "zz" + text[(1 << 20) - 700 : 1 << 20] + "yy")]
    got = {x["doc_id"]: x for x in dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["n_removed"] == 700
    assert got[1]["n_removed"] == 198
    assert suffix_dedup._PLACE_BITS == 20


def test_a_document_compares_a_window_that_it_repeats_once(spark, monkeypatch):
    from quarry.llm import repeats

    r, compared = random.Random(11), []
    words = [f"w{k}" for k in range(900)]
    parts = ["a b " * 40, "a b " * 400, "c " * 90, " ".join(words[:20]) + " ", "a b c " * 30, " ".join(words[:70]) + " "]
    rows = [(k, "".join(f"{' '.join(r.choices(words, k=r.randint(0, 9)))} {p}" for p in r.choices(parts, k=4))) for k in range(60)]
    rows += [(60, "a b " * 3000 + "end"), (61, "start " + "a b " * 3000)]

    def counted(df, label, write=repeats.materialise):
        out = write(df, label)
        if label == "repeats-told":
            compared.append(out.where("h1 is not null").count())
        return out

    monkeypatch.setattr(repeats, "materialise", counted)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_text"]) for x in dedup_windows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_windows(rows, 50)
    distinct = sum(len({tuple(w[i : i + 50]) for i in range(len(w) - 49)}) for w in (t.split() for _, t in rows))
    # A row holds so many places of its windows; a longer list repeats them.
    assert compared[0] <= distinct + 6000 // repeats.PLACES * repeats.PIECE * 2


def test_null_and_shared_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (None, text), (3, text), (5, text), (5, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in dedup_windows(docs).collect())
    assert got == [("3", 0), ("5", 60), ("5", 60), ("None", 0), ("None", 0)]
    assert {(r["doc_id"], r["n_removed"]) for r in dedup_suffixes(docs).collect()} == {(None, 0), (3, 0), (5, len(text))}


@pytest.mark.parametrize("run", [dedup_windows, dedup_suffixes, near_duplicates])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 4 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, radius=4):
    ids, root = sorted(fps), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {a: find(a) for a in ids}


def test_simhash_matches_brute_force(spark, monkeypatch):
    from quarry.llm import simhash

    rows = corpus(3)
    base = next(t for _, t, *_ in rows if t and len(t) > 3000).split()
    rows += [(2000 + k, " ".join(base[:k] + ["new"] + base[k + 1 :]), "c", 1) for k in range(0, 60, 2)]
    fps = {d: brute_simhash(t) for d, t, *_ in rows}
    want = {d: (f"{fps[d]:016x}", c) for d, c in brute_components(fps).items()}
    for cell in (simhash.CELL, 2):  # the second cuts shared block values into cells
        monkeypatch.setattr(simhash, "CELL", cell)
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == want


def test_components_of_long_paths(spark):
    r = random.Random(1)
    nodes = r.sample(range(10_000), 300)
    links = list(zip(nodes[:200], nodes[1:201], strict=True)) + [(n, nodes[250]) for n in nodes[251:300]] + [(5, 5), (7, None)]
    got = {x["node"]: x["root"] for x in smallest_reachable(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == dict.fromkeys(nodes[:201], min(nodes[:201])) | dict.fromkeys(nodes[250:300], min(nodes[250:300]))
