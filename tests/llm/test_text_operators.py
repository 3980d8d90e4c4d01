"""Fingerprints, quality, decontamination, urls, tokens, html and packing on small fixtures."""

import hashlib
import io
import random
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import decontamination, fingerprints, html_text, packing, quality, token_files, url_filter
from quarry.llm.queries import RULES
from quarry.llm.tokens import Encoder, encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, text_hash string, n_words string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta", "Été", "42"], k=n))


ROWS = [(4, prose(1, 300), "x", "y"), (9, prose(2, 40), "x", "y"), (-3, None, "x", "y"), (11, "", "x", "y"), (12, "one", "x", "y"), (15, prose(1, 300), "x", "y"), (30, prose(4, 4000), "x", "y")]


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda s: np.array([*t.encode(s or "", add_special_tokens=False).ids, 2], dtype="<u4")


# Fingerprints


def test_fingerprints(spark):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_pairs(spark.createDataFrame(ROWS, DOCS).repartition(3)).collect()}
    order = sorted(ROWS, key=lambda r: r[0])
    for k, (d, t, *_) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[d]["n_chars"] == len(text)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d]["near_edited"] <= 1
        assert 0 <= got[d]["near_next"] <= 1
    assert got[4]["fingerprint"] == got[15]["fingerprint"] != got[9]["fingerprint"]
    assert got[-3]["fingerprint"] == got[11]["fingerprint"]
    assert got[11]["near_edited"] == 1.0
    assert got[11]["near_next"] == 0.0


def test_fingerprint_edge_tables(spark):
    assert fingerprints.fingerprint_pairs(spark.createDataFrame([], DOCS)).count() == 0
    one = fingerprints.fingerprint_pairs(spark.createDataFrame([(5, "abcd ef", "", "")], DOCS)).first()
    assert one["near_next"] == 1.0
    assert one["edited_sha256"] == hashlib.sha256(b"abcdabc").hexdigest()
    none = fingerprints.fingerprint_pairs(spark.createDataFrame([(None, "ab", "", ""), (1, "cd", "", ""), (1, "cd", "", "")], DOCS)).collect()
    assert len(none) == 3


@pytest.mark.parametrize("ids", [[-(1 << 63), 0, 5], [(1 << 63) - 1], [(1 << 63) - 1, (1 << 63) - 2, -(1 << 63), 1 - (1 << 63), 0, 7, 1 << 62, (1 << 62) + 1], [1 << 60, (1 << 60) + 1]])
def test_fingerprints_of_wide_ids(spark, ids):
    rows = [(d, f"text number {k} of {d}", "", "") for k, d in enumerate(ids)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_pairs(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    order = sorted(rows)
    for k, (d, text, *_) in enumerate(order):
        half, after = len(text) // 2, order[(k + 1) % len(order)][1]
        assert got[d]["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_likeness_estimates_jaccard(spark):
    words = [f"w{k}" for k in range(2000)]
    texts = [" ".join(words[:n] + [f"x{k}" for k in range(n, 2000)]) for n in (2000, 1800, 1000, 200)]
    df = spark.createDataFrame([(texts[0], t, n) for t, n in zip(texts, (2000, 1800, 1000, 200), strict=True)], "a string, b string, n int")
    for r in df.select("n", fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("j")).collect():
        same = r["n"] - 4
        assert abs(r["j"] - same / (2 * 1996 - same)) < 0.12


def spark_hash(*values):
    """Spark's xxhash64 of a row: each value's hash is the next one's seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v - (1 << 64) if v >= 1 << 63 else v), seed)
    return seed


def brute_fingerprint(text):
    bins, low, rest = fingerprints.BINS, fingerprints.LOW, fingerprints._REST
    words = [spark_hash(w) for w in (text or "").encode().split()]
    shingles = [spark_hash(*words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [spark_hash(*words)] if words else []
    if not shingles:
        return "0" * (bins * low // 4)
    held = {}
    for h in shingles:
        held[h >> rest] = min(held.get(h >> rest, 1 << 64), h)

    def order(x):  # Spark's longs are signed
        return x - (1 << 64) if x >= 1 << 63 else x

    # The bins stand in the order of signed hashes; a probe names a place in that order.
    places = [b ^ (bins // 2) for b in range(bins)]
    out = 0
    for i in range(bins):
        tried = [held.get(places[p]) for p in (i, *(fingerprints._probe(i, a) for a in range(fingerprints.PROBES)))]
        got = next((x for x in tried if x is not None), None)
        if got is None:
            got = min((order(spark_hash_int(i, x >> rest)), order(x)) for x in held.values())[1] % (1 << 64)
        out = out << low | spark_hash_last_int(got, i) & (1 << low) - 1
    return f"{out:0{bins * low // 4}x}"


def spark_hash_int(i, x):
    """xxhash64(int, long)."""
    return xxhash.xxh64_intdigest(struct.pack("<q", x), xxhash.xxh64_intdigest(struct.pack("<i", i), 42))


def spark_hash_last_int(x, i):
    """xxhash64(long, int)."""
    return xxhash.xxh64_intdigest(struct.pack("<i", i), spark_hash(x))


def test_fingerprints_match_brute_force(spark):
    texts = [None, "", "  ", "one", "a b c d", "a b c d e", prose(1, 300), prose(2, 40), " ".join(f"w{k}" for k in range(3000)), "é ü\tß\nx  y z\x0bq"]
    rows = [(k, t, "", "") for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_pairs(spark.createDataFrame(rows, DOCS)).collect()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: brute_fingerprint(t) for k, t in enumerate(texts)}
    for k, r in got.items():
        a, b = r["fingerprint"], got[(k + 1) % len(texts)]["fingerprint"]
        same = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, len(a), 2)) / fingerprints.BINS
        zero = "0" * len(a)
        want = float(a == b) if zero in (a, b) else max(0.0, (same - 1 / 256) / (1 - 1 / 256))
        assert abs(r["near_next"] - want) < 1e-9


def test_token_ids_of_odd_words(spark):
    """Words that the vocabulary's pattern parts are encoded part by part, with the library's ids."""
    r = random.Random(8)
    odd = ["it's", "IT'S", "'sun'", "a'll,'d", "x1y22", "co-op's", "<|endoftext|>", "a.b.c!!", "...", "'", "''s", "3.14e-5", "foo\x7fbar", "a_b", "'re've", "É's", "naïve-2", "a\x00'm"]
    own, ids = Encoder(WORD), library(WORD)
    for text in [*odd, *(" ".join(r.choices(odd, k=20)) for _ in range(100))]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids(text)[:-1].tolist()


# Quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels).join(labels, "doc_id").where("held_out").collect()
    kept = [r["predicted"] for r in rows if r["quality"] == 1]
    junk = [r["predicted"] for r in rows if r["quality"] == 0]
    assert sum(kept) / len(kept) > 0.99
    assert sum(junk) / len(junk) < 0.15


def test_quality_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, None, 0.1), (None, "", 0.2), (2, "x" * 100_000, 0.3)], "doc_id long, text string, score double")
    assert [r["score"] for r in quality.judge(docs, empty).collect()] == [0.5] * 3
    assert quality.judge(docs.limit(0), empty).count() == 0
    labels = spark.createDataFrame([(d, 1) for d in range(5)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality.judge(docs, labels).collect())


def test_quality_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda p, u, above: seen.append((len(p), len(u))) or fit(p, u, above))
    rows = [(k % 40, prose(k, 30), 1) for k in range(400)] + [(7, prose(k, 20), 1) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, trusted int")
    labels = spark.createDataFrame([(k % 60, 1) for k in range(120)], "doc_id long, quality int")
    out = quality.judge(docs, labels, sample=15).collect()
    assert len(out) == 700
    assert seen == [(15, 15)]
    featured = quality.featurise(docs, ["doc_id"])
    assert quality.train(featured, labels, sample=10**6).prior == pytest.approx(0.99, abs=0.2)


def test_quality_scores_match_the_model_row_by_row(spark):
    docs = spark.createDataFrame([(k, prose(k, 5 + k), "clash") for k in range(60)] + [(61, None, ""), (62, "", "")], "doc_id long, text string, x string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 60, 2)], "doc_id long, quality int")
    featured = quality.featurise(docs, ["doc_id", "x"])
    model = quality.train(featured, labels)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in quality.score(featured, model, ["doc_id", "x"]).collect():
        assert r["score"] == pytest.approx(float(model.score(quality.features(texts[r["doc_id"]]).astype(np.float32)[None])[0]), abs=1e-9)


def test_prior_of_separable_classes():
    r = np.random.default_rng(0)
    p, u = r.normal(2, 1, (2000, 3)), np.concatenate([r.normal(2, 1, (1400, 3)), r.normal(-2, 1, (600, 3))])
    edges = np.quantile(np.concatenate([p, u]), np.linspace(0.05, 0.95, 10), axis=0).T
    rows = quality._bins(u[r.permutation(len(u))], edges)

    def above(_, w, thresholds):
        f = np.sort(rows @ w.astype(np.float32))
        return len(f) - np.searchsorted(f, thresholds, side="left"), len(f)

    assert abs(quality.class_prior(quality._bins(p, edges), rows, edges, above) - 0.7) < 0.1


def test_quality_rows_are_held_as_bins():
    r = np.random.default_rng(1)
    x, edges = r.integers(0, 9, (50, 3)).astype(np.float64), np.sort(r.integers(0, 9, (3, 5)), axis=1).astype(np.float64)
    code = (x[:, :, None] > edges[None]).reshape(50, -1)
    w, d, rows = r.normal(size=15), r.normal(size=50), quality._bins(x, edges)
    assert np.allclose(rows @ w, code @ w)
    assert np.allclose(rows[::2] @ w, code[::2] @ w)
    assert np.allclose(rows.summed(d), d @ code)


def test_quality_fit_takes_little_of_the_drivers_memory():
    r = np.random.default_rng(2)
    p, u = (r.normal(m, 1, (4_000, quality.N_FEATURES)) for m in (1, 0))
    tracemalloc.start()
    quality.fit(p, u, lambda edges, w, thresholds: (np.zeros(len(thresholds)), 0))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # The thermometer code of these rows, as 32-bit numbers, is 16 MB, and the fit held it twice.
    assert peak < 12_000_000


# Decontamination


def brute_contamination(rows, items, width=10):
    def words(t):
        return "".join(c.lower() if c.isascii() else c for c in t or "").translate({k: " " for k in range(128) if not chr(k).isalnum()}).split()

    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = []
    for d, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= owners
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_slice", [200_000, 3])
def test_contamination_matches_brute_force(spark, per_slice):
    items = [(1, prose(7, 30)), (2, "Été; ONE two"), (3, ""), (4, None), (5, prose(7, 30)), (10, prose(8, 10))]
    rows = [*ROWS, (50, "see été one TWO! and " + prose(7, 30)[5:90], "", ""), (51, prose(7, 30) + "." + prose(7, 30), "", ""), (52, "one two", "", ""), (50, "été one two", "", ""), (52, "one two", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), per_slice=per_slice).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == brute_contamination(rows, items)


def test_contamination_edge_tables(spark):
    docs, none = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontamination.contamination(docs, none).collect()} == {0}
    assert decontamination.contamination(docs.limit(0), none).count() == 0


# Urls


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("https://Example.ORG/en/12?x#y", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://a.example.org/es/", "a.example.org", "/es/", "example.org/es/", "block"),
    ("http://b.org", "b.org", "", None, "allow"),
    ("http://b.org/?q", "b.org", "/", "org/", "allow"),
    ("x://b.com/fr/1#/de/", "b.com", "/fr/1", "com/fr/", "allow"),
    ("x://notcom/fr/", "notcom", "/fr/", None, "allow"),
    ("a.com/de/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
])
def test_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    none = spark.createDataFrame([], "page long, good int")
    r = url_filter.judge_urls(pages, none, RULES).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_reputation_shrinks(spark):
    rows = [(k, f"http://{h}/x") for k, h in enumerate(["bad.net"] * 60 + ["good.net"] * 60 + ["new.bad.net"] + ["one.good.net"])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    good = spark.createDataFrame([(k, int(k >= 60)) for k in range(120)] + [(121, 0)], "page long, good int")
    got = {r["host"]: r["verdict"] for r in url_filter.judge_urls(pages, good, []).collect()}
    assert got["bad.net"] == "block"
    assert got["good.net"] == got["one.good.net"] == "allow"
    assert url_filter.judge_urls(pages.limit(0), good, RULES).count() == 0


def test_urls_of_null_and_repeated_pages(spark):
    pages = spark.createDataFrame([(None, "http://a.net/x", 1), (1, "http://a.net/y", 1), (1, "http://b.net/", 1), (2, None, 1), (3, "nothing", 1)], "page_id long, url string, host int")
    outcomes = spark.createDataFrame([(1, 1), (1, 0), (None, 0)], "page long, good int")
    got = sorted((str(r["page_id"]), r["host"], r["path"], r["verdict"]) for r in url_filter.judge_urls(pages, outcomes, RULES).collect())
    assert [g[:3] for g in got] == [("1", "a.net", "/y"), ("1", "b.net", "/"), ("2", "", ""), ("3", "", ""), ("None", "a.net", "/x")]
    assert {g[3] for g in got} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), outcomes.limit(0), RULES).count() == 0


# Tokens


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Ab.", "É,", " ", "  ", "\n", "\n\n", "\t", "'s", "12", "<|endoftext|>", " ", "\x1c", "İ,", "Σ", "e\u0301", "\u0301", "中文", "!?", "ŉ", "\x00"]), max_size=10))
def test_encoder_is_the_library(path, parts):
    text, e = "".join(parts), encoder(path)
    assert e.encode(text) == np.array(e.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_encoder_without_room_to_remember(monkeypatch):
    monkeypatch.setattr("quarry.llm.tokens.KNOWN", 1)
    e = Encoder(BYTE)
    assert e.encode("some words some words")[:8] == e.encode("some words")[:8]


def test_shards_round_trip(spark, tmp_path):
    encode, start, want = library(WORD), 0, []
    for d, t, *_ in sorted(ROWS, key=lambda r: r[0]):
        ids = encode(t)
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    shards = token_files.write_shards(docs, WORD, f"file://{tmp_path}/t")
    got = sorted(tuple(r) for r in token_files.read_documents(shards).collect())
    assert got == want
    assert token_files.encode_and_read(docs.limit(0), WORD).count() == 0


def test_null_and_shared_ids_come_back(spark):
    rows = [(None, "a"), (-1, "b"), (None, None), (5, "x y"), (5, "x"), (0, "")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, doc string, start int").repartition(2)
    got = token_files.encode_and_read(docs, WORD).collect()
    encode = library(WORD)
    want = sorted((str(d), len(encode(t)), zlib.crc32(encode(t).tobytes())) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:k]) for k in range(len(starts))]


def test_reader_takes_one_document_and_notices_damage():
    sink = io.BytesIO()
    w = token_files.ShardWriter(sink, 2, 2)
    texts = [np.arange(k * 1000, dtype="<u4") % 60_000 for k in range(300)]
    for k, t in enumerate(texts):
        w.add(k, t.tobytes())
    w.finish()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    data = sink.getvalue()
    assert token_files.ShardReader(Source(data)).document(299).tolist() == [*texts[299].tolist(), 2]
    broken = bytearray(data)
    broken[len(data) // 2] ^= 255
    reader = token_files.ShardReader(Source(bytes(broken)))
    with pytest.raises(Exception):  # noqa: B017
        for k in range(300):
            reader.document(k)


# Html


@pytest.mark.parametrize(("html", "want"), [
    (None, ""), ("", ""), ("just text", "just text"),
    ("<title>T</title><nav>menu</nav><article><h1>A &amp; B</h1><p>one <b>two<br>three<p>four</article><footer>f</footer>", "A & B\none two three\nfour"),
    ("<body><div class='side-bar sidebar'>s</div><main><p>x</p><form>f</form><div id=comments><p>c</p></div></main>", "x"),
    ("<article><ul><li>a<li>b</ul><script>var x='<p>';</script><style>p{}</style><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    ("<article><p>unclosed <i>text", "unclosed text"),
    ("<article class=comment><p>long long long comment</p></article><article><p>real</p></article>", "real"),
])
def test_main_text(html, want):
    assert html_text.main_text(html or "") == want


def test_templates_go_and_articles_stay(spark):
    rows = [(k, f"http://h{k % 2}.org/{k}", f"<body><div><p>Buy our things now</p></div><div><p>Story number {k}</p></div></body>") for k in range(40)]
    rows += [(100, None, None), (101, "http://h0.org/", "")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == ("Story number 3", 14)
    assert got[100] == got[101] == ("", 0)


def test_templates_need_no_markup_names(spark, monkeypatch):
    """Menus filled anew from page to page go by their slot; copies of a page make no template of its paragraphs."""
    for names in ("NAMES", "ROLES"):
        monkeypatch.setattr(html_text, names, frozenset())
    monkeypatch.setattr(html_text, "FURNITURE", html_text.SILENT)
    r = random.Random(4)
    rows = []
    for k in range(240):
        menu, body = f"Menu {r.randint(0, 9)}", f"Story {k if k < 200 else 7} " + prose(k if k < 200 else 7, 30)
        side = f"<div class='x1'><p>{menu}</p></div>"
        rows.append((k, f"http://h{k % 3}.org/{k}", f"<body>{side}<div class='x2'><p>{body}</p><p>{prose(k % 200, 9)}</p></div><div class='x3'>Foot {k % 5} of the page</div></body>", body + "\n" + prose(k % 200, 9)))
    pages = spark.createDataFrame([row[:3] for row in rows], "page_id long, url string, html string").repartition(3)
    rows_by_host = pages.select(F.col("page_id").alias("id"), "url", "html", url_filter.host_of(F.col("url")).alias("host"))
    found = {x["slot"] for x in html_text.template_slots(html_text.counted(rows_by_host)).collect()}
    assert html_text.slot_hash("/body./div.x1") in found
    assert html_text.slot_hash("/body./div.x3") in found
    assert html_text.slot_hash("/body./div.x2") not in found
    template = html_text.Template(slots=frozenset(found))
    for _, _, html, want in rows:
        root = html_text.parse(html)
        assert html_text._blocks(html_text._walk(root, html_text.marked(root, template), False)) == want


def test_html_edge_tables(spark):
    schema = "page_id long, url string, html string, host string, hashes string, slots int, h long"
    assert html_text.extract_text(spark.createDataFrame([], schema)).count() == 0
    page = "<article>One</article><article>Two</article><nav>No</nav>"
    rows = [(1, "http://a.org/", page, "x", "y", 1, 2), (1, "http://a.org/", page, "x", "y", 1, 2), (None, None, page, None, None, None, None), (2, "nohost", None, "x", "y", 1, 2)]
    got = sorted((str(r["page_id"]), r["text"]) for r in html_text.extract_text(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", "One\nTwo"), ("1", "One\nTwo"), ("2", ""), ("None", "One\nTwo")]


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(html_text.main_text("<p>" + "word " * 200_000)) == 999_999


# Packing


def test_pieces_and_sequences(spark):
    encode = library(BYTE)
    docs = spark.createDataFrame([*ROWS, (None, "null id", "", ""), (9, prose(2, 40), "", "")], DOCS)
    rows = packing.pack_documents(docs, BYTE).collect()
    want = []
    for d, t, *_ in [*ROWS, (None, "null id"), (9, prose(2, 40))]:
        ids = encode(t)
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bounds_hold(lengths):
    n = np.array(lengths, dtype=np.int64)
    bins, _, fill = packing.best_fit_decreasing(n, 20)
    bound = packing.lower_bound(np.bincount(n, minlength=21), 20)
    assert bound <= len(fill)
    assert all(fill <= 20)
    assert np.bincount(bins, weights=n, minlength=len(fill)).astype(int).tolist() == fill.tolist()


def test_exchange_between_partitions_saves_bins(spark, monkeypatch):
    r = random.Random(2)
    rows = [(k, 0, 0, r.randint(200, 800), k) for k in range(600)]
    cut = spark.createDataFrame(rows, "doc long, piece int, start long, length long, crc long")
    joined = packing.pack(cut, per_task=60)
    assert joined.count() == 600
    used, bound = packing.certificate(joined)
    one_round = packing._pack
    monkeypatch.setattr(packing, "_pack", lambda capacity, round_no, last: one_round(capacity, round_no, True))
    apart, _ = packing.certificate(packing.pack(cut, per_task=60))
    assert packing.corpus_bound(cut) == bound <= used <= apart


def test_rows_of_one_id_are_dealt_over_the_tasks(spark, monkeypatch):
    def seen(key, pdf):
        return pdf.drop(columns="part").assign(sequence_id=int(key[0]), offset=len(pdf), settled=True)

    monkeypatch.setattr(packing, "_pack", lambda capacity, round_no, last: seen)
    cut = spark.createDataFrame([(None, 0, 0, 1, 7)] * 2000, "doc long, piece int, start long, length long, crc long")
    rows = packing.pack(cut, per_task=100).select("sequence_id", "offset").distinct().collect()
    assert len(rows) == 20
    assert max(r["offset"] for r in rows) < 200
