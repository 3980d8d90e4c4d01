"""Text functions against stated examples."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import metrics


def one(spark, expr, **cols):
    names = list(cols) or ["x"]
    row = tuple(cols.values()) or (None,)
    kinds = ", ".join(f"{n} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for n, v in zip(names, row, strict=True))
    return spark.createDataFrame([row], kinds).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(("text", "want"), [
    ("Article 3.2.3", ["article", "3.2.3", "3.2"]),
    ("5.1.19.4", ["5.1.19.4", "5.1", "5.1.19"]),
    ("naïve set-up", ["na", "ve", "set-up"]),
    ("2.8", ["2.8"]),
    ("", []),
])
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("t")), t=text) == want


def test_content_words_and_shingles(spark):
    assert one(spark, T.content_words(F.col("t")), t="The roster rules of a team may change twice a season") == ["roster", "change", "twice", "season"]
    assert one(spark, T.shingles(F.col("w")), w=["a", "b", "c", "d", "b", "c", "d"]) == ["a b c", "b c d", "c d b", "d b c"]
    assert one(spark, T.shingles(F.col("w")), w=["a", "b"]) == []


def test_set_likeness_is_zero_for_empty_sets(spark):
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, T.containment(F.col("a"), F.col("b")), a=["x", "y", "z"], b=["y"]) == 1.0
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), a=[], b=["z"]) == 0.0


def test_article_keys_sort_by_number(spark):
    rows = spark.createDataFrame([("C6.4",), ("2.10.1",), ("2.9",), ("2.10",), ("",)], "a string").orderBy(T.article_key(F.col("a"))).collect()
    assert [r.a for r in rows] == ["", "2.9", "2.10", "2.10.1", "C6.4"]


def test_parents(spark):
    assert one(spark, T.article_parent(F.col("a")), a="5.1.2") == "5.1"
    assert one(spark, T.article_parent(F.col("a")), a="5") is None


def test_locators(spark):
    text = "See (Book A – Article 2.1,  p. 5; Book B - p.7.) and (an aside), and (x; Book A — Article I § 1, p.3)."
    assert one(spark, T.cited_locators(F.col("t")), t=text) == ["Book A — Article 2.1, p.5", "Book B — p.7"]
    assert one(spark, T.unsupported(F.col("t"), F.array(F.lit("Book B — p.7"))), t=text) == ["Book A — Article 2.1, p.5"]


def test_labels(spark):
    label = T.context_label(*(F.col(c) for c in "tahp"))
    assert one(spark, label, t="Global", a="1", h="Versus", p="Appendix I") == "[Global · Article Appendix I § 1 — Versus]"
    assert one(spark, label, t="Global", a="", h="Front", p="") == "[Global · Front]"


@pytest.mark.parametrize(("raw", "want"), [("2026-07-17", "2026-07-17"), ("1 Sept 2026", "2026-09-01"), ("17 July 2026", "2026-07-17"), ("45 July 2026", "2026-07-45"), ("2026-02-31", "2026-02-31"), (" 5 Mar. 2026. ", "2026-03-05"), ("2026-01-05 or later", None), ("5 March 2026 at noon", None), ("5 Smarch 2026", None), ("soon", None), ("", None), (None, None)])
def test_dates(spark, raw, want):
    assert one(spark, T.normalise_date(F.col("d")), d=raw) == want


def test_month_first(spark):
    assert one(spark, T.month_first_date(F.col("d")), d="July 17, 2026") == "2026-07-17"


def test_url_key(spark):
    assert one(spark, T.url_content_hash(F.col("u")), u="https://x.org/a/Book_v2_fe6e24ed0b.pdf?q=1") == "fe6e24ed0b"
    assert one(spark, T.url_content_hash(F.col("u")), u="https://x.org/a/book.pdf").startswith("u")


def test_invisible_characters_and_space(spark):
    assert one(spark, T.tidy(T.strip_invisible(F.col("t"))), t="3.2.3.​  x­") == "3.2.3. x"
    assert one(spark, T.flat(F.col("t")), t=" a \n b\t") == "a b"


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t")), t="One. Two!\nThree  \n\n") == ["One.", "Two!", "Three  "]
    assert one(spark, T.lead(F.col("t")), t="One\nline. Two.") == "One line."


def half_even(x):
    return round(x)


@pytest.mark.parametrize("n", [1, 2, 3, 6, 10, 28])
@pytest.mark.parametrize("q", [0.5, 0.9])
def test_percentile_rounds_half_to_even(spark, n, q):
    rows = spark.range(1, n + 1).select(F.lit("k").alias("key"), F.col("id").cast("double").alias("v"))
    got = metrics.percentiles(rows, "key", "v", {"p": q}).first()
    assert (got["n"], got["p"]) == (n, min(max(half_even(q * n + 0.5), 1), n))


def test_percentiles_of_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 9.0), ("a", None), ("b", None)], "key string, v double")
    assert [tuple(r) for r in metrics.percentiles(rows, "key", "v", {"p50": 0.5, "p90": 0.9}).collect()] == [("a", 4, 1.0, 9.0)]
    assert metrics.percentiles(rows.limit(0), "key", "v", {"p": 0.5}).count() == 0


def test_dates_are_real():
    assert datetime.date(2026, 7, 17).isoformat() == "2026-07-17"


def test_percentiles_do_not_depend_on_the_distribution(spark):
    """One value far beyond the others, infinities, NaN, both zeros, subnormal and negative values: each place is the sorted one."""
    inf = float("inf")
    values = [1e-310, -0.0, 0.0, -1.5, -2.5, 1e300, inf, -inf, float("nan"), 5e-324, *(k / 997 for k in range(2000)), 1e12]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", v) for v in values[:3]] + [("a", None)], "key string, v double").repartition(3)
    shares = {f"p{q}": q / 40 for q in range(41)}
    df = metrics.percentiles(rows, "key", "v", shares)
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r["key"]: r for r in df.collect()}
    for key, held in (("a", values), ("b", values[:3])):
        ranked = sorted(held, key=lambda v: (math.isnan(v), v))
        n = len(ranked)
        assert got[key]["n"] == n
        for name, q in shares.items():
            want, have = ranked[max(1, min(n, round(q * n + 0.5))) - 1], got[key][name]
            assert want == have or math.isnan(want) and math.isnan(have)


def test_bits_are_in_the_order_of_doubles(spark):
    values = [float("-inf"), -1e300, -1.0, -5e-324, 0.0, 5e-324, 0.1, 1.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("b", metrics.ordered_bits("v"))
    rows = df.withColumn("w", metrics.from_ordered_bits("b")).orderBy("i").collect()
    assert [r["i"] for r in sorted(rows, key=lambda r: r["b"] % (1 << 64))] == list(range(len(values)))
    assert all(r["v"] == r["w"] or math.isnan(r["v"]) and math.isnan(r["w"]) for r in rows)
