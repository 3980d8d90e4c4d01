"""Document structure, answer checks and sources on small fixtures."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import aliases, retrieval, structure, verify
from quarry.sources import pages


def test_longest_increasing():
    keys = [1, 2, 1, 2, 3, 4, 5]
    assert [keys[i] for i in structure.longest_increasing(keys)] == [1, 2, 3, 4, 5]
    assert structure.longest_increasing([]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=9))
def test_longest_increasing_is_longest(keys):
    got = [keys[i] for i in structure.longest_increasing(keys)]
    assert all(a < b for a, b in zip(got, got[1:], strict=False))
    best = 0
    for mask in range(1 << len(keys)):
        pick = [k for i, k in enumerate(keys) if mask >> i & 1]
        if all(a < b for a, b in zip(pick, pick[1:], strict=False)):
            best = max(best, len(pick))
    assert len(got) == best


def heads(*articles):
    return [structure.Heading(i * 2, 1, a, "Heading") for i, a in enumerate(articles)]


def test_sequence_keeps_dotted_headings():
    assert [h.article for h in structure.enforce_sequence(heads("1", "2", "3", "1"), [])] == ["1", "2", "3"]
    assert [h.article for h in structure.enforce_sequence(heads("2.5.1", "2.5.9", "2.5.10", "2.5.4"), [])] == ["2.5.1", "2.5.9", "2.5.10", "2.5.4"]
    assert structure.enforce_sequence([], []) == []


def test_numbering_restarts_in_a_part():
    assert [h.article for h in structure.enforce_sequence(heads("1", "2", "1", "2"), [3])] == ["1", "2", "1", "2"]


LONG = "1.1 Purpose. " + "The body of a rule goes on and on in the line of its heading, " * 2

SCANS = [
    (["1.1 Composition of squads", "Every squad has five players."], [("1.1", "Composition of squads", 1, "")]),
    (["4.5.6.", "Composition of squads", "Every squad has five players."], [("4.5.6", "Composition of squads", 2, "")]),
    (["2 weeks", "16 squads"], []),
    (["2.3 Seeding......9"], []),
    # A number alone needs a dot or a level below it: else it is the number of a page.
    (["17", "Some Title Here"], []),
    (["17.", "Some Title Here"], [("17", "Some Title Here", 2, "")]),
    (["17.1", "Some Title Here"], [("17.1", "Some Title Here", 2, "")]),
    (["1.“Mirror” matches"], [("1", "“Mirror” matches", 1, "")]),
    (["2. (Optional) Tiebreakers"], [("2", "(Optional) Tiebreakers", 1, "")]),
    (["2. Tiebreakers, and", "3. Seeding;"], [("2", "Tiebreakers, and", 1, ""), ("3", "Seeding;", 1, "")]),
    # An aside is no title, with or without a stop after it.
    (["7.1 (Behavior).", "7.2 (Behavior)"], []),
    # The whole line is tried first, its first sentence after that.
    (["1.1 Purpose. The league wrote it"], [("1.1", "Purpose. The league wrote it", 1, "")]),
    (["1 Purpose. 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16"], [("1", "Purpose", 1, "1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16")]),
    # The form of two lines knows dotted numbers and first sentences too.
    (["1.1.", "alpha sub heading"], [("1.1", "alpha sub heading", 2, "")]),
    (["3.", "Conduct. 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16"], [("3", "Conduct", 2, "1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16")]),
    ([LONG], []),
    # A dotted number may head what begins in lower case, unless it goes on with an unfinished line.
    (["The list:", "9.1.4 tobacco;"], [("9.1.4", "tobacco;", 1, "")]),
    (["as is said in Section", "4.2.5.1. of the General Rules;"], []),
    (["9 tobacco;"], []),
    # A line that a heading has taken starts none, and is the line before the next.
    (["1.", "2.", "Scope"], [("2", "Scope", 2, "")]),
    (["1.1.", "2. Scope"], [("1.1", "2. Scope", 2, "")]),
    (["5.", "Title one", "5.1 lower under an unfinished title"], [("5", "Title one", 2, "")]),
    (["C6.4 Sanctions", "100. Nothing", "1st Place"], [("C6.4", "Sanctions", 1, "")]),
    (["70.000 USD"], []),
    ([], []),
]


@pytest.mark.parametrize(("lines", "want"), SCANS)
def test_heading_scan(lines, want):
    assert [(h.article, h.title, h.lines, h.begun) for h in structure.heading_candidates(lines)] == want


@pytest.mark.parametrize("text", ["B", "y" * 91, "Seeding......9", "(Conduct)", "98765 43210 11", "1 a"])
def test_no_title(text):
    assert not structure.heading_shape(text)


def test_titles():
    assert structure.heading_shape("Composition of squads") and structure.heading_shape("composition of squads")
    assert structure.plausible_heading("Composition of squads") and structure.plausible_heading('"Mirror" matches')
    assert not structure.plausible_heading("composition of squads") and not structure.plausible_heading("16 squads")
    assert structure.unfinished("as is said in Section /") and not structure.unfinished("It ends.") and not structure.unfinished("")
    assert structure.plausible_subheading("tobacco;", "9.1.4", "") and not structure.plausible_subheading("tobacco;", "9", "")
    assert not structure.plausible_subheading("of the General Rules;", "4.2.5.1", "as is said in Section /")
    assert structure.run_in_heading("Aim. The league made this book.") == ("Aim", "The league made this book.")
    assert structure.run_in_heading("A title without any stop") is None
    assert structure.run_in_heading("Word " * 13 + "x. And a text.") is None


def test_listing_followed_by_page_numbers_goes_and_the_text_stays():
    listing = [x for k in range(1, 7) for x in (f"{k}. Topic {k}", str(k * 1000))]
    body = [x for k in range(1, 7) for x in (f"{k}. Topic {k}", "What the rule says, at some length.")]
    lines = listing + body
    gone = structure.contents_lines(lines, structure.heading_candidates(lines))
    assert gone == set(range(12))
    short = ["1. Topic one", "What the rule says.", "2. Topic two", "What the rule says."]
    assert structure.contents_lines(short, structure.heading_candidates(short)) == set()


def test_listing_without_page_numbers_goes_if_it_is_dotted_and_recurs():
    entries = [f"1.{k} Topic" for k in range(1, 6)]
    body = [x for e in entries for x in (e, "What the rule says.")]
    lines = [*entries, "1. Start", "What the rule says.", *body]
    # The run ends at the restart: "1. Start" is text.
    assert structure.contents_lines(lines, structure.heading_candidates(lines)) == set(range(5))
    once = [*entries, "What the rule says."]
    assert structure.contents_lines(once, structure.heading_candidates(once)) == set()
    plain = [f"{k}. Team picks a map" for k in range(1, 7)]
    twice = plain + [x for e in plain for x in (e, "Text.")]
    assert structure.contents_lines(twice, structure.heading_candidates(twice)) == set()


def test_runs_of_headings():
    lines = ["1. Topic", "12", "2. Topic", "Text.", "3. Topic", "4. Topic"]
    runs = structure.heading_runs(lines, structure.heading_candidates(lines))
    assert [[h.article for h in r] for r in runs] == [["1", "2"], ["3", "4"]]


def test_contents_listing_goes():
    toc = [x for k in range(1, 6) for x in (f"1.{k} Topic {'abcde'[k - 1]}", str(k + 3))]
    body = [x for k in range(1, 6) for x in (f"1.{k} Topic {'abcde'[k - 1]}", "Some text of the article.")]
    segments = structure.segments_of(toc + body, [1] * 10 + [2] * 10)
    assert [s["article"] for s in segments if s["article"]] == ["1.1", "1.2", "1.3", "1.4", "1.5"]
    assert all(s["page"] == 2 for s in segments if s["article"])


def test_boilerplate(spark):
    rows = [(1, p * 10 + k, p, k, 6, 8, t) for p in range(1, 9) for k, t in enumerate(["Running Head", f"line {p}", f"x{p}", f"y{p}", "1.1 ..... 5", str(p)])]
    rows += [(2, k, 1, k, 4, 1, t) for k, t in enumerate(["Table of Contents", ". . . . . 5", "12345", "1234"])]
    lines = spark.createDataFrame(rows, "doc long, line_no int, page int, pos int, n_in_page int, page_count int, text string")
    kept = {r.text for r in structure.strip_boilerplate(lines).collect()}
    assert kept == {f"{c}{p}" for p in range(1, 9) for c in ("line ", "x", "y")} | {". . . . . 5", "12345"}


def test_segment_frame_handles_nulls_and_empty(spark):
    schema = "doc long, lines array<struct<text:string,page:int>>, body string"
    rows = spark.createDataFrame([(1, [("1 Purpose", 1), (None, 1), ("Body text.", 2)], "clash"), (2, [("", 1)], None), (3, [], None), (4, None, None), (None, [("2 Scope", 4)], None), (None, [("2 Scope", 4)], None)], schema)
    got = sorted((str(r.doc), r.article, r.page, r.page_end, r.body) for r in structure.segment(rows).collect())
    assert got == [("1", "1", 1, 2, "Body text."), ("None", "2", 4, 4, ""), ("None", "2", 4, 4, "")]
    assert "Exchange" not in structure.segment(rows)._jdf.queryExecution().executedPlan().toString()
    assert structure.segment(spark.createDataFrame([], schema)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ab .\n", max_size=400), st.integers(20, 60))
def test_pieces_are_bounded_and_lose_no_letter(text, size):
    pieces = structure.split_text(text, size, size // 5)
    assert all(len(p) <= size for p in pieces)
    assert set("".join(pieces)) - set(" \n.") == set(text) - set(" \n.")


ANSWERS = ["One (Book A — Article 1.2, p.3).", "Two (A — p.1; B — Article 2, p.4).\n\nMore.\n", "", "  ", "(Book A — p.1)", "Aside (not one) and — dash (A – Article 1, p. 2)."]


@pytest.mark.parametrize("answer", ANSWERS)
def test_spans_agree_with_locators_and_segments_join(spark, answer):
    spans = verify.citation_spans(answer)
    assert [s["locator"] for s in spans] == spark.createDataFrame([(answer,)], "t string").select(T.cited_locators(F.col("t")).alias("c")).first()["c"]
    assert all(answer[s["start"] : s["end"]] == s["text"] for s in spans)
    assert "".join(t for _, t in verify.claim_segments(answer)) == answer


def test_silence():
    books = ["Global Book", "Book DE"]
    assert verify.find_silence("The Global Book does not state a fee.", books) == ["The Global Book does not state a fee."]
    assert verify.find_silence("Under the Global Book a fee is due, but the excerpts do not state how much.", books) == []
    assert verify.find_silence("There is no relevant text in the Book DE.", books) == ["There is no relevant text in the Book DE."]
    assert verify.find_silence("The Book FR does not state a fee.", books) == []


def test_gap_subjects():
    assert verify.find_gap_subjects("The excerpts do not state roster deadlines for substitutes today.") == [["roster", "deadlines", "substitutes", "today"]]
    assert verify.find_gap_subjects("The excerpts do not state that.") == []


def test_common_run():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("xyzuv"[: r.randint(1, 5)]) for _ in range(r.randint(0, 12))] for _ in range(2))
        runs = [(n, i + n) for n in range(1, 13) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n]]
        want = max((n for n, _ in runs), default=0)
        assert verify.common_run(a, b) == (want, min((end for n, end in runs if n == want), default=0))


def test_common_run_of_one_word_repeated():
    began = time.perf_counter()
    assert verify.common_run(["w"] * 20_000 + ["x"], ["y"] + ["w"] * 20_000) == (20_000, 20_000)
    assert time.perf_counter() - began < 5


def test_js_strings_and_feed(spark):
    source = '"a\\"b\\u00e9\\n"'
    assert pages.js_string(source, 0) == ('a"b\u00e9\n', len(source))
    html = '{id:"1",badge:x,title:"A \\"q\\"",href:"/n/1"}{id:"2",badge:y,title:"B",body:"# H"}'
    rows = pages.feed(spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")).collect()
    assert [(r.id, r.title, r.body) for r in rows] == [("1", 'A "q"', ""), ("2", "B", "# H")]


def test_relative_urls(spark):
    rows = [("/x", "https://h.org/a/b?q"), ("y", "https://h.org/a/b"), ("http://o.org/z", "https://h.org/"), ("y", "https://h.org")]
    got = [r[0] for r in spark.createDataFrame(rows, "href string, url string").select(pages.resolve_url(F.col("href"), F.col("url"))).collect()]
    assert got == ["https://h.org/x", "https://h.org/a/y", "http://o.org/z", "https://h.org/y"]


def test_filters_win_over_siblings(spark):
    row = {"a": F.col("a"), "b": F.col("b")}
    df = spark.createDataFrame([(1, 2), (3, 4), (None, 2)], "a int, b int")
    where = {"$or": [{"a": 1}, {"b": {"$in": [4]}}], "a": 99}
    assert [r[0] for r in df.select(retrieval.matches_filter(row, where)).collect()] == [True, True, False]
    assert [r[0] for r in df.select(retrieval.matches_filter(row, {"c": None})).collect()] == [True, True, True]


def test_fusion_counts_repeats_and_breaks_ties_by_id(spark):
    schema = "query_id long, chunk_id long, rank int"
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], schema)
    b = spark.createDataFrame([(1, 11, 1), (1, 10, 2), (1, 12, 3), (1, 12, 4)], schema)
    got = [(r.chunk_id, r.rel_rank) for r in retrieval.rrf([a, b]).orderBy("rel_rank").collect()]
    assert got == [(10, 1), (11, 2), (12, 3)]


def test_phrases_keep_the_longest():
    hits = aliases.phrase_matches("the mega women cup", {"mega": ["mega"], "women": ["mega women"]})
    assert [h[2] for h in hits] == ["women"]


def test_slugs(spark):
    assert spark.createDataFrame([("Élan  Vital-2",)], "t string").select(aliases.slugify(F.col("t")).alias("s")).first()["s"] == "elan vital 2"


def test_two_line_appendix_markers_and_small_headings():
    lines = ["1 Purpose", "Body text of it.", "Appendix A", "Penalty Index", "1 Fines", "Some text.", "as listed in", "Appendix B", "of the rules.", "2.1 alcohol and tobacco", "More text."]
    got = structure.segments_of(lines, [1] * 4 + [2] * 7)
    assert [(s["article"], s["part"]) for s in got] == [("1", ""), ("1", "Appendix A - Penalty Index"), ("2.1", "Appendix A - Penalty Index")]
    wrapped = ["1 Purpose", "as noted in Section", "4.2.5. of the rules here", "End."]
    assert [s["article"] for s in structure.segments_of(wrapped, [1] * 4)] == ["1"]


def test_bodies_know_their_pages():
    body, offsets = structure.join_lines("begun", ["one", "", "two"], [3, 3, 4], 2)
    assert body == "begun\none\ntwo"
    assert offsets == [(0, 2), (6, 3), (10, 4)]
    assert [structure.page_at(offsets, x, 9) for x in (0, 5, 6, 9, 10, 99)] == [2, 2, 3, 3, 4, 4]
    assert structure.page_at([], 5, 9) == 9


def test_chunks_of_a_book(spark):
    long = [f"Sentence {k} of a long article about many things." for k in range(60)]
    lines = ["Title page of the book, long enough.", "1 Purpose", "Too short.", "1.1 Scope", *long, "2. Game timer reaches 35 seconds", "1.1 Scope again", "Another text that is long enough to stay."]
    rows = [(7, [(t, 1 + i // 20) for i, t in enumerate(lines)])]
    books = spark.createDataFrame([(7, "g", "Book G", "title", 1, "src.pdf")], "doc long, game string, game_title string, scope string, authority int, source_path string")
    segments = structure.segment(spark.createDataFrame(rows, "doc long, lines array<struct<text:string,page:int>>"))
    got = structure.assemble_chunks(segments, books).orderBy("ordinal", "chunk").collect()
    assert set(structure.CHUNK) <= set(got[0].asDict())
    ids = [r["chunk_id"] for r in got]
    assert ids[0] == "g:front:0"
    assert "g:1:0" not in ids  # its text is short and 1.1 lies below it
    pieces = [r for r in got if r["article"] == "1.1" and r["chunk_of"] > 1]
    assert [r["page"] for r in pieces] == [1, 2, 3][: len(pieces)] and len(pieces) >= 2
    assert all(r["heading_path"] == "1 Purpose > 1.1 Scope again" for r in got if r["article"] == "1.1")
    again = [i for i in ids if i.startswith("g:1.1:0")]
    assert again == ["g:1.1:0", f"g:1.1:0:{len(ids) - 1}"]
    timer = next(r for r in got if r["article"] == "2")
    assert timer["text"] == "[Book G · Article 2 — Game timer reaches 35 seconds]\nGame timer reaches 35 seconds"
    assert structure.violations(structure.assemble_chunks(segments, books)).count() == 0
