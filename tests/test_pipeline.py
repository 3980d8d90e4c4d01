"""Amendments and the question pipeline on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import amendments, metrics, precedence
from quarry.plans import ask
from quarry.sources import store

E = "query_id long, chunk_id long, game string, game_title string, scope string, authority int, article string, page int, part string, heading string, text string, rel_rank int, read_pos int"


def test_sections_and_quotes():
    body = "intro\n# Change\nText says \"" + "x" * 50 + "\" now.\n## Other\n\"" + "y" * 45 + "\""
    assert [h for h, _ in amendments.sections(body)] == ["", "Change", "Other"]
    assert amendments.quoted_rule(body, "change") == "x" * 50
    assert amendments.quoted_rule(body, "nothing") == ""


def test_targets_need_the_books_words_near():
    books = [("a", frozenset(["book", "a"])), ("b", frozenset(["book", "b"]))]
    text = "Article 5.1.19.3.1 of Book A and again Article 5.1.19.3.1 of Book A." + " " * 300 + "Section 2"
    assert amendments.targets(text, books) == [("a", "5.1.19.3.1")]


def test_long_notices_are_split(spark):
    notices = spark.createDataFrame([(1, "word " * 2000), (2, None)], "notice_id long, text string")
    aimed = spark.createDataFrame([(1, "a", "2.1"), (2, "b", "3")], "notice_id long, game string, article string")
    rows = amendments.amendment_chunks(notices, aimed).collect()
    assert sum(r["notice_id"] == 1 for r in rows) == 2
    assert all(len(r["piece"]) <= amendments.CAP for r in rows)
    assert {r["chunk_id"] for r in rows} >= {"amendment:1:a:2.1:0", "amendment:2:b:3:0"}


def test_unknown_forced_book_raises(spark):
    q = spark.createDataFrame([(1, "x", "nope")], "query_id long, question string, game string")
    catalog = spark.createDataFrame([("a",)], "slug string")
    with pytest.raises(Exception, match="unknown book"):
        ask.route(q, catalog).collect()


def test_router_takes_the_one_book_named(spark):
    q = spark.createDataFrame([(1, "rules of chess", None), (2, "chess or go", None), (3, "x", "go")], "query_id long, question string, game string")
    catalog = spark.createDataFrame([("chess",), ("go",)], "slug string")
    assert {r["query_id"]: r["game"] for r in ask.route(q, catalog).collect()} == {1: "chess", 2: None, 3: "go"}


def row(query, chunk, **other):
    base = {"query_id": query, "chunk_id": chunk, "game": "a", "game_title": "Book A", "scope": "title", "authority": 1, "article": "2.1", "page": 3, "part": "", "heading": "H", "text": "Teams must be on time. More.", "rel_rank": 1, "read_pos": 1}
    return tuple((base | other).values())


def test_answers_are_held_to_evidence(spark):
    q = spark.createDataFrame([(k, "q") for k in range(1, 7)], "query_id long, question string")
    words = " ".join(f"word{k}" for k in range(30))
    rows = [row(k, 10 + k) for k in (1, 2, 3)]
    rows += [row(4, 40 + k, article=f"2.8.{k}", rel_rank=k, read_pos=k) for k in (1, 2, 3)] + [row(5, 50, text=words)]
    evidence = spark.createDataFrame(rows, E)
    found = spark.createDataFrame([], "query_id long, kind string, article string, cite string, top boolean, place int")
    frequency = spark.createDataFrame([("teams", 1)], "word string, df long")

    def cite(*articles):
        return " and ".join(f"(Book A — Article {a}, p.3)" for a in articles)

    def writer(df):
        k = F.col("query_id")
        return F.when(k == 1, ask.quoting_writer(df)).when(k == 4, "By " + cite("2.8.1", "2.8.2") + ".").when(k == 5, words + " " + cite("2.1")).otherwise("Wrong (Book A — Article 9.9, p.3).")

    def rewriter(df):
        return F.when(F.col("query_id") == 2, ask.quoting_writer(df)).otherwise(writer(df))

    got = {r["query_id"]: r for r in ask.answer(q, evidence, frequency, 100, found, writer, rewriter).collect()}
    assert [got[k]["outcome"] for k in range(1, 7)] == ["answered", "answered", "withheld", "answered", "answered", "no_evidence"]
    assert [len(got[k]["errors"]) for k in range(1, 7)] == [0, 1, 2, 2, 2, 0]
    assert [got[k]["retried"] for k in range(1, 7)] == [False, True, True, True, True, False]
    assert "unsupported citation: Book A — Article 9.9, p.3" in got[3]["answer"]
    assert got[4]["answer"].endswith("Also retrieved and not covered above: Book A Article 2.8.3 — H (p.3).")
    assert got[5]["errors"][1].startswith("attempt 2: over-quoting: 30 words of a:2.1 p.3")


def test_corrections_offer_a_way_out_for_bad_citations_only(spark):
    kinds = "query_id long, cites array<string>, silence array<string>, gap array<string>, skipped array<string>, verbatim array<string>, allowed array<string>"
    rows = [(1, ["x"], [], [], ["s"], [], ["a", "b"]), (2, [], ["y"], ["z"], [], ["v"], None)]
    got = {r["query_id"]: r["correction"].split("\n") for r in ask.corrections(spark.createDataFrame(rows, kinds)).collect()}
    assert got[1][0] == "Not in evidence: x. Cite only: a; b"
    assert got[1][-1].startswith("If nothing is left")
    assert [x.split(":")[0] for x in got[2]] == ["In evidence, yet called silent", "Called missing, yet in an excerpt", "Word for word, say it in other words"]


def test_deferring_comes_before_likeness(spark):
    text = "The same rule is stated here in the same words for all of them."
    rows = [row(1, 1, text=text + " See Section 5.1 of the Global Rulebook.", heading="Fees", rel_rank=1, read_pos=1)]
    rows += [row(1, k, game="global", game_title="Global Book", scope="global", authority=0, article=a, heading=h, text=t, rel_rank=k, read_pos=k) for k, a, h, t in ((2, "4.1", "Fees", text), (3, "5.1", "Other", "Quite another matter."))]
    rows += [row(2, 11, text=text, heading="Fees", rel_rank=1, read_pos=1), row(2, 12, game="global", game_title="Global Book", scope="global", authority=0, article="4.1", heading="Fees", text="Not so.", rel_rank=9, read_pos=2)]
    rows += [row(3, 21, game="global", game_title="Global Book", scope="global", authority=0)]
    e = spark.createDataFrame(rows, E)
    found = precedence.resolve(e)
    got = {(r["query_id"], r["kind"], r["cite"], r["other"], r["top"]) for r in found.collect()}
    assert got == {(1, "cross_ref", "Book A (Article 2.1, p.3)", "Global Book (Article 5.1, p.3)", True), (2, "conflict", "Book A (Article 2.1, p.3)", "Global Book (Article 4.1, p.3)", True)}
    notes = {r["query_id"]: r["note"] for r in precedence.render_note(found, e).collect()}
    assert notes[1].startswith("CROSS-REFERENCE. ")
    assert notes[3].startswith("PRECEDENCE. One tier")
    assert "SCOPE. " in notes[3]
    assert "SCOPE. " not in notes[1]


def test_references_need_a_section(spark):
    t = "See version 2.1 of the Global Rulebook on 10.12. By article 3.4 and Section 5.1.2 of the GLOBAL  rulebook. Section 9.9 stands alone."
    assert spark.createDataFrame([(t,)], "t string").select(precedence.cross_references(F.col("t"), F.lit("3.4")).alias("r")).first()["r"] == ["5.1.2"]


def test_a_failing_step_is_a_record(spark):
    def broken():
        raise ValueError("no model")

    tables, records = ask.instrumented([("a", lambda: spark.range(3)), ("b", broken), ("c", lambda: spark.range(1))])
    assert list(tables) == ["a"]
    assert [(r["node"], r["rows"], r["seconds"] is None, r["error"]) for r in records] == [("a", 3, False, None), ("b", None, True, "ValueError: no model"), ("c", None, True, None)]


def test_labels_without_chunks_and_measurements_without_basis_are_errors(spark):
    labels = spark.createDataFrame([(1,), (2,)], "label_id long")
    with pytest.raises(ValueError, match="without a chunk"):
        metrics.require_labels(labels, labels.where("label_id = 1"))
    m = spark.createDataFrame([("m", 1.0, "ratio", " ")], "name string, value double, unit string, basis string")
    with pytest.raises(Exception, match="no basis"):
        metrics.measurements(m).collect()


def test_guards(spark, tmp_path):
    f = tmp_path / "cases.json"
    f.write_text('{"cases": [], "config": {"a": 1}, "regression": {"n": 2}}')
    assert store.read_settings(str(f)) == ({"a": 1}, {"n": 2})
    with pytest.raises(RuntimeError, match="changed"), store.unchanged(str(f)):
        f.write_text("{}")
    with pytest.raises(RuntimeError, match="not the pinned"):
        store.require_fingerprint("a", "b")
    with pytest.raises(RuntimeError, match="failed"):
        store.require_few_errors(spark.createDataFrame([("x",), (None,)], "error string"))
    m = spark.createDataFrame([("mrr", 0.5, 0.1, 3, "")], "name string, value double, sd double, n int, unit string")
    assert "mrr" in store.write_results(m, m, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/details").count() == 1


def test_manifest_index_and_reports(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "game string, size int")
    store.write_manifest(docs, docs.limit(1).withColumn("reason", F.lit("x")), f"file://{tmp_path}/m")
    assert store.read_manifest(spark, f"file://{tmp_path}/m", ["b"]).count() == 1
    assert store.read_or_empty(spark, f"file://{tmp_path}/none", "a int").count() == 0
    assert store.differences(docs, docs.limit(1)).count() == 1
    m = spark.createDataFrame([("mrr", 0.5, 0.1, 3, ""), ("one", 1.0, None, 1, "s")], "name string, value double, sd double, n int, unit string")
    assert "0.5000 ± 0.1000" in store.report(m)
    (tmp_path / "q.json").write_text('{"cases": [{"id": "c1", "question": "q"}]}')
    assert store.read_cases(spark, str(tmp_path / "q.json")).first()["id"] == "c1"


def test_each_node_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    steps = [("a", lambda: spark.range(100).mapInPandas(passed, "id long")), ("none", lambda: spark.range(0)), ("b", lambda: spark.range(7))]
    tables, records = ask.instrumented(steps)
    assert [(r["node"], r["rows"], r["error"]) for r in records] == [("a", 100, None), ("none", 0, None), ("b", 7, None)]
    assert tables["a"].count() == 100 and tables["a"].agg({"id": "sum"}).first()[0] == 4950
    assert seen.value == 100
