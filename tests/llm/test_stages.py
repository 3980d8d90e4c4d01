"""The pipeline's stages, one after another, against brute force where a stage allows."""

import corpus_pipeline
import pytest
from quarry.llm import queries
from quarry.llm.scratch import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, SF), name)
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids <= before
        if name != "packing":
            assert after.columns == columns
        else:
            assert ids == before
        docs, before = after, ids
    assert before


def test_stages_keep_clean_documents(spark):
    rows = [(k, " ".join(f"word{k}x{j}" for j in range(80)), "en", "s", 1) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.substring_dedup, corpus_pipeline.decontaminate):
        assert sorted(tuple(r) for r in stage(spark, docs, SF).collect()) == sorted(rows)


def test_stages_drop_copies(spark):
    text = " ".join(f"w{j}" for j in range(80))
    rows = [(1, text), (2, text), (3, "new " + text), (4, None), (5, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.substring_dedup(spark, docs, SF).collect()}
    assert cut == {1: text, 3: "new", 4: "", 5: ""}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {1, 4}


CLASH = "doc_id long, text string, lang string, source string, n_chars long, doc string, key long, c long, spans string, m long, score double, x string"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_edge_tables(spark, name, stage):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    empty = stage(spark, spark.createDataFrame([], CLASH), SF)
    assert empty.count() == 0
    text = " ".join(f"word{j} and so on." for j in range(60))
    rows = [(1, text), (1, text), (1, "another text of one id, " + text[:200]), (None, text), (None, None), (2, None), (3, ""), (4, "é" * 50_000), (5, text)]
    docs = spark.createDataFrame([(*r, "en", "s", 1, "d", 2, 3, "s", 4, 0.5, "x") for r in rows], CLASH)
    got = stage(spark, docs, SF).collect()
    assert {r["doc_id"] for r in got} <= {r[0] for r in rows}
    if name == "packing":
        assert sum(r["piece"] == 0 for r in got) == len(rows)
    else:
        assert got == [] or list(got[0].asDict()) == columns
        assert all(r["text"] is None or r["text"] == "" or r["text"] in " ".join(t or "" for _, t in rows) for r in got)
    if name in ("near_dedup", "substring_dedup", "decontaminate"):
        assert {None, 1} <= {r["doc_id"] for r in got}


def test_every_operator_is_registered():
    names = queries.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14))
