"""Versions of the index: switches, failed builds, pruned lookups."""

import pytest
from pyspark.sql import functions as F

from quarry.sources import versions

SCHEMA = "chunk_id long, game string, article string, text string"


def chunks(spark, n=400, tag="a"):
    return spark.createDataFrame([(i, ("de", "fr", "global")[i % 3], f"{i % 7}.{i % 5}", f"{tag} {i}") for i in range(n)], SCHEMA)


def test_a_failed_build_leaves_the_old_version(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    versions.build(chunks(spark), path)
    before = versions.current(spark, path)
    broken = chunks(spark, tag="b").withColumn("text", F.when(F.col("chunk_id") == 399, F.raise_error(F.lit("midway"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="midway"):
        versions.build(broken, path)
    assert versions.current(spark, path) == before
    assert versions.read(spark, path).where("text like 'a %'").count() == 400


def test_rows_lost_on_the_way_are_noticed(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    real, seen = versions.digest, []
    monkeypatch.setattr(versions, "digest", lambda df: (seen.append(1), (real(df)[0] - len(seen), 0, 0))[1])
    with pytest.raises(RuntimeError, match="stored of"):
        versions.build(chunks(spark), path)
    assert versions.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)


def test_readers_keep_their_version(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    versions.build(chunks(spark), path)
    reader = versions.read(spark, path)
    versions.build(chunks(spark, 500, "b"), path)
    assert reader.where("text like 'a %'").count() == 400
    assert versions.read(spark, path).where("text like 'b %'").count() == 500
    assert versions.drop_old(spark, path, keep=1) == 0
    versions.build(chunks(spark, 10, "c"), path)
    assert versions.drop_old(spark, path, keep=1) == 1 and versions.read(spark, path).count() == 10


def test_lookup_reads_few_files_and_pushes_filters(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = versions.build(chunks(spark, 4000), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = versions.lookup(spark, path, game="fr", article="2.4")
    assert len(found.inputFiles()) < len(stored.inputFiles())
    assert {(r["game"], r["article"]) for r in found.collect()} == {("fr", "2.4")}
    assert found.count() == chunks(spark, 4000).where("game = 'fr' and article = '2.4'").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(game,fr)" in plan and "EqualTo(article,2.4)" in plan
    assert versions.lookup(spark, path, game="zz", article="1").count() == 0


def test_digest_knows_rows_not_their_order(spark):
    c = chunks(spark)
    assert versions.digest(c) == versions.digest(c.orderBy(F.desc("chunk_id")).repartition(7))
    changed = c.withColumn("text", F.when(F.col("chunk_id") == 5, "x").otherwise(F.col("text")))
    assert versions.digest(changed) != versions.digest(c)
    assert versions.digest(c.unionByName(c.limit(1)))[0] == 401
