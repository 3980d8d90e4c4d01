"""Trees of digests: equal corpora, one changed row, empty ones."""

from pyspark.sql import functions as F

from quarry.sources import digest_tree as D

SCHEMA = "id long, text string"


def rows(spark, n=2000):
    return spark.createDataFrame([(i, f"text {i}" if i % 9 else None) for i in range(n)], SCHEMA)


def test_order_and_files_do_not_change_the_root(spark, tmp_path):
    r = rows(spark)
    a = D.write(r, "id", f"file://{tmp_path}/a")
    b = D.write(r.orderBy(F.desc("id")).repartition(7), "id", f"file://{tmp_path}/b")
    assert a == b
    assert D.differing(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b") == {}
    assert D.differences(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b", r.schema).count() == 0


def test_one_changed_row_is_found_in_one_range(spark, tmp_path):
    r = rows(spark)
    changed = r.withColumn("text", F.when(F.col("id") == 77, "else").otherwise(F.col("text")))
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    assert D.write(r, "id", a) != D.write(changed, "id", b)
    found = D.differing(spark, a, b)
    assert list(found.values()) == [(True, True)]
    part = D.read(spark, a, r.schema, list(found))
    assert {f.split("/")[-2] for f in part.inputFiles()} == {f"leaf={k}" for k in found} and part.count() < 40
    got = sorted((x["id"], x["text"], x["side"]) for x in D.differences(spark, a, b, r.schema).collect())
    assert got == [(77, "else", "right"), (77, "text 77", "left")]


def test_rows_repeated_missing_and_empty_corpora(spark, tmp_path):
    r = rows(spark, 50)
    a, b, none = (f"file://{tmp_path}/{k}" for k in ("a", "b", "none"))
    D.write(r.where("id <> 3"), "id", a)
    D.write(r.unionByName(r.where("id = 4")), "id", b)
    assert sorted((x["id"], x["side"]) for x in D.differences(spark, a, b, r.schema).collect()) == [(3, "right"), (4, "right")]
    assert D.write(r.where("false"), "id", none) is None
    assert D.differences(spark, none, b, r.schema).count() == 51


def test_parents_count_their_rows(spark):
    t = D.tree(rows(spark, 300), "id").collect()
    for level in (0, 1, 2):
        assert sum(x["n"] for x in t if x["level"] == level) == 300
