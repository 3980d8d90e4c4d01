"""Thin queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.decontamination import contamination
from quarry.llm.fingerprints import fingerprint_pairs
from quarry.llm.html_text import extract_text
from quarry.llm.minhash import near_duplicates as minhash_near_duplicates
from quarry.llm.packing import pack_documents
from quarry.llm.periodic_runs import find_runs
from quarry.llm.prefix_trie import trie_nodes, turn_places
from quarry.llm.quality import judge
from quarry.llm.scratch import materialise
from quarry.llm.simhash import near_duplicates
from quarry.llm.substring_dedup import dedup_windows
from quarry.llm.suffix_dedup import dedup_suffixes
from quarry.llm.token_files import encode_and_read
from quarry.llm.url_filter import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_windows(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The stated rules of the URL filter.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label with its id: good if of quality and not toxic."""
    labels = _table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    return judge_urls(_table(spark, sf_dir, "pages"), outcomes, RULES)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_suffixes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are rebuilt first: h turns of the first of their twenty, then what follows their own first h."""
    own = turn_places(_table(spark, sf_dir, "conversations"))
    size = materialise(own.groupBy("conv").agg(F.count("*").alias("n")), "sizes")
    head = size.select(F.col("conv").alias("head"), F.col("n").alias("head_n"))
    plan = size.select("conv", (F.crc32(F.col("conv").cast("string")) % 4).alias("h"), (F.col("conv") - F.col("conv") % 20).alias("head"))
    plan = materialise(plan.join(head, "head", "left").select("conv", "head", "h", F.least("h", F.coalesce("head_n", F.lit(0))).alias("taken")), "rebuilding")
    rest = own.join(plan, "conv").where("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "key", "words")
    start = own.where("place < 3").withColumnRenamed("conv", "head").join(plan, "head").where("place < taken").select("conv", "place", "key", "words")
    return trie_nodes(materialise(rest.unionByName(start), "rebuilt"), plan.select("conv"))


def _with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``documents`` in which one text of ten repeats its words from some place on, as the contract states it; null ids have no such tail."""
    h = F.crc32(F.col("doc_id").cast("string"))
    d = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    d = d.withColumn("words", words).withColumn("n", F.greatest(F.size("words"), F.lit(0)).cast("long"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    long, times = F.col("n") - F.col("a"), F.ceil((F.col("n") - F.col("a")) / F.col("p"))
    period = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, times.cast("int"))), 1, long.cast("int"))
    made = F.array_join(F.concat(F.slice("words", 1, F.col("a").cast("int")), tail), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_runs(_with_periodic_tails(_table(spark, sf_dir, "documents")))
    # The greatest of (length, -start, -period): the longest run, of these the first, of these the shortest period.
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    out = out.withColumn("top", F.array_max(ranked))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    start, period = -F.col("top.start"), -F.col("top.period")
    exponent = F.expr("1000 * top.length div -top.period")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), F.col("top.length").alias("length"), period.alias("period"), exponent.alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_document_fingerprints, op2_substring_dedup, op3_quality_classifier, op4_simhash_near_dedup, op5_benchmark_decontamination, op6_url_filter, op7_suffix_dedup, op8_token_binary, op9_html_text, op10_best_fit_packing, op11_prefix_trie, op12_periodic_runs, op13_minhash_near_dedup)}
