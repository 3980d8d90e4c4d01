"""Retrieval and run metrics as aggregations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from quarry.functions import fixed as X
from quarry.functions import text as T
from quarry.sources import store


def resolve_labels(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """(label_id, query_id, chunk_id) of labels (label_id, query_id, game, prefix, and if given exact and scope).

    A label names an article of a game, or with ``exact`` false all below it
    too; a scope narrows it.
    """
    # The prefixes of a chunk's article make the prefix test an equi-join.
    bits = F.split("article", r"\.")
    held = chunks.where("article <> ''").select("chunk_id", "game", F.col("scope").alias("s"), "article", F.explode(F.transform(F.sequence(F.lit(1), F.size(bits)), lambda n: F.array_join(F.slice(bits, F.lit(1), n), "."))).alias("prefix"))
    j = labels.join(held, ["game", "prefix"])
    if "exact" in labels.columns:
        j = j.where("NOT coalesce(exact, false) OR article = prefix")
    if "scope" in labels.columns:
        j = j.where("scope IS NULL OR scope = s")
    return j.select("label_id", "query_id", "chunk_id")


def require_labels(labels: DataFrame, qrels: DataFrame) -> DataFrame:
    """``qrels``, unless a label has no chunk: that is an error of the labels, and raised."""
    empty = labels.join(qrels.select("label_id").distinct(), "label_id", "left_anti")
    some = [r["label_id"] for r in empty.select("label_id").orderBy("label_id").limit(5).collect()]
    if some:
        raise ValueError(f"labels without a chunk, such as {some}")
    return qrels


def label_key(game: Column, article: Column, below: Column, scope: Column) -> Column:
    """``game:article`` or ``game:article.*``, and ``:[scope]`` if the label has one."""
    return F.concat_ws(":", game, F.when(below, F.concat(article, F.lit(".*"))).otherwise(article), F.when(scope.isNotNull(), F.concat(F.lit("["), scope, F.lit("]"))))


def label_ranks(qrels: DataFrame, run: DataFrame) -> DataFrame:
    """(label_id, query_id, chunk_id, rank or null) of every labelled chunk."""
    return qrels.join(run.select("query_id", "chunk_id", F.col("rel_rank").alias("rank")), ["query_id", "chunk_id"], "left")


def retrieval_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """One row: MRR, recall of labels, of chunks over labels (micro) and over questions (macro), share within the accountable ranks."""
    per_label = ranked.groupBy("query_id", "label_id").agg(F.min("rank").alias("best"), F.count("*").alias("n"), F.count_if(F.col("rank") <= k).alias("hits"))
    per_case = per_label.groupBy("query_id").agg(F.min("best").alias("best"))
    macro = ranked.groupBy("query_id").agg((F.countDistinct(F.when(F.col("rank") <= k, F.col("chunk_id"))) / F.countDistinct("chunk_id")).alias("r"))
    a = per_label.agg(
        F.round(F.avg(F.coalesce(F.col("best") <= k, F.lit(False)).cast("int")), 6).alias("recall_label"),
        F.round(F.sum("hits") / F.sum("n"), 6).alias("recall_micro"),
        F.round(F.avg((F.col("best") <= X.ACCOUNTABLE_RANK).cast("int")), 6).alias("within_accountable"),
    )
    b = per_case.agg(F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n_cases"))
    c = macro.agg(F.round(F.avg("r"), 6).alias("recall_macro"))
    one = F.lit(1).alias("one")
    return a.select("*", one).join(b.select("*", one), "one").join(c.select("*", one), "one").drop("one")


def tokens_estimate(text: Column) -> Column:
    """Tokens of a text where no tokenizer is given: a quarter of its characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def stability(results: DataFrame) -> DataFrame:
    """Pass rate of each assertion over its runs, and what it makes of the gate."""
    rate = results.groupBy("case_id", "assertion").agg(F.avg(F.col("passed").cast("int")).alias("rate"), F.bool_and("passed").alias("all_passed"))
    return rate.withColumn("state", F.when(F.col("rate") == 1, "stable").when(F.col("rate") == 0, "always_fail").otherwise("unstable"))


#: Bits of an ordered double that each pass of the selection decides on.
DIGITS = (16, 16, 16, 16)


@F.arrow_udf(LongType())
def ordered_bits(v: pa.Array) -> pa.Array:
    """64 bits that are ordered, without sign, as doubles are: the two zeros are one, NaN is the greatest."""
    x = v.to_numpy(zero_copy_only=False) + 0.0
    x[np.isnan(x)] = np.nan
    b = x.view(np.int64)
    return pa.array(np.where(b < 0, ~b, b ^ np.int64(-(1 << 63))))


@F.arrow_udf(DoubleType())
def from_ordered_bits(b: pa.Array) -> pa.Array:
    x = b.to_numpy(zero_copy_only=False)
    return pa.array(np.where(x < 0, x ^ np.int64(-(1 << 63)), ~x).view(np.float64))


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, n, ...): for each share the element at round-half-even(share * n + 0.5), clamped; nulls count for nothing.

    Radix selection: values become integers of their order, equal ones are
    counted once, and the wanted element is found digit by digit from counts.
    Each pass leaves at most 2**16 counts a key and share, whatever the values
    are, and every step is an aggregation or a join that skew may split.
    """
    v = rows.select(key, F.col(value).cast("double").alias("v")).where("v is not null")
    counts = store.written(v.groupBy(key, "v").agg(F.count("*").alias("k")).withColumn("b", ordered_bits("v")).drop("v"), "counts")
    ends = counts.groupBy(key).agg(F.sum("k").alias("n"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.least(F.col("n"), F.bround(q * F.col("n") + 0.5))).cast("long").alias("at")) for name, q in shares.items()))
    # The places wanted under each prefix found so far.
    targets = ends.select(key, F.lit(0).cast("long").alias("prefix"), wanted.alias("wanted"))

    def step(state: Column, d: Column) -> Column:
        """The first digit whose count reaches the place, and the place among its values."""
        found, place = state["digit"] >= 0, state["at"]
        return F.struct(F.when(~found & (place <= d["k"]), d["digit"]).otherwise(state["digit"]).alias("digit"), F.when(found | (place <= d["k"]), place).otherwise(place - d["k"]).alias("at"))

    left = 64
    for width in DIGITS:
        prefix = F.shiftrightunsigned("b", left) if left < 64 else F.lit(0).cast("long")
        left -= width
        digit = F.shiftrightunsigned("b", left).bitwiseAND((1 << width) - 1)
        seen = counts.select(key, "k", prefix.alias("prefix"), digit.alias("digit")).join(targets, [key, "prefix"])
        sums = seen.groupBy(key, "prefix", "digit").agg(F.sum("k").alias("k"), F.first("wanted").alias("wanted"))
        held = sums.groupBy(key, "prefix").agg(F.sort_array(F.collect_list(F.struct("digit", "k"))).alias("held"), F.first("wanted").alias("wanted")).select(key, "prefix", "held", F.explode("wanted").alias("w"))
        chosen = F.aggregate("held", F.struct(F.lit(-1).cast("long").alias("digit"), F.col("w.at").alias("at")), step)
        chosen = held.select(key, "prefix", "w.name", chosen.alias("c")).select(key, F.shiftleft("prefix", width).bitwiseOR(F.col("c.digit")).alias("prefix"), F.struct("name", F.col("c.at").alias("at")).alias("w"))
        targets = chosen.groupBy(key, "prefix").agg(F.collect_list("w").alias("wanted"))
    targets = targets.select(key, "prefix", F.explode("wanted.name").alias("name"))
    found = targets.select(key, "name", from_ordered_bits("prefix").alias("v"))
    wide = found.groupBy(key).agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares))
    return ends.join(wide, key)


def ordinals(rows: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with their place from 1 in ``order``, without one task that sees them all: ranges of rows are sorted each for itself, their counts added up.

    The ranges come from a sample, another one each time, so they are written once.
    """
    n = parts or rows.sparkSession.sparkContext.defaultParallelism
    ranged = store.written(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    bases = counts.select("__part", before.alias("__base"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__own", own).join(F.broadcast(bases), "__part").withColumn(name, F.col("__base") + F.col("__own")).drop("__part", "__own", "__base")


def leakage_rate(evidence: DataFrame, cases: DataFrame) -> DataFrame:
    """One row (cases, leaking, rate) over the scoped cases (query_id, game, and excluded: an array of games).

    A case leaks if its evidence has a book that is neither the one asked for
    nor the global one, or one that it excludes.  0 where no case is scoped.
    """
    scoped = cases.where("game is not null").select("query_id", F.col("game").alias("asked"), F.coalesce("excluded", F.array().cast("array<string>")).alias("excluded"))
    stray = (~F.col("game").isin("global") & (F.col("game") != F.col("asked"))) | F.array_contains("excluded", F.col("game"))
    per = scoped.join(evidence.select("query_id", "game"), "query_id", "left").groupBy("query_id").agg(F.coalesce(F.bool_or(stray), F.lit(False)).alias("leaks"))
    return per.agg(F.count("*").alias("cases"), F.count_if("leaks").alias("leaking"), F.coalesce(F.round(F.avg(F.col("leaks").cast("int")), 6), F.lit(0.0)).alias("rate"))


def scope_purity(evidence: DataFrame, allowed: DataFrame) -> DataFrame:
    """One row (pools, pure, rate): the share of pools all of whose scopes their question (query_id, scopes) permits."""
    pools = evidence.groupBy("query_id").agg(F.collect_set("scope").alias("found")).join(allowed, "query_id")
    pure = F.size(F.array_except("found", "scopes")) == 0
    return pools.agg(F.count("*").alias("pools"), F.count_if(pure).alias("pure"), F.round(F.avg(pure.cast("int")), 6).alias("rate"))


def self_agreement(runs: DataFrame) -> DataFrame:
    """One row (repeats, agreement): how many repeats (query_id, run, routed) give what the first of their question gave; null agrees with null."""
    first = runs.groupBy("query_id").agg(F.min_by(F.struct("routed"), "run").alias("f"), F.min("run").alias("run0"))
    later = runs.join(first, "query_id").where(F.col("run") > F.col("run0"))
    return later.agg(F.count("*").alias("repeats"), F.round(F.avg(F.col("routed").eqNullSafe(F.col("f.routed")).cast("int")), 6).alias("agreement"))


def citation_coverage(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """(query_id, valid, paragraphs, cited): is every citation supported, and how many paragraphs carry one."""
    parts = F.filter(F.split("answer", r"\n\s*\n"), lambda p: F.trim(p) != "")
    cited = F.filter(parts, lambda p: F.size(T.cited_locators(p)) > 0)
    j = answers.join(allowed, "query_id", "left")
    bad = T.unsupported(F.col("answer"), F.coalesce("allowed", T.empty_strings()))
    return j.select("query_id", (F.size(bad) == 0).alias("valid"), F.size(parts).alias("paragraphs"), F.size(cited).alias("cited"))


def usd(tokens_in: Column, tokens_out: Column, model: Column, unknown: float | None = None) -> Column:
    """Cost of a call in dollars; a model without a price costs ``unknown``: null where that would be a guess, 0 where sums must go on."""
    price = F.coalesce(*(F.when(model == m, (tokens_in * i + tokens_out * o) / 1_000_000) for m, (i, o) in X.CHAT_RATES.items()))
    return price if unknown is None else F.coalesce(price, F.lit(unknown))


def generation_estimate(cases: DataFrame, runs: int, model: str) -> DataFrame:
    """(query_id, usd) ahead of spending, for cases (query_id, prompt_tokens, auto): every run may be written twice, and a case that is not forced is routed first."""
    rate_in, rate_out = X.CHAT_RATES[model]
    written = (F.col("prompt_tokens") * rate_in + X.EST_OUTPUT_TOKENS * rate_out) * X.RETRY_FACTOR * runs
    routed = F.when(F.col("auto"), X.ROUTER_TOKENS_IN * rate_in + X.ROUTER_TOKENS_OUT * rate_out).otherwise(0.0)
    return cases.select("query_id", ((written + routed) / 1_000_000).alias("usd"))


def measurements(per_run: DataFrame) -> DataFrame:
    """(name, value, sd, n, unit, basis) from runs (name, value, unit, basis); the sample's deviation is null for one run, and no basis is an error."""
    told = F.when(F.trim(F.coalesce("basis", F.lit(""))) != "", F.col("basis")).otherwise(F.raise_error(F.concat(F.lit("no basis for "), "name")))
    return per_run.withColumn("basis", told).groupBy("name", "unit", "basis").agg(F.avg("value").alias("value"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))


def rendered(value: Column, sd: Column, n: Column, unit: Column) -> Column:
    """A measurement as text: dollars with six places, seconds with three, ratios with four; the deviation, or that there is one run."""

    def shown(x: Column) -> Column:
        return F.when(unit == "usd", F.format_string("$%.6f", x)).when(unit == "s", F.format_string("%.3f s", x)).otherwise(F.format_string("%.4f", x))

    spread = F.when(n < 2, " (n=1)").otherwise(F.concat(F.lit(" ± "), shown(sd)))
    return F.when(value.isNull(), "not measured").otherwise(F.concat(shown(value), F.coalesce(spread, F.lit(""))))


def probe(runs: DataFrame) -> DataFrame:
    """(case_id, same_set, same_ranks, same_order): does every repeat (case_id, run, chunk_id, rank, place) give what the first gave?"""
    held = runs.groupBy("case_id", "run").agg(
        F.array_sort(F.collect_set("chunk_id")).alias("ids"),
        F.sort_array(F.collect_list(F.struct("chunk_id", "rank"))).alias("ranks"),
        F.sort_array(F.collect_list(F.struct("place", "chunk_id")))["chunk_id"].alias("order"),
    )
    first = held.groupBy("case_id").agg(F.min_by(F.struct("ids", "ranks", "order"), "run").alias("f"))
    j = held.join(first, "case_id").groupBy("case_id")
    return j.agg(*(F.bool_and(F.col(c) == F.col(f"f.{c}")).alias(name) for c, name in (("ids", "same_set"), ("ranks", "same_ranks"), ("order", "same_order"))))


def verdict(results: DataFrame, *keys: str) -> DataFrame:
    """(keys..., passed, failed, known_fail, errors, exit_code) of results (assertion, passed, known, error, and the keys); without keys one row.

    2 if a case could not be run, else 1 if an assertion that must hold does
    not in every run, else 0; a failure that is known is confirmed by any run.
    """
    per = results.groupBy("case_id", *{"assertion", *keys}).agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("ok"), F.bool_or("known").alias("known"), F.bool_or(F.col("error").isNotNull()).alias("broken"))
    n = per.groupBy(*keys).agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok") & ~F.col("known") & ~F.col("broken")).alias("failed"), F.count_if(~F.col("ok") & F.col("known") & ~F.col("broken")).alias("known_fail"), F.count_if("broken").alias("errors"))
    return n.withColumn("exit_code", F.when(F.col("errors") > 0, 2).when(F.col("failed") > 0, 1).otherwise(0))
