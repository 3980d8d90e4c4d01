"""Document fingerprints: one-permutation MinHash in DataFrame functions alone.

A text's word shingles are hashed once; the high bits of a hash choose a bin and
each bin keeps its smallest hash.  An empty bin takes the hash of the first bin
that is not empty along a probe sequence of its own (optimal densification).
Stored are the low ``LOW`` bits of each bin's hash, packed; two unequal hashes
agree in them once in ``2**LOW``, which the likeness corrects for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHINGLE = 5
BINS, LOW, PROBES = 256, 8, 8
_REST = 64 - (BINS - 1).bit_length()
_MASK = (1 << _REST) - 1
_WORDS = BINS * LOW // 64
#: Buckets of neighbouring ids; each is one (id, bucket) row of a broadcast, 32 MB at most.
MOST_BUCKETS = 1 << 20
COARSE = 64
#: The greatest id.
LONGEST = (1 << 63) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _probe(i: int, attempt: int) -> int:
    x = (i * PROBES + attempt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return (x ^ x >> 32) % BINS


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of the ``size``-word shingles; fewer words make one shingle, none make none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))

    def of(h: Column) -> Column:
        rolled = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))
        return F.when(F.size(h) >= size, rolled).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """Packed fingerprint: an array of longs, all zero for a text without words."""
    # A sentinel per bin, its largest value, makes the sorted hashes hold every bin.
    sentinels = _longs([_signed(b << _REST | _MASK) for b in range(BINS)])
    # Signed order: the bins with the high bit set come first.
    probes = [_longs([_probe(i, a) for i in range(BINS)]) for a in range(PROBES)]

    def held(x: Column) -> Column:
        return F.when(x.bitwiseAND(F.lit(_MASK)) != F.lit(_MASK), x)

    def smallest(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftrightunsigned(x, _REST) != F.shiftrightunsigned(F.get(s, i - 1), _REST)))

    def densified(m: Column) -> Column:
        def fill(i: Column) -> Column:
            # When all probes fail few bins are held: of those, the first in an order that the bin chooses.
            order = F.array_min(F.transform(F.filter(m, lambda x: x.bitwiseAND(F.lit(_MASK)) != F.lit(_MASK)), lambda x: F.struct(F.xxhash64(i, F.shiftrightunsigned(x, _REST)).alias("o"), x.alias("x"))))
            got = F.coalesce(held(F.get(m, i)), *(held(F.get(m, F.get(p, i).cast("int"))) for p in probes), order["x"])
            return F.xxhash64(got, i).bitwiseAND(F.lit((1 << LOW) - 1))

        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), fill)

    def packed(v: Column) -> Column:
        per = 64 // LOW
        return F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda g: F.aggregate(F.slice(v, g * per + 1, F.lit(per)), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, LOW).bitwiseOR(x)))

    def of(h: Column) -> Column:
        full = let(let(let(F.sort_array(F.concat(h, sentinels)), smallest), densified), packed)
        return F.when(F.size(h) == 0, _longs([0] * _WORDS)).otherwise(full)

    return let(shingle_hashes(text, size), of)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two packed fingerprints, 0 to 1; two without words are alike, one is unlike any other."""
    zero = _longs([0] * _WORDS)
    lanes = F.lit(int("01" * 8, 16))

    def differing(x: Column, y: Column) -> Column:
        """Lanes of a word that differ: fold each byte's bits onto its lowest."""
        d = x.bitwiseXOR(y)
        for by, mask in ((4, "0f"), (2, "03"), (1, "01")):
            d = d.bitwiseOR(F.shiftrightunsigned(d, by)).bitwiseAND(F.lit(int(mask * 8, 16)))
        return F.bit_count(d.bitwiseAND(lanes))

    unlike = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, x: acc + x)
    chance = 2.0**-LOW
    estimate = F.greatest(F.lit(0.0), ((BINS - unlike) / BINS - chance) / (1 - chance))
    return F.when((a == zero) | (b == zero), (a == b).cast("double")).otherwise(estimate)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def with_next(rows: DataFrame, carried: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """``carried(rows)`` with ``next_<column>`` of the next ``doc``, in ascending order; the first follows the last.

    Ids are dealt into buckets of neighbours, so no task sees the whole order;
    the first row of a bucket is also sent to the bucket before it.  Rows
    without an id have no next row and stay where they are.
    """
    told = rows.where("doc is not null")
    probs = [k / COARSE for k in range(COARSE + 1)]
    cuts = sorted({min(max(int(x), -LONGEST - 1), LONGEST) for x in told.approxQuantile("doc", probs, 0.001)})
    fine = max(1, min(4 * rows.rdd.getNumPartitions(), MOST_BUCKETS) // COARSE + 1)
    if len(cuts) < 2:
        low = min(cuts[0], LONGEST - 1) if cuts else 0
        cuts = [low, low + 1]
    bounds = _longs(cuts)
    place = F.least(F.greatest(F.size(F.filter(bounds, lambda c: c <= F.col("doc"))) - 1, F.lit(0)), F.lit(len(cuts) - 2))
    low, high = F.get(bounds, F.col("place")), F.get(bounds, F.col("place") + 1)
    # In doubles, as a difference of longs may be none; rounding keeps the order, so neighbours stay neighbours.
    at, low, high = (x.cast("double") for x in (F.col("doc"), low, high))
    inner = F.least(F.greatest((at - low) * fine / F.greatest(high - low, F.lit(1.0)), F.lit(0.0)), F.lit(fine - 1.0)).cast("long")
    bucketed = told.withColumn("place", place).withColumn("bucket", F.col("place").cast("long") * fine + inner).drop("place")

    # The buckets in order, as one array: 16 bytes each and ``MOST_BUCKETS`` at most.
    firsts = bucketed.groupBy("bucket").agg(F.min("doc").alias("first")).agg(F.sort_array(F.collect_list(F.struct("bucket", "first"))).alias("b"))
    before = F.transform("b", lambda x, i: F.struct(x["first"].alias("first"), F.get(F.col("b"), F.when(i > 0, i - 1).otherwise(F.size("b") - 1))["bucket"].alias("prior")))
    firsts = firsts.select(F.explode(before).alias("x")).select("x.*")
    both = bucketed.join(F.broadcast(firsts), bucketed["doc"] == firsts["first"], "left")
    copies = F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("ghost")), F.when(F.col("prior").isNotNull(), F.struct(F.col("prior").alias("bucket"), F.lit(True).alias("ghost")))))
    spread = carried(both.withColumn("to", F.explode(copies)).select("doc", "text", F.col("to.bucket").alias("bucket"), F.col("to.ghost").alias("ghost")))
    near = W.partitionBy("bucket").orderBy("ghost", "doc", "text")
    linked = spread.withColumns({f"next_{c}": F.lead(c).over(near) for c in columns}).where("not ghost").drop("bucket", "ghost")
    alone = carried(rows.where("doc is null").select("doc", "text"))
    return linked.unionByName(alone.select("*", *(F.lit(None).cast(alone.schema[c].dataType).alias(f"next_{c}") for c in columns)))


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Each row's fingerprint, its edited text's, and their likeness to it and to the next document's.

    The edited text has the last half of the code points (rounded down)
    replaced by as many (or all) from the start of the next document; the first
    document follows the last.  Null texts count as empty.  Rows that share an
    id follow one another by text.  A row with a null id has no next document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    linked = with_next(rows, lambda d: d.withColumn("fp", fingerprint(F.col("text"), size)), ["text", "fp"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.coalesce(F.substring("next_text", F.lit(1), half), F.lit("")))
    linked = linked.select("doc", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", F.coalesce("next_fp", _longs([0] * _WORDS)).alias("next_fp"))
    done = linked.select("doc", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "next_fp", fingerprint(F.col("edited"), size).alias("edited_fp"))
    return done.select(
        F.col("doc").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
