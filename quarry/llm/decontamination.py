"""Benchmark decontamination: which windows of benchmark items occur in documents.

A set join with prefix filtering.  An item's windows of ``width`` words must
occur whole, so of the words of a window, ordered by how rare they are in the
corpus, the first alone is a sufficient prefix: only documents that hold it are
candidates.  Where it is in the window and in the document bounds the window's
place, whose words are then compared one by one.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import Rows, text_chunks
from quarry.llm.scratch import materialise

WIDTH = 10
#: Windows that are broadcast at once; a larger benchmark is joined slice by slice.
PER_SLICE = 200_000
#: Words are of digits, ASCII letters and whatever is not ASCII, in lower case.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


_WINDOWS = pa.schema([("item", pa.int64()), ("window", pa.binary())])


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_WINDOWS)
        for batch in batches:
            ids = batch.column("item")
            for first, texts in text_chunks(batch):
                for i, b in enumerate(texts, first):
                    words = words_of(b)
                    found = {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
                    yield from out.add([ids[i].as_py()] * len(found), sorted(found))
        yield from out.rest()

    return run


_COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen = shared.value, Counter()
        for batch in batches:
            for _, texts in text_chunks(batch):
                for b in texts:
                    seen.update(filter(vocabulary.__contains__, words_of(b)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=_COUNTS)

    return run


def _index(rows: list[tuple[int, bytes]], counts: dict[bytes, int]) -> dict[bytes, dict[tuple[int, int], dict[bytes, list[int]]]]:
    """Rarest word of a window -> (its place, words in the window) -> window -> items."""
    index: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for item, window in rows:
        words = window.split(b" ")
        at = min(range(len(words)), key=lambda k: (counts.get(words[k], 0), words[k], k))
        if all(counts.get(w, 0) for w in words):  # a word no document has: nor the window
            index[words[at]][at, len(words)][window].append(item)
    return {w: {p: dict(x) for p, x in places.items()} for w, places in index.items()}


_HITS = [pa.field("text_hash", pa.int64()), pa.field("n_words", pa.int64()), pa.field("hits", pa.list_(pa.int32())), pa.field("items", pa.list_(pa.int64()))]


def _find(shared, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, out = shared.value, None
        for batch in batches:
            kept = [k for k, name in enumerate(batch.schema.names) if name != "__text"]
            out = out or Rows(pa.schema([*(batch.schema.field(k) for k in kept), *_HITS]), 2_000)
            for first, texts in text_chunks(batch, column):
                n_words, hits, items = [], [], []
                hashes = np.array([xxhash.xxh64_intdigest(b) for b in texts], dtype=np.uint64).view(np.int64)
                for b in texts:
                    words = words_of(b)
                    mask, found = None, set()
                    for k in [k for k, w in enumerate(words) if w in index]:
                        for (place, width), windows in index[words[k]].items():
                            lo = k - place
                            if lo < 0 or lo + width > len(words):
                                continue
                            owners = windows.get(b" ".join(words[lo : lo + width]))
                            if owners:
                                if mask is None:
                                    mask = np.zeros(len(words), dtype=bool)
                                mask[lo : lo + width] = True
                                found.update(owners)
                    n_words.append(len(words))
                    hits.append([] if mask is None else np.flatnonzero(mask))
                    items.append(sorted(x for x in found if x is not None))
                yield from out.add(*(batch.column(k).slice(first, len(texts)) for k in kept), hashes, n_words, hits, items)
        if out is not None:
            yield from out.rest()

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, per_slice: int = PER_SLICE, carry: list[str] | None = None) -> DataFrame:
    """(id or ``carry``..., n_words, n_hit, items) for every row of ``docs``; ``items``: sorted ids of the items with windows in the document.

    Words: A-Z in lower case, then runs of digits, letters a-z and non-ASCII.
    A window is ``width`` consecutive words of an item; an item of fewer words,
    but not none, is one window.  A word is hit if it lies in an occurrence of
    a window.  Null texts have no words; windows of an item with a null id hit
    but name no item; rows of ``docs`` that share an id are judged one by one.
    """
    spark = docs.sparkSession
    keep = {f"c{k}": c for k, c in enumerate(carry or [id_col])}
    own = next((k for k, c in keep.items() if c == text_col), "__text")  # a carried text is read in place
    d = docs.select(*(F.col(c).alias(k) for k, c in keep.items()), *([F.col(text_col).alias("__text")] if own == "__text" else []))
    windows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).mapInArrow(_windows(width), "item long, window binary")
    windows = materialise(windows, "benchmark-windows")
    slices = max(1, -(-windows.count() // per_slice))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in d.schema.fields if f.name != "__text")
    found = []
    for s in range(slices):
        rows = [(r["item"], bytes(r["window"])) for r in windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(slices)) == s).collect()]
        vocabulary = spark.sparkContext.broadcast(frozenset(w for _, x in rows for w in x.split(b" ")))
        counted = d.select(F.col(own).alias("text")).mapInArrow(_count(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        index = _index(rows, {bytes(r["word"]): r["n"] for r in counted})
        found.append(d.mapInArrow(_find(spark.sparkContext.broadcast(index), own), kinds + "text_hash long, n_words long, hits array<int>, items array<long>"))
    out = found[0]
    if slices > 1:
        # The hits of a text in the slices belong together; equal rows are counted and told apart again.
        out = reduce(DataFrame.unionByName, found).groupBy(*keep, "text_hash", "n_words").agg(
            F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            (F.count("*") / slices).cast("int").alias("copies"),
        )
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(*(F.col(k).alias(c) for k, c in keep.items()), "n_words", F.size("hits").cast("long").alias("n_hit"), "items")
