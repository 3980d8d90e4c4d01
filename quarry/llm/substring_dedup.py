"""Substring dedup: windows of words that an earlier document has too are cut out.

Rabin-Karp hashes of ``width``-word windows, counted in Spark; the repeated
windows of a document merge into maximal removal intervals.  Most windows are
counted run by run (see :mod:`quarry.llm.repeats`), the others one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import Rows, text_chunks
from quarry.llm.repeats import covered, removal_spans

WIDTH = 50


def _cut(width: int, carried: int, rejoin: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if out is None:
                new = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]
                out = Rows(pa.schema([*(batch.schema.field(k) for k in range(1 + carried)), *(pa.field(*x) for x in new)]), 2_000)
            spans = batch.column("spans")
            for first, texts in text_chunks(batch):
                n_words, removed, kept = [], [], []
                for i, b in enumerate(texts, first):
                    words, gone = b.split(), 0
                    n_words.append(len(words))
                    if spans[i].is_valid and words:
                        mask = covered(spans[i].values.to_numpy(), len(words), width)
                        gone = int(mask.sum())
                        words = list(compress(words, ~mask))
                    removed.append(gone)
                    kept.append(b" ".join(words) if gone or rejoin else b)
                as_they_are = (batch.column(k).slice(first, len(texts)) for k in range(1 + carried))
                yield from out.add(*as_they_are, n_words, removed, pa.array(kept, pa.binary()).cast(pa.string()))
        if out is not None:
            yield from out.rest()

    return run


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, carry: list[str] | None = None, rejoin: bool = True) -> DataFrame:
    """(id, ``carry``..., n_words, n_removed, kept_text) for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word goes if a window over it also
    starts in a document with a smaller id; windows are judged on the input.
    Null and empty texts, and texts shorter than a window, keep all they have.
    A row with a null id takes part in no comparison.  Rows that share an id are
    not compared with each other, each with the rows of smaller ids.
    ``kept_text`` is the kept words joined by one space; without ``rejoin`` a
    text that loses nothing stays as it is (null: empty).
    """
    extra = {f"c{k}": c for k, c in enumerate(carry or [])}
    d = docs.select(F.col(id_col).cast("long").alias("doc"), *(F.col(c).alias(k) for k, c in extra.items()), F.col(text_col).alias("text"))
    keyed = d.withColumn("key", F.xxhash64("text"))
    spans = removal_spans(keyed, width)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in d.schema.fields[:-1])
    cut = keyed.join(spans.hint("shuffle_hash"), ["doc", "key"], "left").select(*d.columns, "spans").mapInArrow(_cut(width, len(extra), rejoin), kinds + "n_words long, n_removed long, kept_text string")
    return cut.withColumnsRenamed({"doc": id_col} | extra)
