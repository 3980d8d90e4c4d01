"""Best-fit packing of token pieces into sequences, certified by bounds.

Each partition packs its pieces by best-fit decreasing and computes a lower
bound on its bins from dual-feasible functions.  A partition whose bins equal
its bound is settled.  The others keep their well-filled bins and give up the
documents in the rest, which are dealt out to fewer partitions and packed again,
until all are settled or a round leaves as many as it found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import Rows, text_chunks
from quarry.llm.scratch import materialise
from quarry.llm.tokens import KNOWN, encoder

CAPACITY, END_ID = 1024, 2
#: Pieces that one task packs about.
PER_TASK = 100_000

_PIECES = pa.schema([("doc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])


def _cut(tokenizer: str, capacity: int, end_id: int, known: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = encoder(tokenizer, known).encode, Rows(_PIECES)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc")
            for first, texts in text_chunks(batch):
                doc, piece, start, length, crc = [], [], [], [], []
                for i, b in enumerate(texts, first):
                    packed = encode(b.decode()) + end
                    n = len(packed) // 4
                    at = 0
                    for k in range(-(-n // capacity)):
                        size = n - (-(-n // capacity) - 1) * capacity if k == 0 else capacity
                        doc.append(ids[i].as_py())
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(packed[4 * at : 4 * (at + size)]))
                        at += size
                yield from out.add(doc, piece, start, length, crc)
        yield from out.rest()

    return run


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, known: int = KNOWN) -> DataFrame:
    """(doc, piece, start, length, crc): each document's ids and ``end_id``, cut only if longer than ``capacity``; the first piece is the short one."""
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return d.mapInArrow(_cut(tokenizer, capacity, end_id, known), "doc long, piece int, start long, length long, crc long")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing of ``counts[l]`` pieces of length ``l`` needs, by two families of dual-feasible functions."""
    length = np.arange(len(counts), dtype=np.int64)
    counts = counts.astype(np.int64)
    best = -(-int((length * counts).sum()) // capacity)
    # Martello and Toth: pieces above capacity - t fill a bin, pieces below t count for nothing.
    above, area = np.cumsum(counts[::-1])[::-1], np.concatenate([[0], np.cumsum(length * counts)])
    for t in range(1, capacity // 2 + 1):
        big = int(above[capacity - t + 1]) if capacity - t + 1 < len(counts) else 0
        middle = int(area[capacity - t + 1] - area[t])
        best = max(best, big + -(-middle // capacity))
    # Fekete and Schepers: u_k rounds (k + 1) x down to k-ths unless it is whole.
    for k in range(1, 21):
        scaled = (k + 1) * length
        value = np.where(scaled % capacity == 0, length * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, offset in it, fill of each bin); ties go to the piece that comes first and the bin opened last."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, opened = 0, 0  # bit f of ``some``: a bin has f free
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            k = free[f].pop()
            if not free[f]:
                some ^= 1 << f
        else:
            k, f = opened, capacity
            opened += 1
        bins[i], offsets[i] = k, capacity - f
        if f > n:
            free[f - n].append(k)
            some |= 1 << (f - n)
    return bins, offsets, np.bincount(bins, weights=lengths, minlength=opened).astype(np.int64)


_COLUMNS = ["doc", "piece", "start", "length", "crc"]
_PACKED = "doc long, piece int, start long, length long, crc long, sequence_id long, offset long, settled boolean"


def _pack(capacity: int, round_no: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc", "piece", "start", "length", "crc"], kind="stable")
        n = pdf.length.to_numpy()
        bins, offsets, fill = best_fit_decreasing(n, capacity)
        gap = len(fill) - lower_bound(np.bincount(n, minlength=capacity + 1), capacity)
        settled = np.ones(len(fill), dtype=bool)
        if gap > 0 and not last:
            # The emptiest bins, and as many again of the next best, so that the exchange has something to fit together.
            settled[np.argsort(fill, kind="stable")[: max(16, 8 * gap)]] = False
        out = pdf[_COLUMNS].copy()
        out["sequence_id"] = (round_no << 56) | (int(key[0]) << 28) | bins
        out["offset"] = offsets
        out["settled"] = settled[bins]
        return out

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, per_task: int = PER_TASK) -> DataFrame:
    """``cut`` (a written table, see :func:`pieces`) with sequence_id and offset: every piece once, sequences gapless and at most ``capacity`` long."""
    left, done, before = cut, None, None
    n, r = left.count(), 0
    while True:
        parts = max(1, -(-n // per_task))
        last = before is not None and (n >= before or (parts == 1 and r > 1))
        # Rows are dealt out one by one, by their place in the table: equal ones, or all of one id, meet in no task.
        dealt = left.select(*_COLUMNS, F.monotonically_increasing_id().alias("place")).withColumn("part", F.pmod(F.xxhash64("place", F.lit(r)), F.lit(parts)))
        packed = materialise(dealt.select(*_COLUMNS, "part").groupBy("part").applyInPandas(_pack(capacity, r, last), _PACKED), "packed")
        kept = packed.where("settled").drop("settled")
        done = kept if done is None else done.unionByName(kept)
        left = packed.where("not settled").select(*_COLUMNS)
        before, n, r = n, left.count(), r + 1
        if n == 0:
            return done


def corpus_bound(cut: DataFrame, capacity: int = CAPACITY) -> int:
    """The lower bound over all pieces; its histogram has ``capacity`` rows at most."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in cut.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return lower_bound(counts, capacity)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences used, lower bound on the sequences of any packing of all the pieces); their difference is the gap left open."""
    return packed.select("sequence_id").distinct().count(), corpus_bound(packed, capacity)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, known: int = KNOWN) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    ``known``: words of each kind whose ids a worker remembers; a matter of memory, not of results.

    Null and empty texts are one piece with the end id alone.  Rows with a null
    id and rows that share an id are packed like any other, one by one.
    """
    cut = materialise(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, known), "pieces")
    return pack(cut, capacity).select(F.col("doc").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
