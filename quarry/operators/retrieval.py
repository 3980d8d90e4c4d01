"""Scoped retrieval: dense top-k over pools, rank fusion, authority order.

A pool is what a question may see: the shared books (global rulebook and its
amendments) and, where it names a game, that game's book.  BM25 is in
:mod:`quarry.operators.lexical`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import fixed as X
from quarry.sources import store

#: Question vectors compared at once; more are taken slice by slice.
SLICE = 4096


def matches_filter(row: dict[str, Column], where: dict) -> Column:
    """A filter document as a Column: ``$or`` and ``$and`` win over their siblings; ``$in`` and equality otherwise."""
    if "$or" in where:
        out = F.lit(False)
        for w in where["$or"]:
            out = out | matches_filter(row, w)
        return out
    if "$and" in where:
        out = F.lit(True)
        for w in where["$and"]:
            out = out & matches_filter(row, w)
        return out
    out = F.lit(True)
    for key, want in where.items():
        have = row.get(key, F.lit(None))
        out = out & (have.isin(*want["$in"]) if isinstance(want, dict) else have.eqNullSafe(F.lit(want)))
    return F.coalesce(out, F.lit(False))


def scope_filter(game: str | None) -> dict:
    """The filter document of a question's pool."""
    if game is None:
        return {"scope": {"$in": ["global", "amendment"]}}
    return {"$or": [{"game": game}, {"scope": "global"}, {"$and": [{"scope": "amendment"}, {"game": "global"}]}]}


_NEAR = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("distance", pa.float64())])


def _near(ids: np.ndarray, vectors: np.ndarray, games: np.ndarray, k: int):
    """The ``k`` nearest of each batch for every question vector; the caller keeps the best of all batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, part = batch.column("chunk_id").to_numpy(), np.array(batch.column("part").to_pylist())
            x = np.stack([np.asarray(v, dtype=np.float64) for v in batch.column("embedding").to_pylist()]) if batch.num_rows else np.zeros((0, vectors.shape[1]))
            if not len(x):
                continue
            out = []
            for lo in range(0, len(ids), 256):
                q = vectors[lo : lo + 256]
                d = np.sqrt(np.maximum(((q[:, None, :] - x[None]) ** 2).sum(axis=2), 0.0)) if len(x) <= 64 else _distances(q, x)
                d[(part[None] != "") & (part[None] != games[lo : lo + 256, None])] = np.inf
                for i, row in enumerate(np.round(d, 6)):
                    order = np.lexsort((chunk, row))[:k]
                    order = order[np.isfinite(row[order])]
                    out.append((np.full(len(order), ids[lo + i]), chunk[order], row[order]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_NEAR)

    return run


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - v) ** 2).sum(axis=1)) for v in q])


def dense(vectors: DataFrame, asked: DataFrame, k: int = X.DENSE_K, slice_size: int = SLICE) -> DataFrame:
    """(query_id, chunk_id, dense_rank, distance): the exact ``k`` nearest chunks by Euclidean distance.

    ``vectors``: (chunk_id, part, embedding); ``asked``: (query_id, game, embedding).
    Question vectors are broadcast ``slice_size`` at a time against all rows;
    each batch keeps its own ``k`` best, so what is shuffled is k rows a batch.
    """
    n = asked.count()
    found = None
    for s in range(max(1, -(-n // slice_size))):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // slice_size)))) == s).orderBy("query_id").collect()
        if not rows:
            continue
        ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
        games = np.array([r["game"] or "" for r in rows])
        near = vectors.select("chunk_id", "part", "embedding").mapInArrow(_near(ids, np.array([r["embedding"] for r in rows], dtype=np.float64), games, k), "query_id long, chunk_id long, distance double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return asked.sparkSession.createDataFrame([], "query_id long, chunk_id long, distance double, dense_rank int")
    best = W.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.withColumn("dense_rank", F.row_number().over(best)).where(F.col("dense_rank") <= k)


def rrf(rankings: list[DataFrame], k: int = X.RRF_K) -> DataFrame:
    """(query_id, chunk_id, score, rel_rank) from rankings of (query_id, chunk_id, rank): the sum of 1 / (k + rank)."""
    both = rankings[0]
    for r in rankings[1:]:
        both = both.unionByName(r)
    fused = both.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return fused.withColumn("rel_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def hybrid(lexical: DataFrame, near: DataFrame, chunks: DataFrame, k: int = X.FUSED_K) -> DataFrame:
    """The fused top ``k`` with two orders that never mix: ``rel_rank`` by relevance, ``read_pos`` by authority."""
    fused = rrf([lexical.select("query_id", "chunk_id", F.col("lex_rank").alias("rank")), near.select("query_id", "chunk_id", F.col("dense_rank").alias("rank"))]).where(F.col("rel_rank") <= k)
    # Written, its size is known before the join, so that few rows are sent to the texts and not the texts to them.
    fused = store.written(fused, "fused")
    held = fused.join(chunks, "chunk_id")
    return held.withColumn("read_pos", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("authority"), "rel_rank")))
