"""Repeated fixed-length windows of words over a corpus, without shuffling a row per window.

Every window of ``width`` words is hashed (Rabin-Karp).  A window's *anchor* is
the smallest hash among the half as long grams inside it, so equal windows have
equal anchors.  Consecutive windows of a document with one anchor form a *run*.
Spark counts runs by anchor and drops those whose anchor is in one document
only: none of their windows can recur elsewhere.  Of the rest, runs of equal
content (the hash of the run's words, beside the anchor's and the number of
windows) collapse to the first document, a pre-aggregation, so a passage in a
third of all documents becomes one row per map task.  Only the representatives
of anchors that occur in differing contexts go on.  Of those a sample of
windows, chosen by hash so that equal windows are chosen alike, and the first
and last of each run are compared by two hashes: two that lead to one earlier
document, as far apart there as here, answer for all windows between.  The
other windows are compared one by one.  A document compares each of these
windows once, however often its text repeats it: the others of its places go
with the first.

So the result is exact up to collisions of 128 hash bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import Rows, text_chunks
from quarry.llm.rolling import BASES, Hashes, WordHashes, rolling_min
from quarry.llm.scratch import discard, materialise

#: A span of windows is one long: first start (31 bits) and number of windows (20); the bits between are others' to use.
LENGTH = (1 << 20) - 1
MOST = 1 << 19

RUNS = pa.schema([("m", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("span", pa.int64())])


def heads(*changing: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.zeros(len(changing[0]), dtype=bool)
    new[:1] = True
    for x in changing:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _runs(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    gram = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, out = WordHashes(), Rows(RUNS)
        for batch in batches:
            ids, keys = batch.column("doc"), batch.column("key")
            for first, texts in text_chunks(batch):
                parts, held = [], []
                for i, b in enumerate(texts, first):
                    t = memo.of(b.split()) if len(b) >= width and ids[i].is_valid else ()
                    if len(t) >= width:
                        parts.append(t)
                        held.append(i)
                if not parts:
                    continue
                docs, names = (np.array([c[i].as_py() for i in held], dtype=np.int64) for c in (ids, keys))
                x = np.concatenate(parts)
                sizes = np.array([len(t) for t in parts])
                begin = np.cumsum(sizes) - sizes
                # The windows that start in a document and end in it, document by document.
                live = sizes - width + 1
                owner = np.repeat(np.arange(len(parts)), live)
                start = np.arange(live.sum()) - np.repeat(np.cumsum(live) - live, live) + begin[owner]
                local = start - begin[owner]
                m = rolling_min(Hashes(x, BASES[0]).every(gram), width - gram + 1)[start]
                head = heads(owner, m, local // MOST)
                n = np.diff(np.append(head, len(m)))
                ctx = Hashes(x, BASES[1]).at(start[head], n + (width - 1))
                yield from out.add(m[head].view(np.int64), ctx.view(np.int64), docs[owner[head]], names[owner[head]], local[head] << 32 | n)
        yield from out.rest()

    return run


_OPEN = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("lo", pa.int64()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64())), ("also", pa.list_(pa.int64()))])
_OPEN_DDL = "doc long, key long, lo long, h1 array<long>, h2 array<long>, also array<long>"
#: One in so many windows is in the sample; windows of a run that are one row (at most ``width``, so that its first and last leave no word between them); other places of its windows that one row holds.
EVERY, PIECE, PLACES = 4, 48, 512


def _first_equal(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Per window the first window that is equal to it."""
    order = np.lexsort((h2, h1))
    head = heads(h1[order], h2[order])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.repeat(order[head], np.diff(np.append(head, len(order))))
    return out


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))


def _hashed(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The runs in ``expand`` with two hashes of each of their windows; ``also``: where else in the document a window is, over its number in the row."""
    size = min(PIECE, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, out = WordHashes(), Rows(_OPEN, 5_000)
        for batch in batches:
            ids, keys, spans = batch.column("doc"), batch.column("key"), batch.column("expand")
            for first, texts in text_chunks(batch):
                for i, b in enumerate(texts, first):
                    s, t = np.sort(spans[i].values.to_numpy()), memo.of(b.split())
                    lo, n = s >> 32, s & LENGTH
                    pos = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    h = [Hashes(t, base).at(pos, width).view(np.int64) for base in BASES]
                    equal = _first_equal(*h)
                    kept, again = (np.flatnonzero(x) for x in (equal == np.arange(len(pos)), equal != np.arange(len(pos))))
                    # Rows of consecutive windows of one run.
                    part = heads(np.repeat(np.arange(len(n)), n)[kept], pos[kept] - np.arange(len(kept)))
                    nth = np.arange(len(kept)) - np.repeat(part, np.diff(np.append(part, len(kept))))
                    head = np.flatnonzero(nth % size == 0)
                    sizes = np.diff(np.append(head, len(kept)))
                    # A row with very many other places comes several times, each time with some of them.
                    w = np.searchsorted(kept, equal[again])
                    row = np.searchsorted(head, w, "right") - 1
                    order = np.argsort(row, kind="stable")
                    also, many = (pos[again] << 32 | w - head[row])[order], np.bincount(row, minlength=len(head))
                    times = np.maximum(-(-many // PLACES), 1)
                    take = np.repeat(np.arange(len(head)), times)
                    turn = np.arange(len(take)) - np.repeat(np.cumsum(times) - times, times)
                    some = np.clip(many[take] - turn * PLACES, 0, PLACES)
                    lists = [_lists(x[kept], sizes).take(pa.array(take)) for x in h]
                    yield from out.add(np.full(len(take), ids[i].as_py()), np.full(len(take), keys[i].as_py()), pos[kept[head]][take], *lists, _lists(also, some))
        yield from out.rest()

    return run


_LEFT = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("spans", pa.list_(pa.int64())), ("h1", pa.int64()), ("h2", pa.int64())])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of windows that the ``names`` (i, doc, key, pos) of compared ones answer for (no hashes), and the windows that are left, one by one with all their places.

    A stretch between two compared windows that are not both found, or not
    together, is left with its ends.
    """
    out = Rows(_LEFT)
    for batch in batches:
        for doc, key, lo, h1, h2, also, names in zip(*(batch.column(c) for c in ("doc", "key", "lo", "h1", "h2", "also", "names")), strict=True):
            lo, a, b, also = lo.as_py(), h1.values.to_numpy(), h2.values.to_numpy(), also.values.to_numpy()
            n = len(a)
            found = {x["i"]: (x["d"], x["k"], x["p"] - x["i"]) for x in names.as_py() or ()}
            known = np.unique(np.concatenate([[0, n - 1], np.flatnonzero(a % EVERY == 0)])).tolist()
            gone, left = [], np.zeros(n, dtype=bool)
            for i, j in zip(known, known[1:] or known, strict=len(known) == 1):
                if i in found and found[i] == found.get(j):
                    gone.append(lo + i << 32 | j - i + 1)
                else:
                    left[i : j + 1] = True
            at, where, elsewhere = np.flatnonzero(left), also & LENGTH, also >> 32 << 32 | 1
            gone = np.concatenate([np.array(gone, dtype=np.int64), elsewhere[~left[where]]])
            whose = np.concatenate([np.arange(len(at)), np.searchsorted(at, where[left[where]])])
            places = np.concatenate([lo + at << 32 | 1, elsewhere[left[where]]])[np.argsort(whose, kind="stable")]
            sizes, none = np.bincount(whose, minlength=len(at)), [None] * bool(len(gone))
            spans = _lists(np.concatenate([gone, places]), np.concatenate([[len(gone)] * len(none), sizes]))
            yield from out.add(np.full(len(spans), doc.as_py()), np.full(len(spans), key.as_py()), spans, none + a[at].tolist(), none + b[at].tolist())
    yield from out.rest()


def fresh(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows under keys that Spark deals out anew, so that a join may split a hot key's partition (AQE)."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})


def removal_spans(docs: DataFrame, width: int) -> DataFrame:
    """(doc, key, spans): per document the spans (see ``LENGTH``) of windows that a document with a smaller id has too.

    ``docs`` has ``doc`` (long), ``key`` (long, tells apart the texts of one id) and ``text``, and may have more.
    """
    d = docs.select("doc", "key", "text")
    runs = materialise(d.mapInArrow(_runs(width), "m long, ctx long, doc long, key long, span long"), "repeats-all")
    known = runs.groupBy("m").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 < d1").select("m")
    live = materialise(runs.join(fresh(known, "m").hint("shuffle_hash"), "m").withColumn("n", F.col("span").bitwiseAND(F.lit(LENGTH))), "repeats-runs")
    discard(runs)
    contexts = materialise(live.groupBy("m", "ctx", "n").agg(F.min("doc").alias("first")), "repeats-contexts")
    several = contexts.groupBy("m").agg(F.count("*").alias("k")).where("k > 1").select("m")
    judged = contexts.join(fresh(several, "m").withColumn("open", F.lit(True)).hint("shuffle_hash"), "m", "left")
    told = live.join(judged.hint("shuffle_hash"), ["m", "ctx", "n"]).where("doc > first or open").select("doc", "key", "span", F.expr("doc > first").alias("gone"))
    spans = told.groupBy("doc", "key").agg(F.collect_set(F.when(F.col("gone"), F.col("span"))).alias("whole"), F.collect_set(F.when(~F.col("gone"), F.col("span"))).alias("expand"))
    found = materialise(spans, "repeats-spans")
    discard(live, contexts)
    open_ = d.join(found.where(F.size("expand") > 0).select("doc", "key", "expand"), ["doc", "key"])
    hashed = materialise(open_.mapInArrow(_hashed(width), _OPEN_DDL), "repeats-open")

    def earliest(windows: DataFrame) -> DataFrame:
        """The windows (doc, key, pos, h1, h2, ...) that an earlier document has too, with ``name``, the first."""
        first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "key", "pos")).alias("name"), F.max("doc").alias("last")).where("name.doc < last").drop("last")
        return windows.join(fresh(first, "h1", "h2"), ["h1", "h2"]).where("doc > name.doc")

    each = hashed.select("doc", "key", "lo", F.size("h1").alias("n"), F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "h")).select("doc", "key", "lo", "n", "i", "h.h1", "h.h2")
    some = each.where((F.col("h1") % EVERY == 0) | F.col("i").isin(0) | (F.col("i") == F.col("n") - 1)).drop("n").withColumn("pos", F.col("lo") + F.col("i"))
    names = earliest(some).groupBy("doc", "key", "lo").agg(F.collect_list(F.struct("i", F.col("name.doc").alias("d"), F.col("name.key").alias("k"), F.col("name.pos").alias("p"))).alias("names"))
    told = materialise(hashed.join(names, ["doc", "key", "lo"], "left").mapInArrow(_settled, "doc long, key long, spans array<long>, h1 long, h2 long"), "repeats-told")
    discard(hashed)
    one_by_one = earliest(told.where("h1 is not null").withColumn("pos", F.shiftright(F.element_at("spans", 1), 32)))
    hits = told.where("h1 is null").select("doc", "key", "spans").unionByName(one_by_one.select("doc", "key", "spans"))
    whole = found.where(F.size("whole") > 0).select("doc", "key", F.col("whole").alias("spans"))
    return whole.unionByName(hits).groupBy("doc", "key").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def covered(spans: np.ndarray, size: int, width: int) -> np.ndarray:
    """Which of ``size`` tokens some span's windows cover."""
    s = np.asarray(spans, dtype=np.int64)
    lo = np.minimum(s >> 32, size)
    hi = np.minimum((s >> 32) + (s & LENGTH) + width - 1, size)
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0
