"""Suffix-array dedup over bytes by distributed prefix doubling.

Two positions have equal ranks for a length if the same bytes start at both.
Ranks for a quarter of ``width`` are hashes of the bytes; each round then lets
Spark deal out, group and sort the rank pairs of two positions a growing offset apart (a
quarter, a half), names each pair anew and drops the positions whose pair is
unique.  The last name is the earliest position with the pair, so it is the
answer: a position whose name is in an earlier document goes.

Which positions are ranked: a window of ``width`` bytes has an *anchor*, the
smallest hash of the ``gram``-byte grams in it.  Windows with one anchor place
form a *run*, and runs whose anchor is in one document only are unique from the
start.  For that the anchors of some thousand documents (a *chunk*) are asked
for together: each goes once a chunk, with the first and the last document that
has it there, in a row for all anchors of one hash range (*bucket*), so that
neither a rare anchor costs a row nor a frequent one a large group.  First the ends of the runs are ranked: where both ends of a run lead to
one earlier document, equally far apart, all windows between do.  The other
runs are cut into blocks of fewer and fewer windows; those go that hold a
stretch of bytes which one document alone has, and the ends of the others are
ranked in the same way.  Of what is left in the end every window is ranked.  Repeats inside a document are ranked by the same doubling where its
bytes are (numpy).

Equality rests on four 64-bit hashes of 25 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import CHUNK_BYTES, Rows, text_chunks
from quarry.llm.repeats import LENGTH, MOST, covered, fresh, heads
from quarry.llm.rolling import BASES, BYTE_HASH, Hashes, U, mix, rolling_min
from quarry.llm.scratch import discard, materialise

WIDTH = 100
GRAM = 24
#: Windows of a block, stage by stage, after whole runs.
BLOCKS = (16, 4)
#: Runs of a chunk (more only if one piece of text has more), and of a bucket in the mean.
CHUNK_RUNS, BUCKET_RUNS = 1 << 17, 1 << 18
#: In a span (one long): first start (31 bits), offset of the anchor from it (12), number of windows (20).
PLACE = (1 << 12) - 1

_PLACE_BITS = 20
_HELD = U((1 << _PLACE_BITS) - 1)


def _tokens(b: bytes) -> np.ndarray:
    return BYTE_HASH[np.frombuffer(b, dtype=np.uint8)]


def _leftmost(grams: np.ndarray, reach: int, start: np.ndarray) -> np.ndarray:
    """Per window the place of the leftmost of its smallest grams, by their high bits.

    Places are counted modulo ``2**_PLACE_BITS``.  Where the count starts anew
    inside a window the leftmost would not be the smallest; such windows take
    it from a second count, moved by half the modulus.
    """
    high, where = grams & ~_HELD, np.arange(len(grams), dtype=U)
    if len(grams) <= 1 << _PLACE_BITS:
        high |= where
        return (rolling_min(high, reach)[start] & _HELD).view(np.int64)
    low = rolling_min(high | where & _HELD, reach)[start]
    late = (start & int(_HELD)) + reach > 1 << _PLACE_BITS
    turned = np.where(late, U(1 << _PLACE_BITS - 1), U(0))
    low[late] = rolling_min(high | where + U(1 << _PLACE_BITS - 1) & _HELD, reach)[start[late]]
    return start + ((low - start.astype(U) - turned) & _HELD).view(np.int64)


def _quarters(h: Hashes, pos: np.ndarray, width: int) -> list[np.ndarray]:
    """Ranks of the four quarters of the windows at ``pos``."""
    q = width // 4
    return [h.at(pos + q * k, q) for k in range(4)]


def _pair_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of each pair among the sorted pairs; equal pairs have one rank."""
    order = np.lexsort((b, a))
    new = np.zeros(len(order), dtype=np.int64)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _recurring(start: np.ndarray, head: np.ndarray, owner: np.ndarray, m: np.ndarray, h: Hashes, width: int) -> np.ndarray:
    """Which windows have an equal one earlier in their own document, by doubling; the runs begin at ``head``, have ``owner`` and anchor ``m``.

    Equal windows have equal anchors at unequal places, so only runs whose
    anchor heads several runs of the document are looked into.
    """
    n = np.diff(np.append(head, len(start)))
    order = np.lexsort((m, owner))
    o, a = owner[order], m[order]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (o[1:] == o[:-1]) & (a[1:] == a[:-1])
    same[:-1] |= same[1:]
    run = np.sort(order[same])
    many = n[run]
    at = np.repeat(head[run] - np.cumsum(many) + many, many) + np.arange(many.sum())
    out = np.zeros(len(start), dtype=bool)
    if len(at):
        whose = np.repeat(owner[run], many)
        q = _quarters(h, start[at], width)
        halves = _pair_ranks(np.concatenate([q[0], q[2]]), np.concatenate([q[1], q[3]]))
        rank = _pair_ranks(halves[: len(at)], halves[len(at) :])
        order = np.lexsort((at, rank, whose))
        o, r = whose[order], rank[order]
        again = np.zeros(len(order), dtype=bool)
        again[1:] = (o[1:] == o[:-1]) & (r[1:] == r[:-1])
        out[at[order]] = again
    return out


def _inner(sizes: np.ndarray, width: int) -> np.ndarray:
    """The windows that start in a text and end in it, of texts of ``sizes`` one after another."""
    inside = np.ones(sizes.sum(), dtype=bool)
    for end in np.cumsum(sizes).tolist():
        inside[end - width + 1 : end] = False
    return np.flatnonzero(inside)


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary cells of so many 64-bit values each."""
    offsets = np.append(0, np.cumsum(sizes) * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _longs(cell: pa.Scalar, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), dtype=kind)


def _unpacked(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each value, and the values."""
    parts = [_longs(c) for c in cells]
    return np.repeat(np.arange(len(parts)), [len(x) for x in parts]), np.concatenate(parts)


_OWN = pa.struct([("doc", pa.int64()), ("key", pa.int64()), ("span", pa.int64())])
_CHUNK = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("docs", "keys", "runs", "m", "spans")), ("own", pa.list_(_OWN))])
_CHUNK_DDL = "chunk long, n long, docs binary, keys binary, runs binary, m binary, spans binary, own array<struct<doc:long,key:long,span:long>>"


def _runs(width: int, gram: int, most: int):
    """Runs of windows, a row per chunk of documents: ``docs``, ``keys`` and number of ``runs`` of each document, ``m`` and ``spans`` of each run; ``own``: spans of windows that recur in their own document."""
    reach = width - gram + 1

    def of(parts: list[bytes], docs: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, ...]:
        h = Hashes(_tokens(b"".join(parts)), BASES[0])
        sizes = np.array([len(b) for b in parts])
        begin, start = np.cumsum(sizes) - sizes, _inner(sizes, width)
        grams = h.every(gram)
        # Windows of two documents have no anchor place in common.
        place = _leftmost(grams, reach, start)
        head = heads(place)
        owner = np.searchsorted(begin, start[head], "right") - 1
        gone = _recurring(start, head, owner, grams[place[head]], h, width)
        if gone.any():
            head = heads(place, gone)
            owner = np.searchsorted(begin, start[head], "right") - 1
        live = ~gone[head]
        n = np.diff(np.append(head, len(start)))
        head, owner, n = head[live], owner[live], n[live]
        lo = start[head]
        span = lo - begin[owner] << 32 | place[head] - lo << 20 | n
        again = start[gone]
        first = heads(again - np.arange(len(again)), again // MOST)
        whose = np.searchsorted(begin, again[first], "right") - 1
        own = again[first] - begin[whose] << 32 | np.diff(np.append(first, len(again)))
        # Minima are small; mixed, they are spread over all values.
        return docs, names, np.bincount(owner, minlength=len(parts)), mix(grams[place[head]]), span, docs[whose], names[whose], own

    def row(chunk: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        *packed, doc, key, span = (np.concatenate(x) for x in zip(*held, strict=True))
        own = pa.ListArray.from_arrays(pa.array([0, len(span)], pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (doc, key, span)], fields=list(_OWN)))
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([len(packed[3])]), *(_packed(x, np.array([len(x)])) for x in packed), own], schema=_CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, chunk = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, keys = batch.column("doc"), batch.column("key")
            for first, texts in text_chunks(batch, limit=CHUNK_BYTES // 4):
                some = [i for i, b in enumerate(texts, first) if len(b) >= width and ids[i].is_valid]
                if some:
                    held.append(of([texts[i - first] for i in some], *(np.array([c[i].as_py() for i in some], dtype=np.int64) for c in (ids, keys))))
                    n += len(held[-1][3])
                if n >= most:
                    yield row(chunk, held)
                    held, n, chunk = [], 0, chunk + 1
        if held:
            yield row(chunk, held)

    return run


_ASKED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("m", "first", "last"))])


def _asked(buckets: int):
    """The anchors of each chunk, a row per bucket: each once, with the first and the last of the chunk's documents that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *cells in zip(*(batch.column(c) for c in ("chunk", "docs", "runs", "m")), strict=True):
                docs, runs, m = (_longs(c, k) for c, k in zip(cells, (np.int64, np.int64, U), strict=True))
                if not len(m):
                    continue
                order = np.argsort(m)
                m, doc = m[order], np.repeat(docs, runs)[order]
                head = heads(m)
                m = m[head]
                bucket = ((m >> U(32)) * U(buckets) >> U(32)).view(np.int64)
                part = heads(bucket)
                sizes = np.diff(np.append(part, len(m)))
                cells = (_packed(x, sizes) for x in (m, np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[part]), pa.array(np.full(len(part), chunk.as_py())), *cells], schema=_ASKED)

    return run


_TOLD_M = pa.schema([("chunk", pa.int64()), ("m", pa.binary())])


def _in_several(rows: pa.Table) -> pa.Table:
    """To each chunk, those of its anchors in the bucket that several documents have."""
    m, first, last = (np.concatenate([_longs(c, k) for c in rows.column(x)]) for x, k in (("m", U), ("first", np.int64), ("last", np.int64)))
    order = np.argsort(m)
    head = heads(m[order])
    several = np.minimum.reduceat(first[order], head) < np.maximum.reduceat(last[order], head)
    told = np.empty(len(m), dtype=bool)
    told[order] = np.repeat(several, np.diff(np.append(head, len(m))))
    size = np.array([len(c.as_buffer()) // 8 for c in rows.column("m")])
    sizes = np.bincount(np.repeat(np.arange(len(size)), size)[told], minlength=len(size))
    some = sizes > 0
    chunks = rows.column("chunk").to_numpy()[some]
    return pa.Table.from_arrays([pa.array(chunks), _packed(m[told], sizes[some])], schema=_TOLD_M)


_LIVE = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("runs", pa.binary()), ("m", pa.binary())])


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each document whose anchor is among the chunk's ``told``."""
    out = Rows(_LIVE, 5_000)
    for batch in batches:
        for *cells, told in zip(*(batch.column(c) for c in ("docs", "keys", "runs", "m", "spans", "told")), strict=True):
            docs, keys, runs, m, span = map(_longs, cells)
            known = np.sort(np.concatenate([_longs(c, U) for c in told.values]))
            m = m.view(U)
            hit = known[np.minimum(np.searchsorted(known, m), len(known) - 1)] == m
            n = np.bincount(np.repeat(np.arange(len(docs)), runs)[hit], minlength=len(docs))
            some = n > 0
            yield from out.add(docs[some], keys[some], *(_packed(x[hit], n[some]) for x in (span, m)))
    yield from out.rest()


def _shared_runs(chunks: DataFrame, size: int) -> DataFrame:
    """(doc, key, runs, m): per document of the ``chunks`` (in order, packed) its runs whose anchor several documents have; rows that share an id and a text come once."""
    runs = chunks.agg(F.sum("n")).first()[0] or 0
    asked = chunks.select("chunk", "docs", "runs", "m").mapInArrow(_asked(runs // size + 1), "bucket long, chunk long, m binary, first binary, last binary")
    told = asked.groupBy("bucket").applyInArrow(_in_several, "chunk long, m binary").groupBy("chunk").agg(F.collect_list("m").alias("told"))
    live = chunks.drop("n", "own").join(told.hint("shuffle_hash"), "chunk").mapInArrow(_live, "doc long, key long, runs binary, m binary")
    return live.dropDuplicates(["doc", "key"])


def _ends(lo: np.ndarray, n: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per run of each ``owner``, in order: the head of the run right after it, or its own last window where none follows at once."""
    e = lo + n - 1
    e[:-1] += (lo[1:] == lo[:-1] + n[:-1]) & (owner[1:] == owner[:-1])
    return e


_WINDOW = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("pos", pa.int64()), *((f"q{k}", pa.int64()) for k in range(4))])
_WINDOW_DDL = "doc long, key long, pos long, q0 long, q1 long, q2 long, q3 long"


def _end_windows(width: int):
    """The windows at the ends of the runs in ``runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_WINDOW)
        for batch in batches:
            ids, keys, runs = batch.column("doc"), batch.column("key"), batch.column("runs")
            for first, texts in text_chunks(batch, limit=CHUNK_BYTES // 4):
                docs, names, cells = (c.slice(first, len(texts)) for c in (ids, keys, runs))
                owner, s = _unpacked(cells)
                size = np.array([len(b) for b in texts])
                begin = np.cumsum(size) - size
                lo, n = s >> 32, s & LENGTH
                start = np.unique(np.concatenate([begin[owner] + lo, begin[owner] + _ends(lo, n, owner)]))
                # Every text here has a run, so none is empty.
                whose = np.searchsorted(begin, start, "right") - 1
                q = _quarters(Hashes(_tokens(b"".join(texts)), BASES[0]), start, width)
                yield from out.add(docs.to_numpy()[whose], names.to_numpy()[whose], start - begin[whose], *(x.view(np.int64) for x in q))
        yield from out.rest()

    return run


def _place() -> Column:
    """Which of the texts of its id a window is in (33 bits of the key), over its position: one long, so that Spark aggregates it by hash."""
    return F.shiftleft("key", 31).bitwiseOR(F.col("pos")).alias("place")


def ranked(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, key, pos, ..., name) of the ``windows`` (doc, key, pos, q0..q3, ...) that several documents have, and the table from which it is read.

    ``name``: the earliest document (``doc``) that has it, and where (``place``, see :func:`_place`).
    """
    whose = [c for c in windows.columns if c not in ("q0", "q1", "q2", "q3")]
    halves = windows.select(F.explode(F.array(F.struct(F.col("q0").alias("a"), F.col("q1").alias("b")), F.struct(F.col("q2").alias("a"), F.col("q3").alias("b")))).alias("x")).select("x.*")
    repeated = halves.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    ranks = materialise(repeated.sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("r")), "suffix-ranks")
    left, right = (ranks.select(F.col("a").alias(x), F.col("b").alias(y), F.col("r").alias(r)) for x, y, r in (("q0", "q1", "r0"), ("q2", "q3", "r1")))
    pairs = materialise(windows.join(left.hint("shuffle_hash"), ["q0", "q1"]).join(right.hint("shuffle_hash"), ["q2", "q3"]).select(*whose, "r0", "r1"), "suffix-pairs")
    discard(ranks)
    return pairs.join(fresh(_named(pairs), "r0", "r1").hint("shuffle_hash"), ["r0", "r1"]).select(*whose, F.struct(F.col("first").alias("doc"), "place").alias("name")), pairs


def _named(pairs: DataFrame) -> DataFrame:
    """(r0, r1, first, place) of the pairs of ranks that several documents have."""
    of = pairs.select("r0", "r1", "doc", _place()).groupBy("r0", "r1")
    return of.agg(F.min("doc").alias("first"), F.min_by("place", "doc").alias("place"), F.max("doc").alias("last")).where("first < last").drop("last")


_TOLD = pa.schema([("m", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("span", pa.int64()), ("gone", pa.bool_())])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run, and whether both its ends lead to one earlier document, as far apart there as here."""
    out = Rows(_TOLD)
    for batch in batches:
        names, (owner, s), (_, m) = batch.column("names"), *(_unpacked(batch.column(c)) for c in ("runs", "m"))
        docs, keys = (batch.column(c).to_numpy()[owner] for c in ("doc", "key"))
        gone, table = np.zeros(len(s), dtype=bool), names.flatten()
        if len(table):
            lo, n = s >> 32, s & LENGTH
            e = _ends(lo, n, owner)
            pos, *name = (table.field(k).to_numpy() for k in range(3))
            place = np.repeat(np.arange(len(names)), names.value_lengths().fill_null(0).to_numpy()) << 32 | pos
            by = np.argsort(place)
            place, name = place[by], [x[by] for x in name]
            a, b = (np.minimum(np.searchsorted(place, owner << 32 | p), len(place) - 1) for p in (lo, e))
            gone = (place[a] == owner << 32 | lo) & (place[b] == owner << 32 | e) & (name[0][a] < docs)
            gone &= (name[0][a] == name[0][b]) & (name[1][a] >> 31 == name[1][b] >> 31) & (name[1][b] - name[1][a] == e - lo)
        yield from out.add(m[~gone], docs[~gone], keys[~gone], s[~gone], np.zeros((~gone).sum(), dtype=bool))
        # Of these only the place counts from here on, so those in a row are one span.
        lo, n, docs, keys, owner = (x[gone] for x in (s >> 32, s & LENGTH, docs, keys, owner))
        head = heads(owner, lo - np.cumsum(n) + n, lo // MOST)
        if len(head):
            yield from out.add(np.zeros(len(head), np.int64), docs[head], keys[head], lo[head] << 32 | np.add.reduceat(n, head), np.ones(len(head), dtype=bool))
    yield from out.rest()


_PIECE = pa.schema([("core", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("span", pa.int64()), ("text", pa.binary())])
_PIECE_DDL = "core long, doc long, key long, span long, text binary"


def _pieces(width: int):
    """The bytes of the runs in ``runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_PIECE, 10_000)
        for batch in batches:
            ids, keys, runs = batch.column("doc"), batch.column("key"), batch.column("runs")
            for first, texts in text_chunks(batch):
                docs, names, lists = (c.slice(first, len(texts)) for c in (ids, keys, runs))
                owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
                s = lists.flatten().to_numpy()
                lo, n = s >> 32, s & LENGTH
                bits = [texts[k][x : x + y] for k, x, y in zip(owner.tolist(), lo.tolist(), (n + width - 1).tolist(), strict=True)]
                yield from out.add(np.zeros(len(s), np.int64), docs.to_numpy()[owner], names.to_numpy()[owner], s, bits)
        yield from out.rest()

    return run


def _spread(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place of its bytes among ``all``, number of the window in its row, span, all) of each window of the pieces in ``batch``."""
    for first, texts in text_chunks(batch):
        s = batch.column("span").slice(first, len(texts)).to_numpy()
        n, size = s & LENGTH, np.array([len(b) for b in texts])
        row = np.repeat(np.arange(len(s)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield first + row, (np.cumsum(size) - size)[row], nth, s[row], b"".join(texts)


def _blocks(width: int, size: int):
    """The pieces cut into blocks of ``size`` windows by their distance from the anchor; ``core``: what all windows of a whole block share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_PIECE, 10_000)
        for batch in batches:
            for row, base, nth, span, text in _spread(batch, width):
                lo, off = span >> 32, span >> 20 & PLACE
                back = (off - nth) // size
                head = heads(row, back)
                n = np.diff(np.append(head, len(row)))
                row, base, nth, lo, off, back = (x[head] for x in (row, base, nth, lo, off, back))
                core = Hashes(_tokens(text), BASES[0]).at(base + off - size * back, width - size + 1) + U(0x9E3779B97F4A7C15) * back.astype(U)
                bits = [text[x : x + y] for x, y in zip((base + nth).tolist(), (n + width - 1).tolist(), strict=True)]
                yield from out.add(core.view(np.int64), *(batch.column(c).take(pa.array(row)) for c in ("doc", "key")), lo + nth << 32 | off - nth << 20 | n, bits)
        yield from out.rest()

    return run


_PART = pa.schema([*_WINDOW, ("span", pa.int64())])
_PART_DDL = _WINDOW_DDL + ", span long"


def _piece_windows(width: int, ends: bool):
    """All windows of the pieces, or the first and the last of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_PART)
        for batch in batches:
            for row, base, nth, span, text in _spread(batch, width):
                if ends:
                    some = (nth == 0) | (nth == (span & LENGTH) - 1)
                    row, base, nth, span = row[some], base[some], nth[some], span[some]
                q = _quarters(Hashes(_tokens(text), BASES[0]), base + nth, width)
                yield from out.add(*(batch.column(c).take(pa.array(row)) for c in ("doc", "key")), (span >> 32) + nth, *(x.view(np.int64) for x in q), span)
        yield from out.rest()

    return run


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` several documents have."""
    known = rows.groupBy(key).agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 < d1").select(key)
    return rows.join(fresh(known, key).hint("shuffle_hash"), key)


def _by_document(rows: DataFrame) -> DataFrame:
    """(doc, key, runs, m): rows that share an id and a text give each span once."""
    return rows.groupBy("doc", "key").agg(F.collect_set(F.struct("span", "m")).alias("x")).select("doc", "key", F.col("x.span").alias("runs"), F.col("x.m").alias("m"))


def _settled(pieces: DataFrame, width: int) -> DataFrame:
    """(doc, key, span) of the pieces whose first and last window lead to one earlier document, as far apart there as here."""
    ends = materialise(pieces.mapInArrow(_piece_windows(width, True), _PART_DDL), "suffix-ends")
    at_ends, pairs = ranked(ends)
    discard(ends)
    names = at_ends.where("name.doc < doc")
    lo, n = F.shiftright("span", 32), F.col("span").bitwiseAND(F.lit(LENGTH))
    at = [F.max(F.when(F.col("pos") == p, F.col("name.place"))).alias(x) for x, p in (("a", lo), ("b", lo + n - 1))]
    by_piece = names.groupBy("doc", "key", "span").agg(*at, F.min("name.doc").alias("doc0"), F.max("name.doc").alias("doc1"))
    alike = (F.col("doc0") == F.col("doc1")) & (F.shiftright("a", 31) == F.shiftright("b", 31)) & (F.col("b") - F.col("a") == n - 1)
    out = materialise(by_piece.where(alike).select("doc", "key", "span"), "suffix-settled")
    discard(pairs)
    return out


def removal_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, blocks: tuple[int, ...] = BLOCKS, chunk: int = CHUNK_RUNS, bucket: int = BUCKET_RUNS) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(doc, key, spans) of the documents with something to remove, and the tables by whose ranks it was decided.

    ``docs``: doc (long), key (long, tells apart the texts of one id) and text.
    """
    keyed = ["doc", "key"]
    runs = materialise(docs.mapInArrow(_runs(width, gram, chunk), _CHUNK_DDL), "suffix-runs")
    live = materialise(_shared_runs(runs, bucket), "suffix-live")
    own = materialise(runs.select(F.explode("own").alias("x")).select("x.*"), "suffix-own")
    discard(runs)
    ends = materialise(docs.join(live.select(*keyed, "runs").hint("shuffle_hash"), keyed).mapInArrow(_end_windows(width), _WINDOW_DDL), "suffix-ends")
    at_ends, pairs = ranked(ends)
    discard(ends)
    names = at_ends.groupBy(*keyed).agg(F.collect_list(F.struct("pos", F.col("name.doc").alias("d"), F.col("name.place").alias("p"))).alias("names"))
    told = materialise(live.join(names.hint("shuffle_hash"), keyed, "left").mapInArrow(_told, "m long, doc long, key long, span long, gone boolean"), "suffix-told")
    discard(live, pairs)
    # The earliest copy of a window never goes, so what is left holds it.
    left = materialise(_by_document(_shared(told.where("not gone").drop("gone"), "m")).drop("m"), "suffix-left")
    pieces = docs.join(left.hint("shuffle_hash"), keyed).mapInArrow(_pieces(width), _PIECE_DDL)
    gone, read = [told.where("gone").select(*keyed, "span")], left
    # The ends of whole runs have been ranked.
    for size in blocks:
        every = materialise(pieces.mapInArrow(_blocks(width, size), _PIECE_DDL), "suffix-blocks")
        discard(read)
        cut = materialise(_shared(every, "core").select(*_PIECE.names), "suffix-blocks")
        discard(every)
        gone.append(_settled(cut, width))
        read = materialise(cut.join(gone[-1].hint("shuffle_hash"), [*keyed, "span"], "left_anti"), "suffix-open")
        discard(cut)
        pieces = _shared(read, "core").select(*_PIECE.names)
    windows = materialise(pieces.mapInArrow(_piece_windows(width, False), _PART_DDL).drop("span"), "suffix-windows")
    discard(read)
    names, pairs = ranked(windows)
    discard(windows)
    one_by_one = materialise(names.where("name.doc < doc").select(*keyed, (F.shiftleft(F.col("pos"), 32) + F.lit(1)).alias("span")), "suffix-single")
    discard(pairs)
    decided = {"own": own, "runs": gone[0], **{f"blocks {k}": g for k, g in enumerate(gone[1:])}, "windows": one_by_one}
    whole = reduce(DataFrame.unionByName, decided.values()).groupBy(*keyed).agg(F.collect_set("span").alias("spans"))
    return whole, decided


def _cut(width: int):
    schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema, 2_000)
        for batch in batches:
            ids, spans = batch.column("doc"), batch.column("spans")
            for first, texts in text_chunks(batch):
                rows = []
                for i, b in enumerate(texts, first):
                    kept, gone, runs = b, 0, 0
                    if spans[i].is_valid and b:
                        mask = covered(spans[i].values.to_numpy(), len(b), width)
                        gone = int(mask.sum())
                        runs = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                        kept = np.frombuffer(b, dtype=np.uint8)[~mask].tobytes()
                    rows.append((ids[i].as_py(), len(b), gone, runs, kept))
                yield from out.add(*map(list, zip(*rows, strict=True)))
        yield from out.rest()

    return run


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for every row of ``docs``; ``kept`` is binary, as a cut may part a character.

    A byte of the UTF-8 text goes if a ``width``-byte string over it also
    starts earlier: in a document with a smaller id, or earlier in its own.
    ``width`` is a multiple of 4.  Null and empty texts are zero bytes.  A row
    with a null id takes part in no comparison.  Rows that share an id are not
    compared with each other, each with the rows of smaller ids; equal ones
    have equal results.
    """
    if width % 4:
        raise ValueError("width must be a multiple of 4")
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    spans, _ = removal_spans(d, width, min(GRAM, width // 2))
    cut = d.join(spans.hint("shuffle_hash"), ["doc", "key"], "left").select("doc", "text", "spans").mapInArrow(_cut(width), "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.withColumnRenamed("doc", id_col)
