"""Periodic runs: stretches of words that repeat with a period, by the suffix tree of each text.

A run's rightmost square ``ww`` is a branching tandem repeat: the suffixes that
start at its two halves part after exactly ``|w|`` words, so both are leaves of
the suffix tree's node of that depth, under different children.  The tree is
held as suffix array and longest common prefixes (each boundary between two
neighbours of the array is a node, nodes of more than two children are chains
of such).  At each node the leaves of the smaller half are listed and looked up
in the other half, ``|w|`` words before and after: n log n tests in all.  Found
squares are rotated to the left as far as the words agree, which gives the
whole run; of the runs of one stretch the one with the smallest period is kept.

A run of ``least`` words has a window of ``least / 2`` words that its text holds
twice, so a text without such a window has none and gets no tree.  Everything
is numpy over the texts of one Arrow chunk; no text is cut, and what a worker
holds grows with its longest text (about 60 bytes a word, and 4 for each doubling).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import Rows, text_chunks
from quarry.llm.rolling import BASES, Hashes, U, mix

LEAST = 12
#: Leaves of smaller halves that are looked up at a time.
BLOCK = 1 << 20


class WordNumbers(dict):
    """A number for each word, in the order in which words are met: equal numbers are equal words."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def repeating(texts: list[np.ndarray], width: int) -> np.ndarray:
    """For each text: may it hold a window of ``width`` words twice?  (Never false where it does.)"""
    sizes = np.array([len(t) for t in texts])
    out = np.zeros(len(texts), dtype=bool)
    if not (sizes > width).any():
        return out
    flat = np.concatenate(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    hashes = Hashes(mix(flat.astype(U) + U(1)), BASES[0]).every(width)
    inside = np.flatnonzero(owner[: len(hashes)] == owner[width - 1 :])
    keys = hashes[inside] ^ mix(owner[inside].astype(U) + U(1))
    ranked = np.sort(keys)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if len(twice):
        at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        out[owner[inside[twice[at] == keys]]] = True
    return out


def suffix_ranks(s: np.ndarray) -> list[np.ndarray]:
    """Ranks of the first 1, 2, 4, ... tokens at each place, until no two places agree; the last token of ``s`` is unique."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    levels, width, places, old = [], 1, order, np.zeros(n, dtype=np.int64)
    key = s[order]
    rank = np.empty(n, dtype=np.int64)
    while True:
        # ``places`` are in the order of (old rank, key); a place's new rank is the array index at which its equals begin.
        group = old[places]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_key = new_group | np.concatenate([[True], key[1:] != key[:-1]])
        index = np.arange(len(places))
        begin = np.maximum.accumulate(np.where(new_group, index, 0))
        rank[places] = group + np.maximum.accumulate(np.where(new_key, index, 0)) - begin
        levels.append(rank.astype(np.int32))
        alone = new_key & np.concatenate([new_key[1:], [True]])
        places = places[~alone]
        if not len(places):
            return levels
        old = rank.copy()
        after = places + width
        key = np.where(after < n, old[np.minimum(after, n - 1)], -1)
        again = np.lexsort((key, old[places]))
        places, key = places[again], key[again]
        width *= 2


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many tokens agree from places ``a`` and ``b`` on (``back``: up to them, both included)."""
    n, length = len(levels[0]), np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = (a - length - (1 << k) + 1, b - length - (1 << k) + 1) if back else (a + length, b + length)
        inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < n)
        same = np.zeros(len(a), dtype=bool)
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        length += same.astype(np.int64) << k
    return length


def _nearest_less(v: np.ndarray, equal: bool) -> np.ndarray:
    """For each index the nearest earlier one with a smaller value (``equal``: or the same); -1 where there is none."""
    p = np.arange(-1, len(v) - 1)
    todo = np.flatnonzero(p >= 0)
    while len(todo):
        at = p[todo]
        on = v[at] > v[todo] if equal else v[at] >= v[todo]
        todo = todo[on]
        p[todo] = p[at[on]]
        todo = todo[p[todo] >= 0]
    return p


def branching_squares(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, |w|) of each ``ww`` whose halves' suffixes part right after ``w``."""
    rank = levels[-1].astype(np.int64)
    n = len(rank)
    array = np.empty(n, dtype=np.int64)
    array[rank] = np.arange(n)
    depth = _common(levels, array[:-1], array[1:])
    low = _nearest_less(depth, True) + 1
    high = len(depth) - 2 - _nearest_less(depth[::-1], False)[::-1]
    nodes = np.flatnonzero(depth > 0)
    # A node at boundary b parts the array's places low..b from b+1..high+1.
    left, right = nodes - low[nodes] + 1, high[nodes] - nodes + 1
    few = np.minimum(left, right)
    starts, widths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cut = np.searchsorted(np.cumsum(few), np.arange(0, few.sum() + BLOCK, BLOCK), side="right")
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        node, size, by_left = nodes[i:j], few[i:j], (left <= right)[i:j]
        first = np.where(by_left, low[node], node + 1)
        leaf = array[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
        d = np.repeat(depth[node], size)
        begin, end = np.repeat(np.where(by_left, node + 1, low[node]), size), np.repeat(np.where(by_left, high[node] + 1, node), size)
        for other in (leaf + d, leaf - d):
            there = np.flatnonzero((other >= 0) & (other < n))
            r = rank[other[there]]
            hit = there[(r >= begin[there]) & (r <= end[there])]
            starts.append(np.minimum(leaf[hit], other[hit]))
            widths.append(d[hit])
    return np.concatenate(starts), np.concatenate(widths)


def maximal_runs(s: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of ``s``, by start and period; the last token is unique."""
    levels = suffix_ranks(s)
    start, period = branching_squares(levels)
    more = _common(levels, start - 1, start + period - 1, back=True)
    length = more + 2 * period
    long = length >= least
    start, length, period = (start - more)[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    lead = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])[: len(start)]
    start, length, period = start[lead], length[lead], period[lead]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per index of a text with runs: their (start, length, period); word numbers are 0 or more."""
    wanted = np.flatnonzero(repeating(texts, -(-least // 2)))
    if not len(wanted):
        return {}
    # A token that occurs once ends each text, so that no repeat crosses it.
    ends = -1 - np.arange(len(wanted))
    s = np.concatenate([x for k, e in zip(wanted.tolist(), ends, strict=True) for x in (texts[k], [e])])
    start, length, period = maximal_runs(s, least)
    begin = np.concatenate([[0], np.cumsum([len(texts[k]) + 1 for k in wanted.tolist()])])
    cut = np.searchsorted(start, begin)
    return {k: (start[i:j] - b, length[i:j], period[i:j]) for k, b, i, j in zip(wanted.tolist(), begin[:-1].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True) if j > i}


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if out is None:
                out = Rows(pa.schema([batch.schema.field("doc"), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("kept_text", pa.string())]), 2_000)
            for first, texts in text_chunks(batch):
                numbers, words = WordNumbers(), [b.split() for b in texts]
                found = runs_of([numbers.of(w) for w in words], least)
                runs, kept = [], []
                for k, w in enumerate(words):
                    start, length, period = found.get(k, ((), (), ()))
                    runs.append([{"start": a, "length": b, "period": c} for a, b, c in zip(start, length, period, strict=True)])
                    if len(start):
                        change = np.zeros(len(w) + 1, dtype=np.int64)
                        np.add.at(change, start + period, 1)
                        np.add.at(change, start + length, -1)
                        w = compress(w, np.cumsum(change)[:-1] == 0)
                    kept.append(b" ".join(w))
                ids = batch.column("doc").slice(first, len(texts))
                yield from out.add(ids, [len(w) for w in words], pa.array(runs, pa.list_(_RUN)), pa.array(kept, pa.binary()).cast(pa.string()))
        if out is not None:
            yield from out.rest()

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words long, runs array<struct<start, length, period>>, kept_text) for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run is a stretch of
    consecutive words with smallest period p (words p apart are equal), at
    least ``least`` and 2p words long, which no neighbouring word extends.
    ``runs`` is ordered by start, then period, and empty for null, empty and
    wordless texts.  ``kept_text``: the words that no run holds after its first
    period, joined by one space.  Each row is judged for itself, so null and
    repeated ids come back as they are.
    """
    d = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = d.schema["doc"].dataType.simpleString()
    out = d.mapInArrow(_found(least), f"doc {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_text string")
    return out.withColumnRenamed("doc", id_col)
