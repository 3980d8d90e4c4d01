"""SimHash near-dedup: tiled exact comparison of fingerprints.

Equal fingerprints are one class from the start.  Two fingerprints within
``radius`` bits agree wholly in one of ``radius + 1`` blocks of bits, so a tile
holds fingerprints with one block value; tiles are compared with numpy
exclusive-or and bit counts, and tile pairs whose population counts differ by
more than the radius are skipped.  A block value that very many fingerprints
share is cut into cells by population count and salt; each pair of cells near
enough is a tile pair of its own.  A tile reports a spanning forest of its
links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import Rows, text_chunks
from quarry.llm.components import smallest_reachable
from quarry.llm.scratch import materialise

BITS, RADIUS, SHINGLE = 64, 4, 4
#: Fingerprints a group holds about, and the most that share a block value before it is cut into cells.
GROUP, CELL = 20_000, 8_192
#: Rows of a numpy tile.
TILE = 512


def fingerprint_words(words: list[bytes], shingle: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of each shingle of ``words``, joined by a space; fewer words make one shingle."""
    h = xxhash.xxh64_intdigest
    if not words:
        return []
    if len(words) <= shingle:
        return [h(b" ".join(words), 42)]
    line = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    end = np.cumsum(size) - 1
    begin = end - size + 1
    return [h(line[a:b], 42) for a, b in zip(begin[: 1 - shingle].tolist(), end[shingle - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of ``sizes`` hashes (none is empty) the bits that over half of them have."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


_FP = pa.schema([("doc", pa.int64()), ("fp", pa.int64())])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_FP)
        for batch in batches:
            for first, texts in text_chunks(batch):
                hashes = [fingerprint_words(b.lower().split(), shingle) for b in texts]
                sizes = np.array([len(h) for h in hashes])
                fp = np.zeros(len(texts), dtype=np.uint64)
                if sizes.any():
                    fp[sizes > 0] = majority(np.array([x for h in hashes for x in h], dtype=np.uint64), sizes[sizes > 0])
                yield from out.add(batch.column("doc").slice(first, len(texts)), fp.view(np.int64))
        yield from out.rest()

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc, fp) for every row: the SimHash of the whole text as a signed long; 0 for a text without words."""
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return d.mapInArrow(_fingerprints(shingle), "doc long, fp long")


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into ``a``, into ``b``, or both into ``a``) within ``radius`` bits, tile by tile."""
    within = b is None
    b = a if within else b
    pa_, pb = np.bitwise_count(a), np.bitwise_count(b)
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
    sa, sb, ca, cb = a[oa], b[ob], pa_[oa].astype(int), pb[ob].astype(int)
    for i in range(0, len(sa), TILE):
        low, high = ca[i] - radius, ca[min(i + TILE, len(sa)) - 1] + radius
        for j in range(i if within else 0, len(sb), TILE):
            if cb[j] > high:
                break
            if cb[min(j + TILE, len(sb)) - 1] < low:
                continue
            near = np.bitwise_count(sa[i : i + TILE, None] ^ sb[None, j : j + TILE]) <= radius
            if within and i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if len(x):
                yield oa[x + i], ob[y + j]


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root of each of ``n`` nodes, the smallest index of its component."""
    root = np.arange(n)
    for x, y in links:
        while True:  # hook the larger root to the smaller, then flatten, until all these links agree
            rx, ry = root[x], root[y]
            apart = rx != ry
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
            while not np.array_equal(root, flat := root[root]):
                root = flat
    return root


def _compare(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["val", "doc"], kind="stable")
        val, fp, doc, side = pdf.val.to_numpy(), pdf.fp.to_numpy().view(np.uint64), pdf.doc.to_numpy(), pdf.side.to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], val[1:] != val[:-1], [True]]))
        us, vs = [], []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if j - i < 2:
                continue
            f, s = fp[i:j], side[i:j]
            if s.any():
                left, right = np.flatnonzero(s == 0), np.flatnonzero(s == 1)
                links = ((left[x], right[y]) for x, y in tile_links(f[left], f[right], radius)) if len(left) else iter(())
            else:
                links = tile_links(f, None, radius)
            root = forest(j - i, links)
            moved = np.flatnonzero(root != np.arange(j - i))
            us.append(doc[i:j][moved])
            vs.append(doc[i:j][root[moved]])
        return pd.DataFrame({"u": np.concatenate(us) if us else np.zeros(0, np.int64), "v": np.concatenate(vs) if vs else np.zeros(0, np.int64)})

    return run


def links_within(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between ids of ``classes`` (doc long, fp long; each fp once) that hold all pairs within ``radius`` bits together.

    Every pair within the radius is compared; of each tile a spanning forest
    of its links is kept, so components are whole and no group is emitted as
    all its pairs.
    """
    blocks = radius + 1
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    spread = F.array(*(F.struct(F.lit(i).alias("blk"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("val")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))))
    keys = classes.select("doc", "fp", F.bit_count("fp").alias("pop"), F.explode(spread).alias("k")).select("doc", "fp", "pop", "k.blk", "k.val")
    groups = max(1, -(-classes.count() // GROUP))

    cells = keys.groupBy("blk", "val", "pop").agg(F.count("*").alias("n"))
    hot = cells.groupBy("blk", "val").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / CELL).cast("int").alias("s")))).alias("cells")).where(F.col("n") > 2 * CELL).select("blk", "val", "cells")
    tagged = keys.join(hot, ["blk", "val"], "left")
    empty = F.lit(None).cast("int")
    cold = tagged.where("cells is null").select("blk", F.pmod(F.xxhash64("val"), F.lit(groups)).alias("g"), *(empty.alias(c) for c in ("p1", "s1", "p2", "s2")), "val", F.lit(0).alias("side"), "doc", "fp")
    near = F.filter(F.map_entries("cells"), lambda e: F.abs(e.key - F.col("pop")) <= radius)
    partners = F.flatten(F.transform(near, lambda e: F.transform(F.sequence(F.lit(0), e.value - 1), lambda j: F.struct(e.key.alias("p"), j.alias("s")))))
    own = F.struct(F.col("pop").alias("p"), F.pmod(F.xxhash64("fp"), F.col("cells")[F.col("pop")]).cast("int").alias("s"))
    pairs = tagged.where("cells is not null").select("blk", "val", "doc", "fp", own.alias("own"), F.explode(partners).alias("other"))
    pairs = pairs.select("blk", F.col("val").alias("g"), *(f("own", "other")[c].alias(f"{c}{k}") for k, f in ((1, F.least), (2, F.greatest)) for c in ("p", "s")), "val", F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "doc", "fp")
    tiles = cold.unionByName(pairs)
    return tiles.groupBy("blk", "g", "p1", "s1", "p2", "s2").applyInPandas(_compare(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint``: 16 hexadecimal digits; null, empty and wordless texts have
    zero and link like any other.  ``component_id``: the smallest id reachable
    over links of ``radius`` or fewer differing bits, the row's own included.
    Rows with a null id link to nothing but belong to their fingerprint's
    class (null where it has no id).  Rows that share an id are one document.
    """
    base = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = materialise(base.where("doc is not null").groupBy("fp").agg(F.min("doc").alias("doc")), "classes")
    # An id with several texts is in several classes: its rows are one document, so its classes are linked.
    shared = base.where("doc is not null").groupBy("doc").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc")
    bridges = base.join(shared, "doc").join(classes.select("fp", F.col("doc").alias("v")), "fp").select(F.col("doc").alias("u"), "v")
    roots = smallest_reachable(links_within(classes, radius).unionByName(bridges))
    labels = classes.join(roots, classes["doc"] == roots["node"], "left").select("fp", F.coalesce("root", "doc").alias("component_id"))
    out = base.join(labels, "fp", "left")
    return out.select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
