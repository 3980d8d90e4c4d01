"""SimHash near-dedup at a Jaccard similarity of shingle sets: tiled comparison of fingerprints, then of the sets.

Texts of one shingle set are one class.  A class has a SimHash fingerprint of
``WORDS`` 64-bit words.  At a similarity of 0.8 two sets' fingerprints differ
in ``FLIP`` of the bits on average: ten of a word, 39 of 256, and but for one
pair in a million in ``RADIUS`` and ``WIDE`` at most.

Tiles hold fingerprints that agree in a block of bits.  No block agrees in all
near pairs, as it does for a small radius, so there are several: as many blocks
(drawn at random from the bits of all words but the first) as leave a pair of
similarity 0.8 without a common tile with probability ``MISS``, were the bits
of a pair independent (see the README for the share that was measured).  The more
classes, the longer the blocks, so that a tile holds ``TILE`` fingerprints or
so; up to that number all are one tile.  In a tile fingerprints are compared by
numpy exclusive-or and bit counts, tile pairs whose population counts differ by
more than the radius are skipped, and a tile hands on for each class its
smallest neighbour.  A block that very many share is cut into cells, each pair
of which is a tile.

The sets decide on these candidates.  Candidates, linked or not, make groups;
classes of a group that are not yet in its largest component are compared with
all of it, again in tiles of fingerprints, in cells of bounded size, with the
sets at hand and pairs of one component left out.  A tile reports a spanning
forest of its links, so no group is emitted as all its pairs, and every pair of
a group is in one component or has been compared.
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
from quarry.llm.repeats import fresh
from quarry.llm.rolling import BASES, Hashes, U, WordHashes, mix
from quarry.llm.scratch import discard, materialise
from quarry.llm.simhash import majority, tile_links

SHINGLE, SIMILARITY = 5, 0.8
#: Words of a fingerprint, and the bits of one word and of all in which near copies differ at most.
WORDS, RADIUS, WIDE = 4, 24, 66
#: Share of the bits in which sets of similarity 0.8 differ (0.15, the angle between them over pi; some more in small sets), and of such pairs that no tile may hold.
FLIP, MISS = 0.17, 1e-6
#: Fingerprints a tile holds about, and those of a block beyond which it is cut into cells.
TILE, HOT = 8_192, 16_384
#: Rows a group of tiles with sets holds about, and the classes of a group beyond which it is cut into cells.
GROUP, CELL = 2_000, 512


def shingle_sets(texts: list[bytes], shingle: int, memo: WordHashes) -> list[np.ndarray]:
    """Per text the sorted 64-bit hashes of its shingles of lower-case words; fewer words make one shingle."""
    out = []
    for b in texts:
        words = memo.of(b.lower().split())
        if len(words) >= shingle:
            out.append(np.unique(Hashes(words, BASES[0]).every(shingle)))
        else:
            out.append(Hashes(words, BASES[0]).every(len(words)) if len(words) else np.zeros(0, U))
    return out


def _name(s: np.ndarray) -> int:
    """The class of a shingle set; 0 of an empty one."""
    return xxhash.xxh64_intdigest(s.tobytes(), 5) if len(s) else 0


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``WORDS`` fingerprints per set, each of other hashes of its shingles; no set is empty."""
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    return np.stack([majority(mix(flat + U(w * BASES[1] % (1 << 64))) if w else flat, sizes) for w in range(WORDS)], axis=1)


_SIGNED = pa.schema([("doc", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), *((f"f{w}", pa.int64()) for w in range(WORDS))])
_FPS = [f"f{w}" for w in range(WORDS)]


def _signed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, memo = Rows(_SIGNED), WordHashes()
        for batch in batches:
            for first, texts in text_chunks(batch):
                sets = shingle_sets(texts, shingle, memo)
                names = np.array([_name(s) for s in sets], dtype=U).view(np.int64)
                held = np.array([len(s) for s in sets])
                fps = np.zeros((len(sets), WORDS), dtype=U)
                if held.any():
                    fps[held > 0] = wide_fingerprints([s for s in sets if len(s)])
                yield from out.add(batch.column("doc").slice(first, len(texts)), names, held, *(fps[:, w].copy().view(np.int64) for w in range(WORDS)))
        yield from out.rest()

    return run


def blocks_for(classes: int) -> list[np.ndarray]:
    """The bits of each block, for this many classes: places among all bits of a fingerprint, none in the first word."""
    bits = max(0, round(np.log2(max(classes, 1) / TILE)))
    agree = (1 - FLIP) ** bits
    blocks = 1 if bits == 0 else int(np.ceil(np.log(MISS) / np.log1p(-agree)))
    r = np.random.default_rng(42)
    return [np.sort(r.choice(np.arange(64, 64 * WORDS), bits, replace=False)) for _ in range(blocks)]


def _block_keys(batch: pa.RecordBatch, blocks: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Per block the key of each row: the block's number and its bits."""
    fps = [batch.column(f).to_numpy().view(U) for f in _FPS]
    for i, places in enumerate(blocks):
        k = np.full(batch.num_rows, i, dtype=U)
        for p in places.tolist():
            k = (k << U(1)) | ((fps[p >> 6] >> U(p & 63)) & U(1))
        yield k.view(np.int64)


def _counts(blocks: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys in _block_keys(batch, blocks):
                k, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["k", "n"])

    return run


def _keyed(blocks: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys in _block_keys(batch, blocks):
                yield pa.RecordBatch.from_arrays([pa.array(keys), *batch.columns], names=["k", *batch.schema.names])

    return run


_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def smallest_neighbours(c: np.ndarray, n: np.ndarray, fps: np.ndarray, side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(class, its smallest neighbour) of a tile's classes that have one: within the radius, and as near in size as near copies are.

    ``side``: all 0 to compare all with all, else 0 and 1 across.
    """
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(left) and len(right):
        pairs = ((left[x], right[y]) for x, y in tile_links(fps[left, 0], fps[right, 0], RADIUS))
    else:
        pairs = tile_links(fps[:, 0], None, RADIUS) if len(left) else iter(())
    none = np.iinfo(np.int64).max
    least = np.full(len(c), none)
    for x, y in pairs:
        far = np.bitwise_count(fps[x, 0] ^ fps[y, 0]).astype(np.int64)
        for w in range(1, WORDS):
            far += np.bitwise_count(fps[x, w] ^ fps[y, w])
        near = (far <= WIDE) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-6)
        x, y = x[near], y[near]
        np.minimum.at(least, x, c[y])
        np.minimum.at(least, y, c[x])
    has = least != none
    return c[has], least[has]


def _neighbours(similarity: float):
    """The smallest neighbours of all tiles; rows come by ``k``, ``x``, ``y``, and a tile may span batches."""

    def compared(t: pa.Table) -> pa.RecordBatch:
        fps = np.stack([t.column(f).to_numpy().view(U) for f in _FPS], axis=1)
        u, v = smallest_neighbours(t.column("c").to_numpy(), t.column("n").to_numpy(), fps, t.column("side").to_numpy(), similarity)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], schema=_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(x).to_numpy().astype(np.int64) for x in ("k", "x", "y")], axis=1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if hi > lo:
                    if held and tuple(key[lo]) != last:
                        yield compared(pa.Table.from_batches(held))
                        held = []
                    last = tuple(key[lo])
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield compared(pa.Table.from_batches(held))

    return run


def candidates(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (u, v), u < v, of classes (c, n, f0 ...): each class that has neighbours in a tile with the smallest of them."""
    full = classes.where("n > 0").select("c", "n", *_FPS)
    blocks = blocks_for(full.count())
    counts = full.mapInArrow(_counts(blocks), "k long, n long").groupBy("k").agg(F.sum("n").alias("held"))
    hot = counts.where(F.col("held") > 2 * HOT).select("k", F.ceil(F.col("held") / HOT).cast("int").alias("m"))
    keyed = full.mapInArrow(_keyed(blocks), f"k long, c long, n long, {', '.join(f'{f} long' for f in _FPS)}")
    cut = keyed.join(F.broadcast(hot), "k", "left").withColumn("m", F.coalesce("m", F.lit(1)))  # a row for each 2 * HOT rows of a block at most
    cut = cut.withColumn("own", F.pmod(F.xxhash64("c", F.lit(1)), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    side = F.when(F.col("own") > F.col("other"), 1).otherwise(0).cast("long")
    tiles = cut.select("k", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side"), "c", "n", *_FPS)
    return tiles.repartition("k", "x", "y").sortWithinPartitions("k", "x", "y").mapInArrow(_neighbours(similarity), "u long, v long").distinct()


_SETS = pa.schema([("c", pa.int64()), ("s", pa.binary())])


def _sets(shingle: int):
    """The sets of the rows whose class is ``c``: another text of the same id is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, memo = Rows(_SETS, 500), WordHashes()
        for batch in batches:
            want = batch.column("c")
            for first, texts in text_chunks(batch):
                sets = shingle_sets(texts, shingle, memo)
                names = np.array([_name(s) for s in sets], dtype=U).view(np.int64)
                kept = [k for k in range(len(sets)) if names[k] == want[first + k].as_py()]
                yield from out.add(names[kept], [sets[k].tobytes() for k in kept])
        yield from out.rest()

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [jaccard(np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)) >= similarity for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def tile_forest(sets: list[np.ndarray], fp: np.ndarray, side: np.ndarray, root: np.ndarray, similarity: float, radius: int = RADIUS) -> np.ndarray:
    """``root`` (a class each, of those in one component already) joined further by the links across the two sides."""
    sizes, root = np.array([len(s) for s in sets]), root.copy()
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    held = np.zeros(ids.max() + 1, dtype=bool)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for x, y in tile_links(fp[left], fp[right], radius):
        order = np.argsort(x, kind="stable")
        x, y = left[x[order]], right[y[order]]
        cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            i, js = x[lo], y[lo:hi]
            # Pairs of one component need no comparison, and sets are no more similar than their sizes are.
            js = js[root[js] != root[i]]
            js = js[np.minimum(sizes[js], sizes[i]) >= similarity * np.maximum(sizes[js], sizes[i]) - 1e-6]
            if not len(js):
                continue
            mine = ids[begin[i] : begin[i + 1]]
            held[mine] = True
            both = np.array([np.count_nonzero(held[ids[begin[j] : begin[j + 1]]]) for j in js.tolist()])
            held[mine] = False
            for j in js[both / (sizes[js] + sizes[i] - both) >= similarity].tolist():
                a, b = root[i], root[j]
                if a != b:
                    root[root == max(a, b)] = min(a, b)
    return root


def _compared(similarity: float):
    """Per tile the links that its pairs add, as a forest over the components they join."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "x", "y", "side", "c"], kind="stable")
        key, fp, side, before = pdf[["k", "x", "y"]].to_numpy(), pdf.fp.to_numpy().view(U), pdf.side.to_numpy(), pdf.root.to_numpy()
        sets = [np.frombuffer(s, U) for s in pdf.s]
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
        found = {(0, 0)}
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            after = tile_forest(sets[i:j], fp[i:j], side[i:j], before[i:j], similarity)
            found.update(zip(before[i:j].tolist(), after.tolist(), strict=True))
        out = np.array([p for p in found if p[0] != p[1]], dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": out[:, 0], "v": out[:, 1]})

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(id, component_id) for every id of ``docs`` that is not null, once: the smallest id reachable over links.

    A link is a Jaccard similarity of ``similarity`` or more between the sets
    of ``shingle``-word shingles.  Null, empty and wordless texts have one set,
    the empty one, and are copies of each other.  Rows that share an id are
    one document.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    base = materialise(d.mapInArrow(_signed(shingle), f"doc long, c long, n long, {', '.join(f'{f} long' for f in _FPS)}"), "signed")
    classes = materialise(base.groupBy("c").agg(F.min("doc").alias("doc"), *(F.first(x).alias(x) for x in ("n", *_FPS))), "set-classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        ends = wanted.join(classes.select("c", "doc"), "c")
        return materialise(d.join(ends, "doc").select("c", "text").mapInArrow(_sets(shingle), "c long, s binary").dropDuplicates(["c"]), "sets")

    pairs = materialise(candidates(classes, similarity), "candidates")
    sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("c")).distinct())
    both = fresh(pairs, "u", "v").join(sets.select(F.col("c").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("c").alias("v"), F.col("s").alias("b")), "v")
    found = materialise(both.mapInArrow(_verified(similarity), "u long, v long"), "similar")
    discard(sets)

    # A group: what candidates hold together, linked or not.  Its classes outside its largest component are compared with all of it.
    groups = smallest_reachable(pairs).select(F.col("node").alias("c"), F.col("root").alias("k"))
    roots = smallest_reachable(found)
    placed = materialise(groups.join(roots, F.col("c") == F.col("node"), "left").select("k", "c", F.coalesce("root", "c").alias("root")), "placed")
    discard(pairs)
    main = placed.groupBy("k", "root").agg(F.count("*").alias("n")).groupBy("k").agg(F.max(F.struct("n", "root")).alias("x"), F.sum("n").alias("held")).where("held > 2 and x.n < held").select("k", F.col("x.root").alias("root0"))
    apart = placed.join(fresh(main, "k"), "k").join(classes.select("c", F.col("f0").alias("fp")), "c").select("k", "c", "fp", "root", (F.col("root") != F.col("root0")).alias("apart"))
    apart = materialise(apart, "apart")
    cells = apart.groupBy("k").agg(F.ceil(F.count_if("apart") / CELL).cast("int").alias("mx"), F.ceil(F.count("*") / CELL).cast("int").alias("my"))
    opened = materialise(apart.join(fresh(cells, "k"), "k"), "opened")
    discard(placed, apart)
    sets = sets_of(opened.select("c").distinct())
    cell = F.xxhash64("c", F.lit(1))
    across = opened.where("apart").select("k", F.pmod(cell, F.col("mx")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("my") - 1)).alias("y"), F.lit(0).alias("side"), "c", "fp", "root")
    along = opened.select("k", F.explode(F.sequence(F.lit(0), F.col("mx") - 1)).alias("x"), F.pmod(cell, F.col("my")).cast("int").alias("y"), F.lit(1).alias("side"), "c", "fp", "root")
    tiles = across.unionByName(along)
    groups = max(1, -(-tiles.count() // GROUP))
    tiles = tiles.join(sets, "c").withColumn("g", F.pmod(F.xxhash64("k", "x", "y"), F.lit(groups)))
    found = found.unionByName(materialise(tiles.groupBy("g").applyInPandas(_compared(similarity), "u long, v long"), "similar"))
    discard(opened, sets)

    # An id with several texts is in several classes: its rows are one document, so its classes are linked.
    shared = base.groupBy("doc").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("doc")
    bridges = base.join(shared, "doc").join(classes.select("c", F.col("doc").alias("v")), "c").select(F.col("doc").alias("u"), "v")
    by_doc = found.join(classes.select(F.col("c").alias("u"), F.col("doc").alias("du")), "u").join(classes.select(F.col("c").alias("v"), F.col("doc").alias("dv")), "v").select(F.col("du").alias("u"), F.col("dv").alias("v"))
    whole = smallest_reachable(by_doc.unionByName(bridges))
    labels = classes.join(whole, classes["doc"] == whole["node"], "left").select("c", F.coalesce("root", "doc").alias("component_id"))
    return base.select("doc", "c").join(labels, "c").groupBy("doc").agg(F.min("component_id").alias("component_id")).withColumnRenamed("doc", id_col)
