"""MinHash near-dedup: circulant signatures, banding, exact verification on the full shingle sets.

Two permutations of the 32-bit numbers make every signature coordinate: the
first scatters the shingles, the second, circularly shifted by one more place
for each coordinate, ranks them; a coordinate is the least rank in the set.
``BANDS`` bands of ``ROWS`` coordinates meet for a pair of similarity s with
probability ``1 - (1 - s**ROWS)**BANDS``: all but 3 pairs in a million at 0.8,
all but 7 in a thousand million at 0.85.

Equal sets are one class from the start.  In each band's bucket every class is
compared with the one of the smallest id.  Classes that this leaves in another
component are then compared with all of their bucket, in tiles of bounded
size, pairs of one component left out; a tile reports only how components
join.  So each pair of a bucket is in one component or has been compared, and
no group is emitted as all its pairs.  Before two sets are compared, parity
sketches may rule the pair out: the bits in which two sketches differ are no
more than the shingles in which the sets do.
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
from quarry.llm.near_copies import shingle_sets
from quarry.llm.repeats import fresh
from quarry.llm.rolling import BASES, U, WordHashes, mix
from quarry.llm.scratch import discard, materialise

SHINGLE, PERCENT = 2, 80
BANDS, ROWS = 32, 5
#: Classes a tile has on either side, and rows a group of tiles holds about.
CELL, GROUP = 512, 2_000
#: Bits of a parity sketch, and of the bitmap that leaves most unwanted texts where they are.
SKETCH, FILTER = 1024, 1 << 25

_U32 = np.uint32


def scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit numbers."""
    x = x ^ (x >> _U32(16))
    x *= _U32(0x7FEB352D)
    x ^= x >> _U32(15)
    x *= _U32(0x846CA68B)
    x ^= x >> _U32(16)
    return x


#: The second permutation: y * _TIMES, folded by a shift of 15 bits, * _AGAIN.
_TIMES, _AGAIN = 0x9E3779B1, 0x85EBCA6B


def circulant(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> Iterator[np.ndarray]:
    """For each coordinate the least rank in every set (64-bit hashes; no set is empty) under the shifted second permutation."""
    x = scatter((np.concatenate(sets) >> U(32)).astype(_U32)) * _U32(_TIMES)
    begin = np.cumsum([0, *map(len, sets[:-1])])
    ranks, folded = np.empty_like(x), np.empty_like(x)
    for k in range(1, coordinates + 1):
        # (y - k) * _TIMES, as the numbers are counted around.
        np.subtract(x, _U32(k * _TIMES & 0xFFFFFFFF), out=ranks)
        np.right_shift(ranks, _U32(15), out=folded)
        np.bitwise_xor(ranks, folded, out=ranks)
        np.multiply(ranks, _U32(_AGAIN), out=ranks)
        yield np.minimum.reduceat(ranks, begin)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BANDS`` keys for each set; no set is empty."""
    keys = np.empty((len(sets), BANDS), dtype=U)
    for k, least in enumerate(circulant(sets)):
        band, row = divmod(k, ROWS)
        start = np.full(len(sets), band, dtype=U) if row == 0 else keys[:, band]
        keys[:, band] = mix(start * U(BASES[1]) + least.astype(U) + U(1))
    return keys


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits for each set, as two signed longs."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes(), 5) for s in sets), dtype=np.int64).reshape(-1, 2)


_SIGNED = pa.schema([("doc", pa.int64()), ("c", pa.int64()), ("c2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _signed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, memo = Rows(_SIGNED, 5_000), WordHashes()
        for batch in batches:
            for first, texts in text_chunks(batch):
                sets = shingle_sets(texts, shingle, memo)
                names, held = _names(sets), np.array([len(s) for s in sets])
                full = [s for s in sets if len(s)]
                flat = band_keys(full).reshape(-1).view(np.int64) if full else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(held > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(ends, pa.array(flat)).cast(_SIGNED.field("bands").type)
                yield from out.add(batch.column("doc").slice(first, len(texts)), names[:, 0], names[:, 1], held, bands)
        yield from out.rest()

    return run


def _filter_of(wanted: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER`` bits, whatever there is wanted: a wanted doc's bit is set.  Its words come to the driver, one million at most."""
    bit = F.pmod(F.xxhash64("doc"), F.lit(FILTER))
    words = wanted.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("x"))
    out = np.zeros(FILTER >> 6, dtype=np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("w").to_numpy()] = batch.column("x").to_numpy()
    return out.view(U)


_SETS = pa.schema([("doc", pa.int64()), ("c", pa.int64()), ("s", pa.binary())])


def _sets(shingle: int, bitmap: np.ndarray):
    """(doc, c, s) of the rows whose bit is set, before any row is shuffled; some are not wanted, all that are wanted are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, memo = Rows(_SETS, 500), WordHashes()
        for batch in batches:
            b = batch.column("b").to_numpy()
            held = (bitmap[b >> 6] >> (b & 63).astype(U)) & U(1) == 1
            batch = batch.filter(pa.array(held))
            for first, texts in text_chunks(batch):
                sets = shingle_sets(texts, shingle, memo)
                yield from out.add(batch.column("doc").slice(first, len(texts)), _names(sets)[:, 0], [s.tobytes() for s in sets])
        yield from out.rest()

    return run


def alike(both: np.ndarray | int, sizes: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """100 * intersection >= percent * union, from the intersection and the sum of both sizes."""
    return 100 * both >= percent * (sizes - both)


_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                good.append(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y), percent))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def parity_sketches(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per set one bit for each of ``SKETCH`` remainders: is the number of its shingles there odd?"""
    place = np.repeat(np.arange(len(sizes)) * SKETCH, sizes) + (flat & U(SKETCH - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=len(sizes) * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sizes), SKETCH), axis=1).view(U)


def tile_components(sets: list[np.ndarray], side: np.ndarray, root: np.ndarray, percent: int) -> np.ndarray:
    """``root`` (what is one component already) joined further by the links between the two sides."""
    sizes, root, flat = np.array([len(s) for s in sets]), root.copy(), np.concatenate(sets)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    sketch = parity_sketches(flat, sizes)
    _, ids = np.unique(flat, return_inverse=True)
    held = np.zeros(ids.max() + 1, dtype=bool)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for i in left.tolist():
        js = right[root[right] != root[i]]
        js = js[alike(np.minimum(sizes[js], sizes[i]), sizes[js] + sizes[i], percent)]
        apart = np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        js = js[(100 + percent) * apart <= (100 - percent) * (sizes[js] + sizes[i])]
        if not len(js):
            continue
        mine = ids[begin[i] : begin[i + 1]]
        held[mine] = True
        both = np.array([np.count_nonzero(held[ids[begin[j] : begin[j + 1]]]) for j in js.tolist()])
        held[mine] = False
        for j in js[alike(both, sizes[js] + sizes[i], percent)].tolist():
            a, b = root[i], root[j]
            if a != b:
                root[root == max(a, b)] = min(a, b)
    return root


def _tiles(percent: int):
    """Per tile how the components of its classes join."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "x", "y", "side", "doc", "c"], kind="stable")
        key, side, before = pdf[["k", "x", "y"]].to_numpy(), pdf.side.to_numpy(), pdf.root.to_numpy()
        sets = [np.frombuffer(s, U) for s in pdf.s]
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
        found = set()
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            after = tile_components(sets[i:j], side[i:j], before[i:j], percent)
            found.update(zip(before[i:j].tolist(), after.tolist(), strict=True))
        out = np.array([p for p in found if p[0] != p[1]], dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": out[:, 0], "v": out[:, 1]})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(id, n_shingles long, component_id, kept boolean) for every row of ``docs``.

    Words: ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case; the set:
    distinct ``shingle``-word shingles, of a text with fewer words the whole
    sequence.  Two documents are linked if ``percent`` of their sets' union is
    in both.  ``component_id`` is the smallest id reachable over links, the
    row's own included, ``kept`` tells whether it is the row's own.  Null,
    empty and wordless texts have the empty set and link to nothing.  Rows
    that share an id are one document, each with its own ``n_shingles``.  A row
    without an id takes part in no comparison and has neither a component nor
    a place among the kept (both null).
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    base = materialise(d.mapInArrow(_signed(shingle), "doc long, c long, c2 long, n long, bands array<long>"), "signed")
    signed = base.where("doc is not null and n > 0")
    classes = materialise(signed.groupBy("c", "c2").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands")), "set-classes")

    keys = classes.select(F.explode("bands").alias("k"), "doc", "c", "n")
    centres = keys.groupBy("k").agg(F.min(F.struct("doc", "c", "n")).alias("x"), F.count("*").alias("held")).where("held > 1").select("k", "held", F.col("x.doc").alias("doc0"), F.col("x.c").alias("c0"), F.col("x.n").alias("n0"))
    buckets = materialise(keys.join(fresh(centres, "k"), "k"), "buckets")

    def sets_of(wanted: DataFrame, label: str) -> DataFrame:
        """(doc, c, s): the shingle sets of the wanted (doc, c), from their texts; only sets are shuffled."""
        wanted = materialise(wanted.distinct(), "wanted")
        rows = d.where("doc is not null").withColumn("b", F.pmod(F.xxhash64("doc"), F.lit(FILTER)))
        made = rows.mapInArrow(_sets(shingle, _filter_of(wanted)), "doc long, c long, s binary")
        return materialise(made.join(wanted, ["doc", "c"], "left_semi").dropDuplicates(["doc", "c"]), label)

    # The smaller set can be the intersection at most, so sizes rule out pairs before any set is read.
    sized = 100 * F.least("n", "n0") >= percent * F.greatest("n", "n0")
    stars = materialise(buckets.where("doc <> doc0").where(sized).select("doc0", "c0", "doc", "c").distinct(), "stars")
    ends = F.explode(F.array(F.struct("doc", "c"), F.struct(F.col("doc0").alias("doc"), F.col("c0").alias("c"))))
    sets = sets_of(stars.select(ends.alias("e")).select("e.doc", "e.c"), "sets")
    first = sets.select(F.col("doc").alias("doc0"), F.col("c").alias("c0"), F.col("s").alias("a"))
    both = fresh(stars, "doc0", "doc").join(first, ["doc0", "c0"]).join(sets.select("doc", "c", F.col("s").alias("b")), ["doc", "c"])
    found = materialise(both.select(F.col("doc0").alias("u"), F.col("doc").alias("v"), "a", "b").mapInArrow(_verified(percent), "u long, v long"), "similar")
    discard(sets, stars)

    roots = materialise(smallest_reachable(found), "roots")
    several = buckets.where("held > 2").select("k", "doc", "c", "doc0")
    placed = several.join(fresh(roots, "node"), F.col("doc") == F.col("node"), "left").select("k", "doc", "c", "doc0", F.coalesce("root", "doc").alias("root"))
    other = fresh(roots.withColumnsRenamed({"node": "node0", "root": "root0"}), "node0")
    placed = placed.join(other, F.col("doc0") == F.col("node0"), "left").select("k", "doc", "c", "root", (F.col("root") != F.coalesce("root0", "doc0")).alias("apart"))
    placed = materialise(placed, "placed")
    discard(buckets)
    cells = placed.groupBy("k").agg(F.ceil(F.count_if("apart") / CELL).cast("int").alias("mx"), F.ceil(F.count("*") / CELL).cast("int").alias("my")).where("mx > 0")
    opened = materialise(placed.join(fresh(cells, "k"), "k"), "opened")
    discard(placed)
    sets = sets_of(opened.select("doc", "c"), "sets")
    cell = F.xxhash64("doc", "c")
    across = opened.where("apart").select("k", F.pmod(cell, F.col("mx")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("my") - 1)).alias("y"), F.lit(0).alias("side"), "doc", "c", "root")
    along = opened.select("k", F.explode(F.sequence(F.lit(0), F.col("mx") - 1)).alias("x"), F.pmod(cell, F.col("my")).cast("int").alias("y"), F.lit(1).alias("side"), "doc", "c", "root")
    tiles = across.unionByName(along)
    groups = max(1, -(-tiles.count() // GROUP))
    tiles = tiles.join(sets, ["doc", "c"]).withColumn("g", F.pmod(F.xxhash64("k", "x", "y"), F.lit(groups)))
    found = found.unionByName(materialise(tiles.groupBy("g").applyInPandas(_tiles(percent), "u long, v long"), "similar"))
    discard(opened, sets)

    # An id with several texts is one document: its texts' classes are linked through it.
    shared = signed.groupBy("doc").agg(F.min(F.struct("c", "c2")).alias("a"), F.max(F.struct("c", "c2")).alias("b")).where("a <> b").select("doc")
    bridges = signed.join(shared, "doc").join(classes.select("c", "c2", F.col("doc").alias("v")), ["c", "c2"]).select(F.col("doc").alias("u"), "v")
    whole = smallest_reachable(found.unionByName(bridges))
    heads = classes.join(whole, F.col("doc") == F.col("node"), "left").select("c", "c2", F.coalesce("root", "doc").alias("component_id"))
    out = base.select("doc", "c", "c2", "n").join(heads, ["c", "c2"], "left")
    if not shared.isEmpty():
        # A row of its document's other component, as an empty text of a linked id, goes by the document.
        least = out.where("doc is not null").groupBy("doc").agg(F.min("component_id").alias("least"))
        out = out.join(least, "doc", "left").withColumn("component_id", F.coalesce("least", "component_id")).drop("least")
    own = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), (own == F.col("doc")).alias("kept"))
