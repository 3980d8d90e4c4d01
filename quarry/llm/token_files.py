"""Token-id files: independent zstandard frames with a trailing seek table.

A shard holds the ids of its documents one after another, little-endian, in
frames of about ``FRAME`` bytes each.  Behind them come two skippable frames:
the directory (zstandard: id width, end id, then per document its id, number of
tokens and whether it has an id) and the seek table of the public seekable format, with a checksum of
each frame's content (low half of XXH64).  A reader needs the tail of the file
and the frames that hold the documents it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import Rows, text_chunks
from quarry.llm.scratch import materialise, scratch_path
from quarry.llm.tokens import encoder

END_ID = 2
FRAME = 1 << 18
LEVEL = 3
#: Fixed values of the seekable format.
_SKIPPABLE, _SEEKABLE, _DIRECTORY = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
_DESCRIPTOR = 0x80  # entries have checksums


class ShardWriter:
    """Writes a shard as a stream; it holds one frame and 13 bytes a document."""

    def __init__(self, sink, end_id: int, width: int) -> None:
        self.sink, self.end_id, self.width = sink, end_id, width
        self.held, self.size, self.seek, self.ids, self.named, self.lengths = [], 0, [], [], [], []
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress

    def add(self, doc: int | None, packed: bytes) -> None:
        """``packed``: little-endian unsigned 32-bit ids, without the end id."""
        ids = np.append(np.frombuffer(packed, dtype="<u4"), np.uint32(self.end_id))
        self.ids.append(0 if doc is None else doc)
        self.named.append(doc is not None)
        self.lengths.append(len(ids))
        raw = ids.astype(f"<u{self.width}").tobytes()
        for i in range(0, len(raw), FRAME):
            self.held.append(raw[i : i + FRAME])
            self.size += len(self.held[-1])
            if self.size >= FRAME:
                self._frame()

    def _frame(self) -> None:
        raw = b"".join(self.held)
        if raw:
            packed = self.compress(raw)
            self.sink.write(packed)
            self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def finish(self) -> int:
        """Ends the shard; the number of its tokens."""
        self._frame()
        lengths = np.array(self.lengths, dtype="<u4")
        directory = self.compress(struct.pack("<BIQ", self.width, self.end_id, len(lengths)) + np.array(self.ids, dtype="<i8").tobytes() + lengths.tobytes() + np.packbits(self.named, bitorder="little").tobytes())
        self.sink.write(struct.pack("<II", _DIRECTORY, len(directory)) + directory)
        entries = b"".join(struct.pack("<III", *e) for e in self.seek)
        # The footer of the format is nine bytes; before it the directory's size, so that a reader finds it from the end.
        footer = struct.pack("<IBI", len(self.seek), _DESCRIPTOR, _SEEKABLE)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        return int(lengths.sum(dtype=np.int64))


class ShardReader:
    """Reads documents of a shard by their place in it; frames are checked and decompressed only where needed."""

    def __init__(self, source) -> None:
        self.source = source
        end = source.size()
        n, descriptor, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != _SEEKABLE or descriptor != _DESCRIPTOR:
            raise ValueError("not a seekable shard")
        table = end - 9 - 12 * n
        self.seek = np.frombuffer(self._at(table, 12 * n), dtype="<u4").reshape(n, 3)
        self.begin = np.concatenate([[0], np.cumsum(self.seek[:, 0], dtype=np.int64)])
        self.raw = np.concatenate([[0], np.cumsum(self.seek[:, 1], dtype=np.int64)])
        head, size = struct.unpack("<II", self._at(int(self.begin[-1]), 8))
        if head != _DIRECTORY:
            raise ValueError("no directory")
        self.decompress = zstandard.ZstdDecompressor().decompress
        directory = self.decompress(self._at(int(self.begin[-1]) + 8, size))
        self.width, self.end_id, docs = struct.unpack_from("<BIQ", directory)
        self.ids = np.frombuffer(directory, dtype="<i8", count=docs, offset=13)
        self.lengths = np.frombuffer(directory, dtype="<u4", count=docs, offset=13 + 8 * docs).astype(np.int64)
        bits = np.frombuffer(directory, dtype=np.uint8, offset=13 + 12 * docs)
        self.named = np.unpackbits(bits, count=docs, bitorder="little").astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.frame: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def _raw_frame(self, k: int) -> bytes:
        if self.frame[0] != k:
            raw = self.decompress(self._at(int(self.begin[k]), int(self.seek[k, 0])), max_output_size=int(self.seek[k, 1]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.frame = (k, raw)
        return self.frame[1]

    def document(self, place: int) -> np.ndarray:
        """Ids of the document, its end id included, as unsigned 32-bit integers."""
        lo, hi = int(self.starts[place]) * self.width, int(self.starts[place + 1]) * self.width
        k, parts = int(np.searchsorted(self.raw, lo, side="right")) - 1, []
        while lo < hi:
            base = int(self.raw[k])
            parts.append(self._raw_frame(k)[lo - base : hi - base])
            lo, k = base + int(self.seek[k, 1]), k + 1
        return np.frombuffer(b"".join(parts), dtype=f"<u{self.width}").astype("<u4")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


_SHARDS = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])


def _write(folder: str, tokenizer: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode
        # Each attempt writes a file of its own; the table of shards names those that count.
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tokens"
        sink = writer = None
        for batch in batches:
            ids = batch.column("doc")
            for first, texts in text_chunks(batch):
                if writer is None:
                    fs, name = _open(path)
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(name)
                    writer = ShardWriter(sink, end_id, width)
                for i, b in enumerate(texts, first):
                    writer.add(ids[i].as_py(), encode(b.decode()))
        if writer is not None:
            tokens = writer.finish()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "docs": [len(writer.ids)], "tokens": [tokens]}, schema=_SHARDS)

    return run


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes the shards in ascending id order and returns their table (shard, path, docs, tokens).

    Null and empty texts are the end id alone; rows that share an id follow one
    another by text; rows with a null id come first and have none in the file.
    ``folder`` is a URI that all executors reach; by default a new one in the
    shared scratch folder.  As many shards as the input has partitions.
    """
    folder = folder or scratch_path(docs.sparkSession, "token-shards")
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    n = max(1, d.rdd.getNumPartitions())
    ordered = d.repartitionByRange(n, "doc").sortWithinPartitions("doc", "text")
    return materialise(ordered.mapInArrow(_write(folder, tokenizer, end_id, width), "shard long, path string, docs long, tokens long"), "token-manifest")


_READ = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Rows(_READ)
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            fs, name = _open(path)
            with fs.open_input_file(name) as source:
                reader = ShardReader(source)
                crc = [zlib.crc32(reader.document(k).tobytes()) for k in range(len(reader.ids))]
            yield from out.add(pa.array(reader.ids, mask=~reader.named), base + reader.starts[:-1], reader.lengths, crc)
    yield from out.rest()


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) of every document in the shards; ``start``: ids of all documents before it."""
    spark = shards.sparkSession
    rows, base, placed = sorted(tuple(r) for r in shards.collect()), 0, []  # one row a shard
    for _, path, _, tokens in rows:
        placed.append((path, base))
        base += tokens
    table = spark.createDataFrame(placed, "path string, base long").repartition(max(1, len(placed)))
    return table.mapInArrow(_read, "doc long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` as shards and returns what reading them back gives, under the id column's name."""
    return read_documents(write_shards(docs, tokenizer, None, id_col, text_col, end_id)).withColumnRenamed("doc", id_col)
