"""Arrow helpers for the operators that run in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

CHUNK_BYTES = 1 << 19


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) in pieces of about ``limit`` bytes; null counts as empty.

    Bounds what a worker holds: a piece is larger only if one text alone is.
    """
    values = batch.column(column)
    if not pa.types.is_binary(values.type):
        values = values.cast(pa.binary())
    first, held, size = 0, [], 0
    for i, value in enumerate(values):
        b = value.as_py() or b""
        if held and size + len(b) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield first, held


class Rows:
    """Gathers column chunks and hands them out as record batches of bounded length."""

    def __init__(self, schema: pa.Schema, target: int = 50_000) -> None:
        self.schema, self.target, self.parts, self.n = schema, target, [], 0

    def add(self, *columns) -> Iterator[pa.RecordBatch]:
        arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, self.schema, strict=True)]
        if len(arrays[0]):
            self.parts.append(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
            self.n += len(arrays[0])
        if self.n >= self.target:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from pa.Table.from_batches(self.parts).combine_chunks().to_batches()
        self.parts, self.n = [], 0
