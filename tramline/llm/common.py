"""Shared plumbing: tables in the shared folder, Arrow batches in bounded slices, salts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.shared import fresh_path, removed
from tramline.shared import written as materialize

__all__ = ["column", "fresh_path", "hashed_fold", "let", "materialize", "removed", "salt", "slices"]

#: Python-side working set: rows are handled in slices of about so many bytes of text.
SLICE_BYTES = 4 << 20
#: A key's rows are spread over so many sub-keys before they meet.
SALTS = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once a row and hand it to body; a lambda that mentions value itself would redo it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Sub-batches of about `limit` bytes in column `text`, with its values as UTF-8 bytes (null: empty)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        start = size = 0
        lens = pc.binary_length(col).to_pylist()
        for i, n in enumerate(lens):
            size += n or 0
            if size >= limit or i + 1 == len(lens):
                part = batch.slice(start, i + 1 - start)
                raw = part.column(part.schema.get_field_index(text))
                kind = pa.large_binary() if pa.types.is_large_string(raw.type) else pa.binary()
                yield part, [x or b"" for x in raw.cast(kind).to_pylist()]
                start, size = i + 1, 0


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def salt(*cols: str, n: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def hashed_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
