"""Bounded-space online packing of token sequences.

A document's ids plus the end id are cut into pieces of `size`; full pieces are
sequences of their own. Each remainder goes to the open window of its partition
that it fits best. At most `windows` are open at a time: when none fits and all
are open, the fullest is emitted. What is left open at a partition's end is merged
with the leftovers of up to `merge` partitions, by best fit again, so no task
holds more than merge * windows of them. Nothing is sorted and no text moves.

Nulls: a null text is an empty text, a document of the end id alone; null ids are
carried. Repeated rows are packed as often as they occur. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import column, materialize, slices
from tramline.llm.tokens import shared_words

SIZE, WINDOWS, MERGE, END = 2048, 64, 64, 1
PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, seq bigint, offset bigint, fill bigint, left_open boolean"


class Windows:
    """Open windows by fill; offer() returns the windows that it closes, as (seq, fill, items)."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.next, self.open, self.fills = size, most, 0, {}, []

    def offer(self, length: int, item: object) -> list[tuple[int, int, list]]:
        closed = []
        # The fullest that still has room: the largest fill up to size - length.
        at = bisect_left(self.fills, (self.size - length + 1,)) - 1
        if at >= 0:
            fill, seq = self.fills.pop(at)
        else:
            if len(self.fills) >= self.most:
                full, out = self.fills.pop()
                closed.append((out, full, self.open.pop(out)))
            fill, seq = 0, self.number()
            self.open[seq] = []
        self.open[seq].append((fill, item))
        if fill + length == self.size:
            closed.append((seq, self.size, self.open.pop(seq)))
        else:
            insort(self.fills, (fill + length, seq))
        return closed

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def rest(self) -> list[tuple[int, int, list]]:
        return [(seq, fill, self.open[seq]) for fill, seq in self.fills]


def pieces(docs: DataFrame, id_col: str, text_col: str, size: int, windows: int, end: int, tokenizer: str | None) -> DataFrame:
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, space, rows = shared_words(tokenizer), TaskContext.get().partitionId(), Windows(size, windows), []
        id_type = None

        def put(closed: list, left: bool = False) -> None:
            for seq, fill, items in closed:
                rows.extend((*item, part, seq, offset, fill, left) for offset, item in items)

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 10
            rows.clear()
            kinds = [id_type or pa.int64(), *[pa.int64()] * 4, pa.int32(), *[pa.int64()] * 3, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", *(x.split()[0] for x in PIECE.split(", "))])

        for sub, texts in slices(batches, "text", 1 << 20):
            id_type = column(sub, "id").type
            for key, found in zip(column(sub, "id").to_pylist(), map(ids.encode, texts), strict=True):
                data = memoryview(found + tail)
                total = len(data) // 4
                for start in range(0, total, size):
                    here = data[4 * start : 4 * (start + size)]
                    item = (key, start, n := len(here) // 4, zlib.crc32(here), total)
                    put([(space.number(), size, [(0, item)])] if n == size else space.offer(n, item))
            if len(rows) >= 5_000:
                yield batch()
        put(space.rest(), left=True)
        if rows:
            yield batch()

    return source.mapInArrow(run, f"id {kind}, {PIECE}")


def merged(left: DataFrame, size: int, merge: int) -> DataFrame:
    """(part, seq, to_part, to_seq, shift, total): where each leftover window goes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "part", "seq"], ascending=[False, True, True])
        space, out = Windows(size, len(pdf)), []
        for part, seq, fill in pdf[["part", "seq", "fill"]].itertuples(index=False):
            out += space.offer(int(fill), (part, seq))
        rows = [(p, s, *items[0][1], shift, total) for _, total, items in out + space.rest() for shift, (p, s) in items]
        return pd.DataFrame(rows, columns=["part", "seq", "to_part", "to_seq", "shift", "total"])

    keyed = left.select("part", "seq", "fill").distinct().withColumn("bin", F.floor(F.col("part") / merge))
    return keyed.groupBy("bin").applyInPandas(run, "part int, seq bigint, to_part int, to_seq bigint, shift bigint, total bigint")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, windows: int = WINDOWS, merge: int = MERGE, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_tokens), a row for each piece.

    A sequence is padded to `size`, except where its tokens are a power of two.
    """
    cut = materialize(pieces(docs, id_col, text_col, size, windows, end, tokenizer), "op5-pieces")
    number = lambda part, seq: F.col(part).cast("bigint") * F.lit(1 << 32) + F.col(seq)
    plain = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    closed = cut.where(~F.col("left_open")).select(*plain, number("part", "seq").alias("sequence_id"), "offset", F.col("fill").alias("sequence_tokens"))
    left = cut.where("left_open")
    moved = left.join(merged(left, size, merge), ["part", "seq"]).select(*plain, number("to_part", "to_seq").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"), F.col("total").alias("sequence_tokens"))
    padded = F.when(F.expr("sequence_tokens & (sequence_tokens - 1)") == 0, F.col("sequence_tokens")).otherwise(F.lit(size).cast("bigint"))
    return closed.unionByName(moved).withColumn("padded_tokens", padded).withColumnRenamed("id", id_col)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
