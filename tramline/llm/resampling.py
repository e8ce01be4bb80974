"""Importance resampling towards a target distribution of hashed word n-grams.

Features of a text are its runs of 1 to `width` words; each falls into the bucket given by
the CRC-32 of its bytes. A bucket's gain says how much likelier it is among the target
texts than among all documents, a document's weight is its features' mean gain, and keyed
Gumbel noise turns weights into a draw without replacement: the highest scores win.

Counting and scoring go through word tries that live in a partition. A node stands for a
run of words; it holds how often the run occurred, the state of the CRC after its bytes,
from which its children's states follow without reading those bytes again (a CRC of joined
strings is linear in the two CRCs), and, when scoring, its bucket's gain. Nodes are kept in
arrays, level by level, and a block of texts walks its words' paths all at once. Counting
hands on a partition's bucket totals only, which Spark merges; a trie that has grown to
`NODES` nodes hands on its totals and starts anew. The gains, one integer a bucket, go to all
executors: `buckets` integers, whatever the corpus. Ranks come from one range-partitioned
sort, whose partitions are numbered on from each other's sizes.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. Nulls: a null
text has no words, weight 0 and is never drawn; a null id draws its noise as an empty id.
Repeated rows are documents of their own and take ranks side by side. Very long texts count
whole. No target texts, or no documents: counts of zero, gains as the formula gives them;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.common import column, materialize, slices

BUCKETS, WIDTH, LEAST_WORDS, SHARE, SEED = 10_000, 2, 20, 25, 7
#: A trie of so many nodes hands on its totals and starts anew (about 40 bytes a node, 150 a distinct word).
NODES = 1_000_000
#: Bytes of a text that are parted into words at a time.
BLOCK = 1 << 20
#: A-Z lower-cased; ASCII other than letters and digits becomes a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _zeros_after(n: int) -> np.ndarray:
    """What n zero bytes make of a CRC register, as four tables of 256 by the register's bytes."""
    single = np.array([zlib.crc32(bytes(n), 1 << bit) ^ zlib.crc32(bytes(n)) for bit in range(32)], np.uint32)
    codes = np.arange(256)
    return np.stack([np.bitwise_xor.reduce(np.where(codes[:, None] >> np.arange(8) & 1, single[8 * k : 8 * k + 8], np.uint32(0)).astype(np.uint32), axis=1) for k in range(4)])


class Shift(dict):
    """Length of a string -> tables that bring a CRC past so many bytes."""

    def __missing__(self, n: int) -> np.ndarray:
        found = self[n] = _zeros_after(n)
        return found

    def joined(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRCs of strings that begin with ones of CRC `first` and go on with ones of CRC `second` and `length` bytes."""
        out = second.copy()
        for n in np.unique(length):
            at, tables = np.nonzero(length == n)[0], self[int(n)]
            if len(self) > 512:
                self.clear()
            state = first[at]
            for k in range(4):
                out[at] ^= tables[k][state >> np.uint32(8 * k) & np.uint32(255)]
        return out


class Level:
    """The nodes of one depth: sorted keys (parent's number, word), each with its number, count and CRC state."""

    def __init__(self):
        self.keys, self.numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.state, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64)


class Trie(dict):
    """word (bytes) -> its number, and levels of nodes for runs of 1 to `width` words. A node's number is its place in `state` and `count`."""

    def __init__(self, width: int = WIDTH):
        super().__init__()
        self.width, self.shift = width, Shift()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.spelled: list[bytes] = []
        self.alone, self.after, self.length = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.levels = [Level() for _ in range(self.width)]

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        self.spelled.append(word)
        return found

    @property
    def nodes(self) -> int:
        return sum(len(level.count) for level in self.levels)

    def _numbers(self, text: bytes) -> np.ndarray:
        """The numbers of a text's words, of which one block at a time is in hand."""
        text, begin, out = text.translate(_WORDS), 0, [np.zeros(0, np.int64)]
        while begin < len(text):
            end = text.find(b" ", begin + BLOCK)
            words = text[begin : end if end >= 0 else len(text)].split()
            out.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
            begin = end if end >= 0 else len(text)
        return np.concatenate(out)

    def _spell(self) -> None:
        """CRCs of new words, alone and behind a space."""
        if self.spelled:
            self.alone = np.append(self.alone, np.array([zlib.crc32(w) for w in self.spelled], np.uint32))
            self.after = np.append(self.after, np.array([zlib.crc32(b" " + w) for w in self.spelled], np.uint32))
            self.length = np.append(self.length, np.array([len(w) + 1 for w in self.spelled], np.int64))
            self.spelled = []

    def walk(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Goes the paths of all runs of words of texts and adds nodes where there are none.

        For each level: the nodes walked over, one a run, and the runs' texts; last, the texts' numbers of words.
        """
        numbers = [self._numbers(t) for t in texts]
        sizes = np.array([len(n) for n in numbers], np.int64)
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        self._spell()
        owner, at, parent = np.repeat(np.arange(len(texts)), sizes), np.arange(len(flat)), np.full(len(flat), -1, np.int64)
        walked, owners = [], []
        for depth, level in enumerate(self.levels):
            # A run of depth words goes on where its text has a next word.
            if depth:
                follows = np.nonzero(at + depth < len(flat))[0]
                follows = follows[owner[at[follows]] == owner[at[follows] + depth]]
                at, parent = at[follows], parent[follows]
            node = self._reach(level, parent, flat[at + depth])
            walked.append(node)
            owners.append(owner[at])
            parent = node
        return walked, owners, sizes

    def _reach(self, level: Level, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        distinct, back, times = np.unique((parent + 1) << 32 | word, return_inverse=True, return_counts=True)
        place = np.searchsorted(level.keys, distinct)
        there = np.zeros(len(distinct), bool)
        inside = place < len(level.keys)
        there[inside] = level.keys[place[inside]] == distinct[inside]
        number = np.empty(len(distinct), np.int64)
        number[there] = level.numbers[place[there]]
        new, n = distinct[~there], len(level.count)
        if len(new):
            number[~there] = np.arange(n, n + len(new))
            tail, root = new & 0xFFFFFFFF, new >> 32 == 0
            state = self.alone[tail].copy()
            if not root.all():
                above = self.levels[self.levels.index(level) - 1].state[(new[~root] >> 32) - 1]
                state[~root] = self.shift.joined(above, self.after[tail[~root]], self.length[tail[~root]])
            level.state, level.count = np.append(level.state, state), np.append(level.count, np.zeros(len(new), np.int64))
            level.keys, level.numbers = np.insert(level.keys, place[~there], new), np.insert(level.numbers, place[~there], number[~there])
        level.count[number] += times
        return number[back.reshape(-1)]

    def totals(self, buckets: int) -> np.ndarray:
        """Occurrences by bucket."""
        out = np.zeros(buckets, np.int64)
        for level in self.levels:
            np.add.at(out, (level.state % np.uint32(buckets)).astype(np.int64), level.count)
        return out


def bucket_totals(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; buckets without any are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = Trie(width), np.zeros(buckets, np.int64)
        for _, raw in slices(batches, "_text"):
            trie.walk(raw)
            if trie.nodes >= NODES:
                total += trie.totals(buckets)
                trie.reset()
        total += trie.totals(buckets)
        held = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    found = texts.select(F.col(text_col).alias("_text")).mapInArrow(run, "bucket int, n bigint")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(of_all: dict[int, int], of_target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """By bucket, the floor of 1,000 times the logarithm of the smoothed shares' ratio."""
    every, wanted = sum(of_all.values()), sum(of_target.values())
    ratio = lambda s, t: (float(t) + 1) * (float(every) + buckets) / ((float(s) + 1) * (float(wanted) + buckets))
    return np.array([math.floor(1000 * math.log(ratio(of_all.get(b, 0), of_target.get(b, 0)))) for b in range(buckets)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_words, n_features, weight)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, gain = Trie(width), shared.value
        attached = [np.zeros(0, np.int64) for _ in range(width)]
        for part, raw in slices(batches, "_text"):
            walked, owners, sizes = trie.walk(raw)
            n, total = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
            for depth, level in enumerate(trie.levels):
                new = level.state[len(attached[depth]) :]
                attached[depth] = np.append(attached[depth], gain[(new % np.uint32(len(gain))).astype(np.int64)])
                n += np.bincount(owners[depth], minlength=len(raw))
                np.add.at(total, owners[depth], attached[depth][walked[depth]])
            weight = np.where(n > 0, np.floor_divide(total, np.maximum(n, 1)), 0)
            yield pa.RecordBatch.from_arrays([column(part, "_id"), pa.array(sizes), pa.array(n), pa.array(weight)], ["_id", "n_words", "n_features", "weight"])
            if trie.nodes >= NODES:
                trie.reset()
                attached = [np.zeros(0, np.int64) for _ in range(width)]

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    fields = [rows.schema["_id"], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))]
    return rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("_id", id_col)


def ranked(rows: DataFrame, *order, name: str = "rank") -> DataFrame:
    """rows with their places 1, 2, 3... in the order given: one range-partitioned sort, written once, and the sizes of its partitions."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The upper bits number the partitions, the lower 33 the rows of each.
    placed = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, inner = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # One row a partition of the sort.
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.select(*rows.columns, (F.col("_before") + inner + 1).alias(name))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, width: int = WIDTH, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank): of the documents of at least `least_words` words, `share` in a hundred are drawn and have a rank."""
    # At most `buckets` rows each.
    of_all, of_target = ({r["bucket"]: r["n"] for r in bucket_totals(t, c, buckets, width).collect()} for t, c in ((docs, text_col), (target, target_col)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weights(docs, gains(of_all, of_target, buckets), id_col, text_col, width)
    scored = materialize(scored.select(F.col(id_col), "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")), "op11-scores")
    enough = F.col("n_words") >= least_words
    able = scored.where(enough)
    drawn = share * able.count() // 100
    places = ranked(able, F.desc("score"), F.asc(id_col))
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("bigint"))
    out = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)
    return out.select(id_col, "n_features", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
