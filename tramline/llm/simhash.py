"""SimHash near-duplicates through vantage-point trees.

Fingerprints are compared by Hamming distance. Two fingerprints within `radius`
bits differ by at most radius // 2 bits in one of their two 32-bit halves, and
the distance on a half is a metric too. So there is one vantage-point tree per
half, searched with that smaller radius: a node holds a vantage point v and a
threshold mu, and splits by d(x, v) <= mu. By the triangle inequality two points
within r of each other can only be parted where the outer one has
d <= mu + r; only such boundary points visit the inner shard as guests, all other
branches are pruned. Each leaf is a shard of the exact comparison over all 64
bits. A shard over `chunk` rows is dealt out as pairs of blocks, so no task ever
holds an unbounded group, and every task returns a spanning forest of its links,
never all pairs.

Nulls: a null text is an empty text; its fingerprint is zero and is linked like
any other. A row with a null id gets the component of its fingerprint, but names
none and links none (null if all its copies are so). Repeated rows share a
fingerprint and therefore a component. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import column, materialize, salt, slices
from tramline.operators import components as connected

HALVES = 2
#: The tree is laid out from about so many fingerprints (8 bytes each), at most this share of all.
SAMPLE, SHARE = 60_000, 0.125
#: Fingerprints a leaf is meant to hold, and the largest depth: 2 ** MAX_DEPTH leaves bound every table of leaves.
LEAF, MAX_DEPTH = 1_000, 14
#: Rows of a block; a task compares two blocks.
CHUNK = 8_192


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 values of all word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id_col, fp): fp holds the 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            fps = np.fromiter((fingerprint(t, width, seed) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(fps)], ["id", "fp"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")
    return out.withColumnRenamed("id", id_col)


class VantageTrees:
    """One complete binary tree per half, in heap order; laid out once on the driver from a bounded sample."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int, seed: int = 7):
        self.depth, self.radius = depth, radius // HALVES
        rng = np.random.default_rng(seed)
        self.vp = np.zeros((HALVES, max(1, 2**depth - 1)), np.uint32)
        self.mu = np.full(self.vp.shape, 32, np.int16)
        for h in range(HALVES):
            self._split(h, 0, self.half(sample, h), rng)

    @staticmethod
    def half(fps: np.ndarray, h: int) -> np.ndarray:
        return (fps >> np.uint64(32 * h)).astype(np.uint32)

    def _split(self, h: int, node: int, x: np.ndarray, rng: np.random.Generator) -> None:
        if node >= 2**self.depth - 1:
            return
        best = None
        some = x if len(x) <= 4096 else rng.choice(x, 4096, replace=False)
        for _ in range(12):
            v = rng.integers(0, 2**32, dtype=np.uint32) if not len(some) or rng.random() < 0.5 else rng.choice(some)
            share = np.bincount(np.bitwise_count(some ^ v), minlength=40)[:40] / max(1, len(some))
            inner = np.cumsum(share)
            near = np.array([share[max(0, m + 1 - self.radius) : m + self.radius + 1].sum() for m in range(33)])
            cost = near + np.abs(inner[:33] - 0.5)
            m = int(np.argmin(cost)) if len(some) else 16
            if best is None or cost[m] < best[0]:
                best = (cost[m], v, m)
        _, self.vp[h, node], self.mu[h, node] = best
        inside = np.bitwise_count(x ^ self.vp[h, node]) <= self.mu[h, node]
        self._split(h, 2 * node + 1, x[inside], rng)
        self._split(h, 2 * node + 2, x[~inside], rng)

    def visit(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each half: (half, row, leaf, home): the leaf each row lives in, and those it visits as a guest."""
        for h in range(HALVES):
            x, r = self.half(fps, h), self.radius
            row, node, home = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
            for _ in range(self.depth):
                gap = np.bitwise_count(x[row] ^ self.vp[h, node]).astype(np.int16) - self.mu[h, node]
                # Every row within the bound goes in, as a guest if it lives outside; only guests come out again.
                inner, outer = gap <= r, np.where(home, gap > 0, gap > -r)
                row, node, home = (
                    np.concatenate([row[inner], row[outer]]),
                    np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2]),
                    np.concatenate([(home & (gap <= 0))[inner], home[outer]]),
                )
            yield h, row, node - (2**self.depth - 1), home


def forest(codes: np.ndarray, n_home: int, radius: int) -> np.ndarray:
    """Smallest index reachable over links that have an end among the first n_home codes."""
    label, all_codes = np.arange(len(codes)), codes
    step = max(1, (1 << 21) // max(1, len(codes)))
    for i in range(0, n_home, step):
        a, b = np.nonzero(np.bitwise_count(all_codes[i : min(i + step, n_home), None] ^ all_codes[None, :]) <= radius)
        a += i
        while True:
            la, lb = label[a], label[b]
            if (la == lb).all():
                break
            low = np.minimum(la, lb)
            np.minimum.at(label, la, low)
            np.minimum.at(label, lb, low)
            while not (label == (up := label[label])).all():
                label = up
    return label


def links(reps: DataFrame, radius: int = 3, n: int | None = None, by: str | None = None, kinds: int = 1) -> DataFrame:
    """(a, b), a > b: links that span every group of `reps` (rep, fp; distinct fps) within `radius` bits.

    by: an int column of `kinds` values; fingerprints are compared with those of the same kind, in one tree's leaves of their own.
    """
    own = [by] if by else []
    spark = reps.sparkSession
    n = reps.count() if n is None else n
    depth = int(np.clip(np.ceil(np.log2(max(1, n) / kinds / LEAF)), 0, MAX_DEPTH))
    part = min(SHARE, SAMPLE / max(1, n))
    some = reps.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 30)) < int(part * (1 << 30))).select("fp").toPandas()
    trees = spark.sparkContext.broadcast(VantageTrees(np.sort(some["fp"].to_numpy(np.int64)).view(np.uint64), depth, radius))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trees.value
        for batch in batches:
            for i in range(0, batch.num_rows, 20_000):
                fp, rep = (column(batch, c).slice(i, 20_000).to_numpy(zero_copy_only=False) for c in ("fp", "rep"))
                for h, row, leaf, home in tree.visit(fp.astype(np.int64).view(np.uint64)):
                    kind = [column(batch, c).slice(i, 20_000).take(pa.array(row)) for c in own]
                    yield pa.RecordBatch.from_arrays([pa.array((leaf + h * 2**MAX_DEPTH).astype(np.int32)), pa.array(home), pa.array(fp[row].astype(np.int64)), pa.array(rep[row].astype(np.int64)), *kind], ["leaf", "home", "fp", "rep", *own])

    dealt = materialize(reps.select("fp", "rep", *own).mapInArrow(deal, "leaf int, home boolean, fp bigint, rep bigint" + "".join(f", {c} int" for c in own)), "op1-leaves")
    # At most HALVES * 2 ** MAX_DEPTH rows of 8 bytes a kind: small enough to send to every executor.
    blocks = dealt.groupBy("leaf", *own).agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        dealt.join(F.broadcast(blocks), ["leaf", *own])
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("leaf", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "home", "fp", "rep", *own)
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("home", ascending=False, kind="stable")
        rep = pdf["rep"].to_numpy(np.int64)
        label = forest(pdf["fp"].to_numpy(np.int64).view(np.uint64), int(pdf["home"].sum()), radius)
        a, b = rep, rep[label]
        keep = a != b
        return pd.DataFrame({"a": np.maximum(a, b)[keep], "b": np.minimum(a, b)[keep]})

    return dealt.groupBy("leaf", *own, "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has an edge (a, b) and is not the smallest itself."""
    found = connected.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.where("node <> component").select("node", F.col("component").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(id, fingerprint, component_id): fingerprints link at `radius` or fewer differing bits.

    component_id is the smallest id reachable over links, the row's own included.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width), "op1-fingerprints").withColumn("salt", salt(id_col))
    salted = fps.groupBy("fp", "salt").agg(F.min(id_col).alias("rep"))
    reps = materialize(salted.groupBy("fp").agg(F.min("rep").alias("rep")), "op1-classes")
    roots = components(links(reps.where("rep is not null"), radius))
    classes = reps.join(roots, reps["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    classes = salted.select("fp", "salt").join(classes, "fp")
    return fps.join(classes, ["fp", "salt"]).select(F.col(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
