"""Near copies by word shingles: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come by op1's method. Texts with equal sets are one class. Each class has
several 64-bit SimHash fingerprints: one over all its shingles, the others each over a
sample of TAKEN of them, drawn alike for all texts (those of the smallest keyed hashes).
One over all shingles strays too far at 0.8 for triangle bounds to prune, one over a
sample is the same in two texts whose samples are: at 0.8 a pair agrees in none of the
SAMPLES with a probability of 1 in 10,000, less above. Equal fingerprints are one, and
distinct ones go through op1's vantage-point trees, those over all shingles within
RADIUS bits, those over samples within SAMPLE_RADIUS.

All links are inside the connected parts of the candidates, so the sets of a part meet,
and similarity is taken exactly. In a part over CHUNK classes, such as passages chain
together that many texts share, only those meet whose fingerprints of a kind are
connected: a set is in as many rows as it has kinds in which it is a candidate, whatever the part, and
only a group of over CHUNK classes is dealt out as pairs of blocks. Every task returns a
spanning forest of its links, never all pairs. Shingles are compared by a 64-bit hash of
their words.

A text under five words is one shingle; null, empty and blank texts are one class.
A row with a null id gets the component of its class, but names none and links none
(null if the whole class is so). Rows that share an id are linked. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import column, materialize, salt, slices
from tramline.llm.simhash import components
from tramline.llm.simhash import links as near_prints
from tramline.llm.suffix_tree import STEP, Hashes

WIDTH, LEAST = 5, 0.8
#: Fingerprints over samples, shingles of a sample, and bits within which fingerprints over all shingles and over samples are candidates.
SAMPLES, TAKEN, RADIUS, SAMPLE_RADIUS = 24, 5, 3, 1
#: Classes of a block; a task compares two blocks.
CHUNK = 4_096
_RNG = np.random.default_rng(13)
_TIMES = _RNG.integers(0, 2**64, SAMPLES * TAKEN, np.uint64) | np.uint64(1)
_PLUS = _RNG.integers(0, 2**64, SAMPLES * TAKEN, np.uint64)
#: Fingerprints of each kind are turned by a constant of their own, which leaves their distances alone and tells the kinds apart.
_KIND = _RNG.integers(0, 2**64, SAMPLES + 1, np.uint64)


def shingles(text: bytes, hashes: Hashes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    found = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        found = found * STEP + h[k : k + n]
    found ^= found >> np.uint64(31)
    return np.unique(found * np.uint64(0xBF58476D1CE4E5B9))


def digest(found: np.ndarray) -> int:
    """A signed long that stands for the set."""
    return xxhash.xxh64_intdigest(found.tobytes(), 5) - (1 << 63)


def majority(hashes: np.ndarray) -> np.ndarray:
    """SimHash over the last axis: a bit is 1 if it is set in over half of the hashes."""
    bits = np.unpackbits(hashes[..., None].view(np.uint8), axis=-1)
    ones = bits.sum(axis=-2, dtype=np.uint8 if hashes.shape[-1] < 256 else np.int64)
    return np.packbits(ones > hashes.shape[-1] // 2, axis=-1).view(np.uint64)[..., 0]


def whole_print(found: np.ndarray) -> np.uint64:
    """The SimHash of all shingles, in stretches that a byte can count."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 255):
        ones += np.unpackbits(found[i : i + 255, None].view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(found)).view(np.uint64)[0]


def prints(sets: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of each set, a row a set: over all shingles, then over every sample."""
    out = np.zeros((len(sets), SAMPLES + 1), np.uint64)
    for start in range(0, len(sets), 500):
        some = sets[start : start + 500]
        low = np.full((len(some), SAMPLES * TAKEN), np.iinfo(np.uint64).max, np.uint64)
        for row, found in zip(low, some, strict=True):
            for i in range(0, len(found), 2_048):
                np.minimum(row, (_TIMES[:, None] * found[i : i + 2_048] + _PLUS[:, None]).min(axis=1), out=row)
        # The smallest keyed hash stands for its shingle; its bits are mixed, as its high ones are all 0.
        low = (low ^ (low >> np.uint64(29))) * STEP
        low = (low ^ (low >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        low ^= low >> np.uint64(31)
        out[start : start + len(some), 0] = [whole_print(s) for s in some]
        out[start : start + len(some), 1:] = majority(low.reshape(len(some), SAMPLES, TAKEN))
    return (out ^ _KIND).view(np.int64)


def similar(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """The smallest index reachable over links."""
    label, left = np.full(len(sets), -1), np.arange(len(sets))
    size = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    ends = np.cumsum(size)
    codes = [flat[e - n : e] for e, n in zip(ends, size, strict=True)]
    mark = np.zeros(len(flat) + 1, bool)
    while len(left):
        root, todo, left = left[0], [left[0]], left[1:]
        label[root] = root
        while todo and len(left):
            a = todo.pop()
            near = left[(size[left] >= least * size[a]) & (size[a] >= least * size[left]) & (size[left] > 0)]
            if not len(near):
                continue
            mark[codes[a]] = True
            both = np.add.reduceat(mark[np.concatenate([codes[b] for b in near])], np.concatenate([[0], np.cumsum(size[near])[:-1]]), dtype=np.int64)
            mark[codes[a]] = False
            near = near[both >= least * (size[a] + size[near] - both) - 1e-9]
            label[near] = root
            todo += near.tolist()
            left = left[label[left] < 0]
    return label


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, component_id): component_id is the smallest id reachable over links, the row's own included."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for part, texts in slices(batches, "text"):
            sets = [shingles(t, hashes) for t in texts]
            yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array([digest(s) for s in sets], pa.int64()), pa.array(list(prints(sets)), pa.list_(pa.int64()))], ["id", "class", "prints"])

    rows = materialize(source.mapInArrow(sign, f"id {kind}, class bigint, prints array<bigint>"), "copies-rows").withColumn("salt", salt("id"))
    salted = rows.groupBy("class", "salt").agg(F.min("id").alias("rep"), F.min("prints").alias("prints"))
    classes = materialize(salted.groupBy("class").agg(F.min("rep").alias("rep"), F.min("prints").alias("prints")), "copies-classes")
    printed = classes.where("rep is not null").select("class", F.posexplode("prints").alias("kind", "fp"))
    distinct = materialize(printed.groupBy("kind", "fp").agg(F.min("class").alias("b"), F.count("*").alias("n")), "copies-prints")
    reps = distinct.select("kind", "fp", F.col("fp").alias("rep"))
    near = near_prints(reps.where("kind = 0"), RADIUS).union(near_prints(reps.where("kind > 0"), SAMPLE_RADIUS, by="kind", kinds=SAMPLES))
    near = components(near).withColumnRenamed("node", "fp")
    near = materialize(near.union(near.select(F.col("root").alias("fp"), "root").distinct()), "copies-near")
    # Fingerprints that several classes have, or that a tree linked, by groups.
    shared = materialize(distinct.join(near, "fp", "left").where("n > 1 or root is not null").select("fp", F.coalesce("root", "fp").alias("group"), "b"), "copies-shared")
    shared = shared.select("fp", "group").join(shared.groupBy("group").agg(F.min("b").alias("b")), "group")
    pairs = printed.join(shared, "fp").where("class <> b").select(F.greatest("class", "b").alias("a"), F.least("class", "b").alias("b")).distinct()
    # A root names itself in no row of its own.
    parts = materialize(components(pairs), "copies-parts")
    parts = parts.select("root", F.col("node").alias("class")).union(parts.select("root", F.col("root").alias("class")).distinct())
    wanted = parts.join(classes.select("class", F.col("rep").alias("id")), "class")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for part, texts in slices(batches, "text"):
            sets = [shingles(t, hashes) for t in texts]
            # An id may have several texts.
            mine = [i for i, (s, c) in enumerate(zip(sets, column(part, "class").to_pylist(), strict=True)) if digest(s) == c]
            yield pa.RecordBatch.from_arrays([*(column(part, c).take(pa.array(mine, pa.int64())) for c in ("root", "class")), pa.array([sets[i].tobytes() for i in mine], pa.binary())], ["root", "class", "shingles"])

    sets = materialize(source.join(wanted, "id").select("root", "class", "text").mapInArrow(sets_of, "root bigint, class bigint, shingles binary"), "copies-sets")
    large = materialize(sets.groupBy("root").count().where(F.col("count") > CHUNK).select("root"), "copies-large")
    whole = sets.join(large, "root", "left_anti").select("root", F.lit(0).cast("bigint").alias("group"), F.lit(0).alias("i"), F.lit(0).alias("j"), "class", "shingles")
    spread = sets.join(large, "root", "left_semi")
    met = spread.select("root", "class").join(printed, "class").join(shared.select("fp", "group"), "fp")
    blocks = met.groupBy("root", "group").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("blocks"))
    dealt = (
        met.join(blocks, ["root", "group"])
        .withColumn("mine", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("root", "group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "class")
        .join(spread.select("class", "shingles"), "class")
        .select("root", "group", "i", "j", "class", "shingles")
        .union(whole)
    )

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("class").sort_values("class")
        own = pdf["class"].to_numpy(np.int64)
        b = own[similar([np.frombuffer(s, np.uint64) for s in pdf["shingles"]], least)]
        return pd.DataFrame({"a": own[own != b], "b": b[own != b]})

    links = dealt.groupBy("root", "group", "i", "j").applyInPandas(link, "a bigint, b bigint")
    several = rows.where("id is not null").groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("a")).where("a <> b")
    same = rows.select("id", "class").join(several.select("id", "b"), "id").where("class <> b").select(F.col("class").alias("a"), "b")
    roots = materialize(components(links.union(same).distinct()), "copies-roots")
    named = classes.select("class", "rep").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    low = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.select("class", "root").join(low, "root").select("class", "component_id")
    salts = salted.select("class", "salt").join(named, "class")
    return rows.select("id", "class", "salt").join(salts, ["class", "salt"]).select(F.col("id").alias(id_col), "component_id")
