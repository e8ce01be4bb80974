"""Quality scores: random-indexing word vectors, pooled per document, under a two-layer network.

Every word has two random index vectors, sparse and ternary, drawn by a keyed
hash: one for its letters, one for its shape (case, digits, punctuation runs). A
word's vector is its index vector plus the sum of the index vectors of the words
near it in the sample, brought to unit length. A document is described by the
mean and the spread of its words' vectors and by how much neighbouring words
agree. A network with one hidden layer turns this into a log-odds, and a single
temperature, fitted on documents that the weights have not seen, calibrates it.

The network and the word vectors are fitted in one task from at most
`sample` labelled rows of each class (a documented bound; those with the smallest
keyed hash of their id, texts over TEXT_BYTES behind all others) that hold SAMPLE_BYTES
together; a long text thus takes no other's place, and a class always keeps at least one
row. The class shares come from all labelled rows whose document is among docs. The model
is a few arrays of fixed size, whatever the corpus.

Nulls: a null text is an empty text; empty texts get a score like any other (that
of a document without words). A null id is in no held-out fold. Rows whose label is null are not learned from.
Repeated rows are scored alike; repeated labels count as often as they occur.
With no labels, or labels of one class only, every score is that class's share
(0.5 without labels). An empty table gives an empty result. Other columns are
ignored; language, source and id never enter a score.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.common import hashed_fold, materialize, slices

DIM, BUCKETS, SHAPES = 32, 1 << 15, 1 << 12
SAMPLE, WINDOW, HIDDEN, EPOCHS = 3_000, 2, 24, 40
#: Bytes of text that each class is learned from at most: labelled rows in the order of the sample, as many as fit.
SAMPLE_BYTES = 32 << 20
#: A longer text is learned from only where the shorter ones of its class leave room.
TEXT_BYTES = 1 << 20
THRESHOLD = 0.3
#: Words whose buckets a worker remembers.
REMEMBERED = 400_000
_UPPER, _LOWER, _DIGIT, _REST = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(\W)\1+")


def index_vectors(n: int, seed: int) -> np.ndarray:
    """n sparse ternary vectors of about unit length."""
    rng = np.random.default_rng(seed)
    return rng.choice(np.array([-1, 0, 0, 0, 0, 1], np.float32), (n, DIM)) * np.float32(np.sqrt(3 / DIM))


class Buckets(dict):
    """word (UTF-8) -> letters' bucket * SHAPES + shape's bucket."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        text = word.decode("utf-8", "replace")
        shape = _REST.sub(r"\1\1", _DIGIT.sub("9", re.sub(r"[^\W\d_X]+", "x", _UPPER.sub("X", text))))
        letters = "".join(c for c in text.lower() if c.isalnum())
        found = (xxhash.xxh64_intdigest(letters, 11) % BUCKETS) * SHAPES + xxhash.xxh64_intdigest(shape, 12) % SHAPES
        self[word] = found
        return found


def codes(text: bytes, buckets: Buckets) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))


@dataclass
class Model:
    letters: np.ndarray
    shapes: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def pooled(self, code: np.ndarray) -> np.ndarray:
        """Features of one document; sums run over blocks of words, so long documents need no more memory."""
        n = len(code)
        out = np.zeros(4 * DIM + 5, np.float32)
        if not n:
            return out
        total, square, agree, same = np.zeros(2 * DIM), np.zeros(2 * DIM), np.zeros(2), 0
        for i in range(0, n, 4096):
            part = code[max(0, i - 1) : i + 4096]
            v = np.concatenate([self.letters[part // SHAPES], self.shapes[part % SHAPES]], axis=1)
            if len(part) > 1:
                both = v[1:] * v[:-1]
                agree += both[:, :DIM].sum(), both[:, DIM:].sum()
                same += int((part[1:] == part[:-1]).sum())
            v = v[min(i, 1) :]
            total += v.sum(axis=0)
            square += (v * v).sum(axis=0)
        mean = total / n
        out[: 2 * DIM], out[2 * DIM : 4 * DIM] = mean, np.sqrt(np.maximum(square / n - mean**2, 0))
        distinct = len(np.unique(code // SHAPES)) / n
        out[4 * DIM :] = *(agree / max(1, n - 1)), same / max(1, n - 1), np.log1p(n) / 5, distinct
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, texts: list[bytes], buckets: Buckets) -> np.ndarray:
        x = np.stack([self.pooled(codes(t, buckets)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -30, 30)))


def _near_sums(parts: list[np.ndarray], n: int, index: np.ndarray) -> np.ndarray:
    """For each of n buckets, the sum of its neighbours' index vectors, scaled to unit length with its own added."""
    sums = np.zeros((n, DIM), np.float64)
    flat = np.concatenate([np.concatenate([p, np.full(WINDOW, -1)]) for p in parts]) if parts else np.zeros(0, np.int64)
    for gap in range(1, WINDOW + 1):
        a, b = flat[:-gap], flat[gap:]
        ok = (a >= 0) & (b >= 0)
        a, b = a[ok], b[ok]
        for d in range(DIM):
            sums[:, d] += np.bincount(a, index[b, d], n) + np.bincount(b, index[a, d], n)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = index + sums / np.maximum(length, 1e-9)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def fit(texts: list[bytes], label: np.ndarray, share: float, seed: int = 5) -> Model:
    """share: of label 1 among all labelled rows; the sample may hold the classes in other shares."""
    rng, buckets = np.random.default_rng(seed), Buckets()
    parts = [codes(t, buckets) for t in texts]
    letters = _near_sums([p // SHAPES for p in parts], BUCKETS, index_vectors(BUCKETS, seed + 1))
    shapes = _near_sums([p % SHAPES for p in parts], SHAPES, index_vectors(SHAPES, seed + 2))
    size = 4 * DIM + 5
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    model = Model(letters, shapes, np.zeros(size), np.ones(size), np.zeros((size, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.clip(prior, -10, 10)), 1.0)
    if len(np.unique(label)) < 2:
        return model
    x = np.stack([model.pooled(p) for p in parts]).astype(np.float64)
    later = rng.random(len(x)) < 0.2
    if len(np.unique(label[later])) < 2 or len(np.unique(label[~later])) < 2:
        later = np.zeros(len(x), bool)
    model.centre, model.scale = x[~later].mean(axis=0), x[~later].std(axis=0) + 1e-3
    # Each class weighs as much as it does among all labelled rows.
    weight = np.where(label == 1, share / max((label == 1).mean(), 1e-9), (1 - share) / max((label == 0).mean(), 1e-9))
    p = [rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(prior)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z, rows = (x - model.centre) / model.scale, np.nonzero(~later)[0]
    for _ in range(EPOCHS):
        rng.shuffle(rows)
        for i in range(0, len(rows), 128):
            r = rows[i : i + 128]
            hidden = np.tanh(z[r] @ p[0] + p[1])
            off = weight[r] * (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - label[r]) / len(r)
            back = np.outer(off, p[2]) * (1 - hidden**2)
            grads, step = [z[r].T @ back + 1e-4 * p[0], back.sum(axis=0), hidden.T @ off + 1e-4 * p[2], off.sum()], step + 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0], p[1], p[2], float(p[3])
    unseen = later if later.any() else ~later
    logit, y, w = model.logits(x[unseen]), label[unseen], weight[unseen]
    loss = lambda t: float((w * np.logaddexp(0, np.where(y == 1, -logit, logit) / t)).sum())
    model.temperature = float(min(np.exp(np.linspace(-1.5, 2.0, 71)), key=loss))
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, sample: int = SAMPLE) -> Model:
    """Learns from labelled rows of docs outside fold 0; one task has at most 2 * sample texts, one an id, of 2 * SAMPLE_BYTES (or one text a class, if its shortest is longer)."""
    sizes = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("bytes")).groupBy("id").agg(F.max("bytes").alias("bytes"))
    seen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (hashed_fold("id", folds) != 0)).join(sizes, "id")
    seen = materialize(seen, "op2-labels")
    count = {r["label"]: r["count"] for r in seen.groupBy("label").count().collect()}
    if not count:
        return fit([], np.zeros(0, int), 0.5)
    # Texts of ordinary length in the order of a keyed hash; longer ones come behind them all, the shorter first.
    order = [F.greatest("bytes", F.lit(TEXT_BYTES)), F.xxhash64("id", F.lit("sample")), F.col("id")]
    chosen = [seen.where(F.col("label") == k).orderBy(*order).limit(sample) for k in (0, 1)]
    upto = Window.partitionBy("label").orderBy(*order)
    fits = (F.sum("bytes").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= SAMPLE_BYTES) | (F.row_number().over(upto) == 1)
    # At most 2 * sample rows of 12 bytes: small enough to send to every executor.
    picked = chosen[0].union(chosen[1]).withColumn("_fits", fits).where("_fits").select("id", "label").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    share = count.get(1, 0) / sum(count.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held).sort_by([("id", "ascending"), ("label", "ascending")]) if held else pa.table({"label": pa.array([], pa.int32()), "text": pa.array([], pa.string())})
        texts = [t.encode() for t in table.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, table.column("label").to_numpy().astype(int), share))], pa.binary())], ["model"])

    # One task has the bounded sample, so that the driver holds no texts, only the model.
    fitted = rows.groupBy("id", "label").agg(F.min("text").alias("text")).repartition(1).mapInArrow(run, "model binary")
    return pickle.loads(bytes(fitted.collect()[0]["model"]))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with their score as the column `name`, which replaces one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, fitted = Buckets(), shared.value
        for part, texts in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fitted.scores(texts, buckets))], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted)."""
    scored = score(docs.select(id_col, text_col), train(docs, labels, id_col, text_col, label_col, folds), text_col)
    return scored.select(id_col, F.coalesce(hashed_fold(id_col, folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
