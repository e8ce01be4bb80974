"""Language-model scores from a probabilistic suffix tree over words.

The root is the smoothed word distribution of all training tokens. A context of one
to `depth` words is a state of the tree if what follows it diverges from what
follows its shorter suffix: the log-likelihood that its next words gain over the
suffix, on all its occurrences in the corpus, must reach `GAIN`. A state gives each
next word that is kept (seen `LEAST` times after it) its discounted share, and
shares the mass that is left by its suffix's distribution, so every state's
distribution sums to one. A token's probability is that of the longest suffix of
the words before it that is a state. What is learned grows with the corpus: every
context and next word that occurs twice is asked for its gain, whatever its share.

Texts are held in chunks, each a file in the shared folder: word numbers, the words'
64-bit hashes, and what is known of each place so far. Counting goes by length. A
chunk asks for the corpus counts of its distinct runs of k + 1 words, by their
hash, in as many buckets as the corpus needs; of equal runs it asks once, so no
frequent run makes a hot bucket. A run that occurs twice holds two shorter ones
that do, so only places where both are kept are asked for the next length, and the
exchanges shrink. Of all chunks with a kept run one is told that it owns it, and
notes the run's gain with its context; by the contexts' hash the gains are summed,
and the chunks that hold the context learn whether it is a state and what it leaves
to its suffix. Each exchange's answers are a written table; an older round's files
and answers are removed once the next one stands.

Nulls: a null text is an empty text, which is its end token alone. Null ids are
trained on (they are in no held-out fold) and carried. Repeated rows count and are
scored as often as they occur. Equal texts get equal scores; a text alone in a
chunk may be of any length. With no training documents every count is zero and
unknown words share all the mass. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import column, fresh_path, hashed_fold, removed, slices
from tramline.shared import written

#: Longest context, occurrences from which on a run is kept, least gain of a state in nats, and what is taken off a count.
DEPTH, LEAST, GAIN, DISCOUNT = 5, 2, 6.0, 0.7
#: The end token: no word can hold a line break. It also stands before a text.
END = b"\n"
#: Distinct words whose hashes a task remembers, tokens of a chunk, and runs that a bucket is meant to hold.
COUNTED, CHUNK, BUCKET = 400_000, 1 << 20, 1 << 21
#: The hash of a run is that of all but its last word times STEP, plus its last word's.
STEP = np.uint64(0x9E3779B97F4A7C15)
RUN, CONTEXT, NOTHING = range(3)
ASK = "kind int, bucket int, chunk bigint, n int, keys binary, data binary"
ANSWER = "kind int, bucket int, chunk bigint, n int, data binary, found bigint, total bigint"


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


class Hashes(dict):
    """word -> its XXH64, as Spark's xxhash64 has it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= COUNTED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit values: marks of the rows whose first value is not zero, and their values by bytes of equal weight, without the high bytes that are zero throughout."""
    some = columns[0] != 0
    out = [np.packbits(some).tobytes()]
    for x in columns:
        raw = x[some].view(np.uint64)
        n = -(-int(raw.max()).bit_length() // 8) if len(raw) else 0
        out += [bytes([n]), np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()]
    return b"".join(out)


def unpacked(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    at = -(-n // 8)
    some = np.unpackbits(np.frombuffer(data, np.uint8, at), count=n).view(bool)
    rows, out = int(some.sum()), []
    for kind in kinds:
        wide, raw = data[at], np.zeros((rows, 8), np.uint8)
        raw[:, :wide] = np.frombuffer(data, np.uint8, wide * rows, at + 1).reshape(wide, rows).T
        out.append(np.zeros(n, kind))
        out[-1][some] = raw.view(kind).ravel()
        at += 1 + wide * rows
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, a place of each, which of them stands at each place)."""
    order = np.argsort(keys)
    lined = keys[order]
    fresh = np.ones(len(keys), bool)
    np.not_equal(lined[1:], lined[:-1], out=fresh[1:])
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return lined[fresh], order[fresh], group


def keep(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Writes arrays as a file that appears only when whole; one that stands already is as good."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    target, tmp = f"{root}/{name}", f"{root}/.{name}-{TaskContext.get().taskAttemptId()}.tmp"
    with store.open_output_stream(tmp, compression="zstd") as out:
        for key, x in arrays.items():
            # Whole numbers are written as narrow as they are, and bytes of equal weight together.
            narrow = x.astype(np.min_scalar_type(int(x.max(initial=0)))) if x.dtype.kind == "i" else np.ascontiguousarray(x)
            out.write(f"{key} {x.dtype.str} {narrow.dtype.str} {len(x)}\n".encode())
            out.write(np.ascontiguousarray(narrow.view(np.uint8).reshape(len(x), narrow.itemsize).T))
    if store.get_file_info(target).type == fs.FileType.NotFound:
        store.move(tmp, target)
    else:
        store.delete_file(tmp)


def kept(folder: str, name: str) -> dict[str, np.ndarray]:
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{name}", compression="zstd") as source:
        data = source.read()
    out, at = {}, 0
    while at < len(data):
        end = data.index(b"\n", at)
        key, kind, narrow, n = data[at:end].decode().split()
        wide, n = np.dtype(narrow).itemsize, int(n)
        raw = np.frombuffer(data, np.uint8, wide * n, end + 1).reshape(wide, n).T
        out[key] = np.ascontiguousarray(raw).view(narrow).ravel().astype(kind, copy=False)
        at = end + 1 + wide * n
    return out


class Chunk:
    """Some texts in a row, each behind an end token: where a text starts nothing is predicted."""

    def __init__(self, texts: dict[str, np.ndarray]):
        self.words, lengths, self.ids = texts["words"], texts["lengths"], texts["ids"]
        self.docs = len(lengths)
        first = np.cumsum(lengths + 1) - lengths - 1
        self.inside = np.ones(int(lengths.sum()) + self.docs, bool)
        self.inside[first] = False
        self.word = np.full(len(self.inside), int(np.flatnonzero(self.words == np.uint64(xxhash.xxh64_intdigest(END, 42)))[0]), np.int64)
        self.word[self.inside] = texts["tokens"]
        self.doc = np.repeat(np.arange(self.docs), lengths + 1)
        self.train = texts["train"][self.doc]
        self.lengths, self.held = lengths, ~texts["train"]
        self.known: list[np.ndarray] = []

    def runs(self, k: int) -> np.ndarray:
        """The hash of the k + 1 words up to each place (of no use where a text starts within them)."""
        while len(self.known) <= k:
            self.known.append(before(self.known[-1]) * STEP + self.known[0] if self.known else self.words[self.word])
        return self.known[k]

    def open(self, counts: np.ndarray) -> np.ndarray:
        """Places that have a kept context; counts: of the runs up to each place that are as long as the context."""
        return np.flatnonzero(self.inside & (before(counts) >= LEAST))

    def asked(self, counts: np.ndarray) -> np.ndarray:
        """Places where a longer run may be kept."""
        return np.flatnonzero(self.inside & (before(counts) >= LEAST) & (counts >= LEAST))

    def sums(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[places], values, self.docs)


def before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, x.dtype), x[:-1]])


def asks(kind: int, chunk: int, buckets: int, keys: np.ndarray, *data: np.ndarray) -> Iterator[tuple]:
    """A row a bucket: sorted keys fall into buckets by their high bits."""
    cuts = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        at = slice(cuts[b], cuts[b + 1])
        mine = keys[at]
        yield kind, b, chunk, len(mine), packed(np.diff(mine, prepend=np.uint64(0))), packed(*(x[at] for x in data))


def answered(rows: pd.DataFrame, kind: int, *kinds: type) -> list[np.ndarray]:
    """What was found for a chunk's sorted keys."""
    mine = rows[rows["kind"] == kind].sort_values("bucket")
    parts = [unpacked(d, n, *kinds) for d, n in zip(mine["data"], mine["n"], strict=True)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, k) for k in kinds]


def answer(rows: pd.DataFrame, least: int, gain: float) -> pd.DataFrame:
    """Sums over all chunks for a bucket's keys, sent back to each chunk that asked."""
    kind = int(rows["kind"].iloc[0])
    rows = rows.sort_values("chunk", kind="stable").reset_index(drop=True)
    out = rows[["kind", "bucket", "chunk", "n"]].assign(data=b"", found=0, total=0)
    if kind == NOTHING:
        return out
    sizes = rows["n"].tolist()
    keys = np.concatenate([np.cumsum(unpacked(k, n, np.uint64)[0], dtype=np.uint64) for k, n in zip(rows["keys"], sizes, strict=True)])
    order = np.argsort(keys, kind="stable")
    fresh = np.concatenate([[True], np.diff(keys[order]) != 0])
    starts, group = np.flatnonzero(fresh), np.empty(len(keys), np.int64)
    group[order] = np.cumsum(fresh) - 1
    if kind == RUN:
        local = np.concatenate([unpacked(d, n, np.int64)[0] for d, n in zip(rows["data"], sizes, strict=True)])
        count = np.add.reduceat(local[order], starts)
        # Rows go by chunk and the sort is stable: the first of a key's chunks owns it.
        owner = np.zeros(len(keys), np.int64)
        owner[order[starts]] = 1
        count = np.where(count >= least, count, 0)
        values = 2 * count[group]
        values += owner * (values > 0)
        out.loc[0, ["found", "total"]] = int((count > 0).sum()), int(count.sum())
    else:
        kinds, whole, seen, own = (np.concatenate(x) for x in zip(*(unpacked(d, n, np.int64, np.int64, np.int64, np.float64) for d, n in zip(rows["data"], sizes, strict=True)), strict=True))
        # Only chunks that own a run of a context tell how often it stands in the corpus.
        whole = np.maximum(np.maximum.reduceat(whole[order], starts), 1)
        seen, kinds, own = (np.add.reduceat(x[order], starts) for x in (seen, kinds, own))
        left = np.maximum(1 - (seen - DISCOUNT * kinds) / whole, 1e-9)
        better = own + (whole - seen) * np.log(left)
        values = np.where((kinds > 0) & (better >= gain), left, 0.0).astype(np.float32).astype(np.float64)[group]
    cuts = np.cumsum([0, *sizes])
    out["data"] = [packed(values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def chunks(docs: DataFrame, folder: str, id_col: str, text_col: str, train: F.Column) -> DataFrame:
    """(chunk, tokens): all texts, written to files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbered by attempt: an attempt that meets its rows in another order writes files of its own.
        hashes, number = Hashes(), TaskContext.get().taskAttemptId() << 24
        ids, train, lengths, flat, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            table = pa.table({"id": pa.chunked_array(ids)})
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            words, _, place = distinct(np.concatenate(flat))
            # Frequent words get small numbers.
            order = np.argsort(-np.bincount(place), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            keep(folder, f"{number}.texts", words=words[order], tokens=rank[place], lengths=np.concatenate(lengths), train=np.concatenate(train), ids=np.frombuffer(sink.getvalue(), np.uint8))
            for x in (ids, train, lengths, flat):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size])], ["chunk", "tokens"])

        for part, texts in slices(batches, "text", 1 << 20):
            words = [tokens(t) for t in texts]
            lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
            flat.append(np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(lengths[-1].sum())))
            ids.append(column(part, "id"))
            train.append(column(part, "train").to_numpy(zero_copy_only=False))
            size += len(flat[-1])
            if size >= CHUNK:
                yield flush()
                number, size = number + 1, 0
        if flat:
            yield flush()

    source = docs.select(F.col(id_col).alias("id"), train.alias("train"), F.col(text_col).alias("text"))
    return written(source.mapInArrow(run, "chunk bigint, tokens bigint"), "op9-chunks")


def first_asks(folder: str, chunk: int, buckets: int) -> list[tuple]:
    texts = kept(folder, f"{chunk}.texts")
    here = np.bincount(texts["tokens"], np.repeat(texts["train"], texts["lengths"]), len(texts["words"]))
    order = np.argsort(texts["words"])
    return [*asks(RUN, chunk, buckets, texts["words"][order], here[order].astype(np.int64))]


def advanced(folder: str, chunk: int, k: int, depth: int, buckets: int, whole: float, found: pd.DataFrame) -> tuple[list[tuple], tuple]:
    """(asks, results): takes in the counts of runs of k + 1 words and the states of k - 1 words.

    Results, once k is beyond the depth: ids, held-out marks, tokens, known tokens, base scores and scores of the chunk's documents.
    """
    c = Chunk(kept(folder, f"{chunk}.texts"))
    if k == 0:
        root = np.empty(len(c.words), np.int64)
        root[np.argsort(c.words)] = answered(found, RUN, np.int64)[0] >> 1
        count = root[c.word]
        log = np.where(c.inside, np.log10((count + 0.5) / whole), 0.0)
        base, known = (np.bincount(c.doc, x, c.docs) for x in (log, c.inside & (count > 0)))
        live = c.open(count)
        score = base - c.sums(live, log[live])
        state = {"root": root}
    else:
        # Of runs up to each place `last` counts those of k words, `older` those of k - 1; chances are by contexts of k - 2.
        state = kept(folder, f"{chunk}.{k - 1}")
        base, known, score = (state[x] for x in ("base", "known", "score"))
        last, older = (state[x] if x in state else state["root"][c.word] for x in ("last", "older"))
        chance = np.zeros(len(c.inside), np.float32)
        if k == 1:
            live = c.open(last)
            chance[live] = (last[live] + 0.5) / whole
        else:
            was = c.open(older)
            chance[was] = state["chance"] if k > 2 else (older[was] + 0.5) / whole
            group = distinct(c.runs(k - 2)[was - 1])[2]
            left = answered(found, CONTEXT, np.float64)[0][group]
            own = np.where(last[was] >= LEAST, last[was] - DISCOUNT, 0.0) / older[was - 1]
            chance[was] = np.where(left > 0, own + left * chance[was], chance[was])
            live = c.open(last) if k <= depth else was[:0]
            over = np.zeros(len(c.inside), bool)
            over[was] = True
            over[live] = False
            done = np.flatnonzero(over)
            score = score + c.sums(done, np.log10(chance[done].astype(np.float64)))
        if k > depth:
            return [], (c.ids, c.held, c.lengths, known.astype(np.int64), base, score)
        places = c.asked(last)
        _, first, group = distinct(c.runs(k)[places])
        answers = answered(found, RUN, np.int64)[0]
        count = np.zeros_like(last)
        count[places] = (answers >> 1)[group]
        mine = places[first[(answers > 1) & (answers & 1 > 0)]]
        state = {"last": count} | ({"root": state["root"]} if k == 1 else {"older": last, "chance": chance[live]})
    keep(folder, f"{chunk}.{k}", base=base, known=known, score=score, **state)
    out = [(NOTHING, chunk % buckets, chunk, 0, b"", b"")]
    if k:
        keys, first, group = distinct(c.runs(k - 1)[live - 1])
        at = np.empty(len(c.inside), np.int64)
        at[live] = group
        of = at[mine]
        gains = count[mine] * np.log((count[mine] - DISCOUNT) / last[mine - 1] / chance[mine].astype(np.float64))
        kinds, seen, gained = (np.bincount(of, x, len(keys)) for x in (np.ones(len(mine)), count[mine], gains))
        out += asks(CONTEXT, chunk, buckets, keys, kinds.astype(np.int64), last[live - 1][first].astype(np.int64), seen.astype(np.int64), gained.astype(np.float32).astype(np.float64))
    if k < depth:
        places = c.asked(count)
        keys, _, group = distinct(c.runs(k + 1)[places])
        out += asks(RUN, chunk, buckets, keys, np.bincount(group, c.train[places], len(keys)).astype(np.int64))
    return out, ()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, depth: int = DEPTH, gain: float = GAIN) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): learned from the rows outside fold `held`."""
    spark = docs.sparkSession
    folder, kind = fresh_path(spark, "op9-texts"), docs.schema[id_col].dataType.simpleString()
    listed = chunks(docs, folder, id_col, text_col, F.coalesce(hashed_fold(id_col, folds) != held, F.lit(True)))
    pieces, size = listed.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    buckets, whole, total = max(1, -(-size // BUCKET)), 1.0, 0

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk in batch["chunk"].tolist():
                yield pd.DataFrame(first_asks(folder, chunk, buckets), columns=[x.split()[0] for x in ASK.split(", ")])

    def exchanged(asked: DataFrame, least: int, at: str) -> DataFrame:
        gathered = asked.repartition(buckets, "bucket").groupBy("kind", "bucket")
        return written(gathered.applyInPandas(lambda rows: answer(rows, least, gain), ANSWER), "op9-answers", f"{folder}-answers-{at}")

    def turn(k: int, whole: float):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            out, _ = advanced(folder, int(rows["chunk"].iloc[0]), k, depth, buckets, whole, rows)
            return pd.DataFrame(out, columns=[x.split()[0] for x in ASK.split(", ")])

        return run

    def last(asked: pa.Table) -> pa.Table:
        rows = asked.to_pandas()
        _, (ids, *values) = advanced(folder, int(rows["chunk"].iloc[0]), depth + 1, depth, buckets, whole, rows)
        with pa.ipc.open_stream(ids.tobytes()) as reader:
            names = reader.read_all().column("id").combine_chunks()
        return pa.table([names, *map(pa.array, values)], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    answers = exchanged(listed.repartition(max(1, pieces), "chunk").mapInPandas(start, ASK), 1, "words")
    found, total = answers.agg(F.coalesce(F.sum("found"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    whole, old = total + 0.5 * (found + 1), f"{folder}-answers-words"
    for k in range(depth + 1):
        answers = exchanged(answers.repartition(max(1, pieces), "chunk").groupBy("chunk").applyInPandas(turn(k, whole), ASK), LEAST, str(k))
        removed(spark, old, f"{folder}/*.{k - 1}")
        old = f"{folder}-answers-{k}"
    out = written(answers.repartition(max(1, pieces), "chunk").groupBy("chunk").applyInArrow(last, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"), "op9-scores")
    removed(spark, old, folder)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
