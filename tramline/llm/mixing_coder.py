"""Token ids in files, coded by an adaptive context-mixing range coder.

Ids are cut into blocks, each with a range coder and a checksum of its own; a segment
is as many blocks as a task holds, and they share a model, which is decoded with all of
them. A hashed table of the two ids before (order 2) and one of the id before (order 1)
each predict the next id, with a confidence; order 0 counts every id. Order 2's guess, or
order 1's where there is none, holds with a probability that is mixed in the logistic
domain from the hit rates of both orders by confidence and from the guess's order-0
share, by weights that each block learns as it goes. What is not guessed is coded by the
order-0 shares, which are drawn up from the counts anew each time that the steps have
grown by half; ids not seen so far have a share too. All arithmetic is in integers, so
files decode alike on any machine.

Blocks go side by side: each step of the model runs once over the arrays of all
blocks. A file holds segments; a segment holds a table of its documents and its
blocks. Files appear under their final name only when whole.

Nulls: a null text is an empty text, which is its end id alone; a null id sorts
first and is carried. Rows that repeat an id are in the order of a hash of their texts. Very
long texts span blocks. An empty table gives no files and an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import column, fresh_path, materialize, slices
from tramline.llm.tokens import shared_words

END, MAGIC = 2, b"TLCM\4\0\0\0"
#: Tokens of a block, and about so many of a segment: what a task holds at a time.
BLOCK, SEGMENT = 2_048, 6_000_000
#: A task has partitions of about so many bytes of text.
TASK_BYTES = 8 << 20
#: Segments whose blocks go side by side at most: each has tables of its own.
TOGETHER = 32
#: Ids, levels of confidence, and bits of the shares of order 0.
_IDS, _CONF, _BITS = 1 << 16, 16, 20
_U = np.uint64
_SCALE, _FLAG, _HALF, _LOW, _SMALL = _U(_BITS), _U(12), _U(32), _U(0xFFFFFFFF), _U(1 << 32)
# Logistic function and its inverse in fixed point: 12-bit probabilities against a domain of 8 fractional bits.
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2048, 2048) / 256))), 16, 4080).astype(np.int32)
STRETCH = np.clip(np.round(256 * np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096)))), -2047, 2047).astype(np.int32)


def active(lengths: np.ndarray) -> list[int]:
    """How many blocks take part in each step; lengths in descending order."""
    return np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left").tolist()


def turned(table: np.ndarray) -> np.ndarray:
    """Rows as columns, by bands that stay in the cache."""
    out = np.empty(table.shape[::-1], table.dtype)
    long = table.shape[0] > table.shape[1]
    for a in range(0, min(table.shape), 64):
        if long:
            out[a : a + 64] = table[:, a : a + 64].T
        else:
            out[:, a : a + 64] = table[a : a + 64].T
    return out


class Lanes:
    """Model of n blocks, advanced together; the first k take part in a step.

    `held` has tables of guesses (guess * 16 + confidence), `tally` has misses and hits by confidence, and `counts` has the
    ids: one of each a segment, learnt from all its blocks. Shares of order 0 follow from the counts each time that the
    steps have grown by half. Weights are a block's own.
    """

    def __init__(self, lengths: np.ndarray, of: np.ndarray):
        n, self.lengths = len(lengths), lengths
        tokens = np.bincount(of, weights=lengths).astype(np.int64)
        segments = len(tokens)
        slots = np.array([1 << min(18, max(8, int(t).bit_length() - 2)) for t in tokens], np.int64)
        ends = segments * _IDS + np.cumsum(slots)
        self.held = np.zeros(int(ends[-1]) if n else 0, np.int32)
        self.base, self.mask, self.slots = of * _IDS, slots[of] - 1, (ends - slots)[of]
        self.shares, self.levels = of << _BITS, np.array([[0], [_CONF]]) + of * (3 * _CONF)
        self.tally = np.tile(np.array([7, 1]), (3 * _CONF * segments, 1))
        self.weight = np.full((3, n), 1 << 15, np.int32)
        self.one, self.two = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.counts = np.zeros((segments, _IDS), np.int64)
        # An id's start and size among the shares, in one number, and what its share is to the mixture.
        self.place, self.often = np.zeros(segments * _IDS, _U), np.zeros(segments * _IDS, np.int32)
        self.id_at = np.zeros(segments << _BITS, np.uint16)
        self.known, self.due = 0, 0

    def share(self, step: int, ids: np.ndarray, back: bool) -> None:
        """Shares from the ids of all steps so far; back: also the id of each. Each id has some; those not seen have as much as new ones did."""
        for a in range(self.known, step, 256):
            b = min(step, a + 256)
            some = ids[a:b] + self.base if len(self.counts) > 1 else ids[a:b]
            some = some.ravel() if self.lengths[-1] >= b else some[np.arange(a, b)[:, None] < self.lengths]
            self.counts += np.bincount(some, minlength=self.counts.size).reshape(self.counts.shape)
        self.known, self.due = step, max(step + 1, step * 3 // 2)
        for i, counts in enumerate(self.counts):
            total, kinds = int(counts.sum()), int(np.count_nonzero(counts))
            floor = max(1, (16 * kinds) // (total + kinds)) if total else 16
            ends = np.arange(1, _IDS + 1) * floor
            ends += np.cumsum(counts) * ((1 << _BITS) - floor * _IDS) // max(1, total)
            if not total:
                ends[-1] = 1 << _BITS
            size = np.diff(ends, prepend=0)
            mine = slice(i * _IDS, (i + 1) * _IDS)
            self.place[mine] = (ends - size).astype(_U) << _HALF | size.astype(_U)
            self.often[mine] = STRETCH.take(size >> _BITS - 12)
            if back:
                self.id_at[i << _BITS : i + 1 << _BITS] = np.repeat(np.arange(_IDS, dtype=np.uint16), size)

    def predict(self, k: int) -> tuple:
        """(guess, its chance of 4096, what `learn` needs): order 2's guess, or order 1's where there is none."""
        at = np.empty((2, k), np.int64)
        at[0] = self.slots[:k] + ((self.two[:k] * 40_503 + self.one[:k] * 3_266_489_917 >> 11) & self.mask[:k])
        np.add(self.base[:k], self.one[:k], out=at[1])
        held = self.held.take(at)
        sure, guesses = held & _CONF - 1, held >> 4
        guess = np.where(sure[0] > 0, guesses[0], guesses[1])
        level = self.levels[:, :k] + sure
        level[1] += sure[1]
        level[1] += guesses[1] == guess
        rate = STRETCH.take((self.tally[:, 1] << 12) // self.tally.sum(axis=1))
        signal = np.empty((3, k), np.int32)
        rate.take(level, out=signal[:2], mode="clip")
        self.often.take(self.base[:k] + guess, out=signal[2], mode="clip")
        mixed = self.weight[:, :k] * signal
        dot = mixed[0] + mixed[1]
        dot += mixed[2]
        dot >>= 16
        dot += 2048
        return guess, SQUASH.take(dot, mode="clip"), (at, held, sure, guesses, level, signal)

    def learn(self, k: int, step: int, x: np.ndarray, hit: np.ndarray, chance: np.ndarray, known: tuple) -> None:
        at, held, sure, guesses, level, signal = known
        signal *= (hit.astype(np.int32) << 12) - chance
        signal >>= 10
        weight = self.weight[:, :k]
        weight += signal
        # Weights move by less than 2 ** 13 a step, so they stay under 3 * 2 ** 16 and their sums under 2 ** 31.
        if step & 7 == 7:
            np.minimum(weight, 1 << 17, out=weight)
            np.maximum(weight, -(1 << 17), out=weight)
        level <<= 1
        level += hit
        self.tally += np.bincount(level.ravel(), minlength=self.tally.size).reshape(self.tally.shape)
        x32 = x.astype(np.int32)
        # Where blocks meet in a place, the last one's stays.
        self.held[at] = np.where(guesses == x32, held + (sure < _CONF - 1), np.where(sure > 1, held - sure + (sure >> 1), x32 << 4 | 1))
        self.two[:k] = self.one[:k]
        self.one[:k] = x


def encode_blocks(blocks: list[np.ndarray], of: np.ndarray | None = None) -> list[bytes]:
    """Blocks in descending order of length, ids under 2 ** 16; of: the segment of each, from 0."""
    n = len(blocks)
    lengths = np.array([len(b) for b in blocks], np.int64)
    lanes = Lanes(lengths, np.zeros(n, np.int64) if of is None else of)
    steps = active(lengths)
    rows = np.zeros((n, len(steps)), np.uint16)
    for i, b in enumerate(blocks):
        if len(b) and (b.max() >= _IDS or b.min() < 0):
            raise ValueError("ids must be under 65,536")
        rows[i, : len(b)] = b
    ids = turned(rows)
    width = len(steps) + 2
    out, at = np.zeros(n * width, np.uint32), np.arange(n) * width
    lows, spans = np.zeros(n, _U), np.full(n, 2**64 - 1, _U)
    for step, k in enumerate(steps):
        if step >= lanes.due:
            lanes.share(step, ids, False)
        x, low, pos = ids[step, :k].astype(np.int64), lows[:k], at[:k]
        guess, chance, known = lanes.predict(k)
        hit = guess == x
        place = lanes.place.take(lanes.base[:k] + x)
        span = spans[:k]
        part = (span >> _FLAG) * chance.astype(_U)
        unit = (span - part) >> _SCALE
        more = np.where(hit, _U(0), part + unit * (place >> _HALF))
        span = np.where(hit, part, unit * (place & _LOW))
        low += more
        carried = pos[np.flatnonzero(low < more)] - 1
        while len(carried):
            out[carried] += np.uint32(1)
            carried = carried[out[carried] == 0] - 1
        # A step takes 32 bits at most, so what is left of the range is one word short at most.
        short = np.flatnonzero(span < _SMALL)
        shifted = low[short]
        out[pos[short]] = shifted >> _HALF
        pos[short] += 1
        low[short] = shifted << _HALF
        span[short] <<= _HALF
        spans[:k] = span
        lanes.learn(k, step, x, hit, chance, known)
    out[at] = lows >> _HALF
    out[at + 1] = lows & _LOW
    size = at + 2 - np.arange(n) * width
    out = out.reshape(n, width)
    return [out[i, : size[i]].astype(">u4").tobytes() for i in range(n)]


def decode_blocks(coded: list[bytes], lengths: np.ndarray, of: np.ndarray | None = None) -> list[np.ndarray]:
    """The inverse; lengths in descending order."""
    n = len(coded)
    lengths = np.asarray(lengths, np.int64)
    lanes = Lanes(lengths, np.zeros(n, np.int64) if of is None else of)
    steps = active(lengths)
    data = np.frombuffer(b"".join(coded), ">u4").astype(np.uint32)
    words = np.array([len(c) // 4 for c in coded], np.int64)
    at = np.cumsum(words) - words
    codes, spans = np.zeros(n, _U), np.full(n, 2**64 - 1, _U)
    for _ in range(2):
        codes = codes << _HALF | data.take(at, mode="clip").astype(_U)
        at += 1
    out, top = np.zeros((len(steps), n), np.uint16), _U((1 << _BITS) - 1)
    for step, k in enumerate(steps):
        if step >= lanes.due:
            lanes.share(step, out, True)
        guess, chance, known = lanes.predict(k)
        code, span, pos = codes[:k], spans[:k], at[:k]
        part = (span >> _FLAG) * chance.astype(_U)
        hit = code < part
        unit = (span - part) >> _SCALE
        rest = code - part
        x = lanes.id_at.take(np.minimum(rest // unit, top).astype(np.int64) + lanes.shares[:k])
        x = np.where(hit, guess, x).astype(np.int64)
        out[step, :k] = x
        place = lanes.place.take(lanes.base[:k] + x)
        code = np.where(hit, code, rest - unit * (place >> _HALF))
        span = np.where(hit, part, unit * (place & _LOW))
        short = np.flatnonzero(span < _SMALL)
        place = pos[short]
        code[short] = code[short] << _HALF | data.take(place, mode="clip").astype(_U)
        pos[short] = place + 1
        span[short] <<= _HALF
        codes[:k], spans[:k] = code, span
        lanes.learn(k, step, x, hit, chance, known)
    rows = turned(out)
    return [rows[i, : lengths[i]] for i in range(n)]


def side_by_side(runs: list[list[np.ndarray]]) -> list[list[bytes]]:
    """Codes the blocks of segments, in any order of length."""
    coded = []
    for a in range(0, len(runs), TOGETHER):
        some = runs[a : a + TOGETHER]
        blocks, of = [b for run in some for b in run], np.repeat(np.arange(len(some)), [len(run) for run in some])
        order = np.argsort([-len(b) for b in blocks], kind="stable")
        found = dict(zip(order.tolist(), encode_blocks([blocks[i] for i in order], of[order]), strict=True))
        rest = iter([found[i] for i in range(len(blocks))])
        coded += [[next(rest) for _ in run] for run in some]
    return coded


def cut(ids: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    return [ids[i : i + block] for i in range(0, len(ids), block)]


def segment(ids: np.ndarray, docs: pa.RecordBatch, block: int = BLOCK, coded: list[bytes] | None = None) -> bytes:
    """Length, document table and blocks of a run of documents; coded: its blocks, if they are coded already."""
    parts = cut(ids, block)
    coded = side_by_side([parts])[0] if coded is None else coded
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as writer:
        writer.write_batch(docs)
    table = zlib.compress(sink.getvalue())
    index = b"".join(struct.pack("<LLL", len(p), len(c), zlib.crc32(c)) for p, c in zip(parts, coded, strict=True))
    body = struct.pack("<LL", len(table), len(parts)) + table + index + b"".join(coded)
    return struct.pack("<QL", len(body), zlib.crc32(body[: 8 + len(table) + len(index)])) + body


def coded_segments(source: object) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[int]]]:
    """(documents, coded blocks, their ids) of each segment of an open file, one at a time."""
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of coded token ids")
    while head := source.read(12):
        size, crc = struct.unpack("<QL", head)
        body = source.read(size)
        n_table, n_blocks = struct.unpack_from("<LL", body)
        at = 8 + n_table + 12 * n_blocks
        if len(body) != size or zlib.crc32(body[:at]) != crc:
            raise ValueError("a segment's index is damaged")
        with pa.ipc.open_stream(zlib.decompress(body[8 : 8 + n_table])) as reader:
            docs = reader.read_all().combine_chunks().to_batches()[0]
        coded, lengths = [], []
        for n, length, check in struct.iter_unpack("<LLL", body[8 + n_table : at]):
            coded.append(body[at : at + length])
            lengths.append(n)
            at += length
            if zlib.crc32(coded[-1]) != check:
                raise ValueError("a block is damaged")
        yield docs, coded, lengths


def decoded(held: list[tuple[pa.RecordBatch, list[bytes], list[int]]]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(documents, ids) of coded segments, whose blocks are decoded side by side."""
    for start in range(0, len(held), TOGETHER):
        some = held[start : start + TOGETHER]
        coded, lengths = [c for _, x, _ in some for c in x], np.array([n for _, _, x in some for n in x], np.int64)
        of, order = np.repeat(np.arange(len(some)), [len(x) for _, x, _ in some]), np.argsort(-lengths, kind="stable")
        found = dict(zip(order.tolist(), decode_blocks([coded[i] for i in order], lengths[order], of[order]), strict=True))
        at = 0
        for docs, blocks, _ in some:
            yield docs, np.concatenate([found[i] for i in range(at, at + len(blocks))])
            at += len(blocks)


def segments(source: object) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(documents, ids) of each segment of an open file, one at a time."""
    for one in coded_segments(source):
        yield from decoded([one])


def write(docs: DataFrame, path: str, id_col: str, text_col: str, end: int, tokenizer: str | None) -> DataFrame:
    """(part, file, docs, tokens, task), one row a file; files in ascending order of ids.

    A file is a partition of the sorted documents. A step of the model costs about the same for one block as for many, so
    where partitions are small a task has several, and codes their blocks side by side.
    """
    # Rows that repeat an id are parted by a hash of their texts, so that no id is more than one task's.
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_order"))
    size = source.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    source = source.repartitionByRange("id", "_order").sortWithinPartitions("id", "_order", "text").drop("_order")
    source = source.withColumn("_part", F.spark_partition_id()).coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        task, words, out = TaskContext.get(), shared_words(tokenizer), {}
        # Runs (part, ids, tokens) of the segments that are filled, and of full ones that wait: a short rest joins them.
        filled, full, size, done = [], [], 0, {}
        name = lambda part: f"{root}/part-{part:06d}.ids"
        tmp = lambda part: f"{root}/.{part}-{task.taskAttemptId()}.tmp"

        def flush(runs: list[tuple[int, list, list]]) -> None:
            ids = [np.concatenate([x for x, _ in held]) for _, _, held in runs]
            coded = side_by_side([cut(x) for x in ids])
            for (part, keys, held), mine, blocks in zip(runs, ids, coded, strict=True):
                table = pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(np.concatenate([n for _, n in held]), pa.int64())], ["id", "n_tokens"])
                if part not in out:
                    store.create_dir(root, recursive=True)
                    out[part] = store.open_output_stream(tmp(part), compression=None)
                    out[part].write(MAGIC)
                out[part].write(segment(mine, table, coded=blocks))

        def closed(going: int | None) -> Iterator[pa.RecordBatch]:
            """Names files for good, but for that of the partition that is going on."""
            for part in [p for p in out if p != going]:
                out.pop(part).close()
                store.move(tmp(part), name(part))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name(part)]), pa.array([done[part][0]]), pa.array([done[part][1]]), pa.array([task.partitionId()], pa.int32())], ["part", "file", "docs", "tokens", "task"])

        for batch, texts in slices(batches, "text"):
            parts = column(batch, "_part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part, (found, lengths) = int(parts[a]), words.encode_all(texts[a:b], tail)
                if not filled or filled[-1][0] != part:
                    filled.append((part, [], []))
                filled[-1][1].append(column(batch, "id").slice(a, b - a))
                filled[-1][2].append((found, lengths))
                more, had = len(found), done.get(part, (0, 0))
                size, done[part] = size + more, (had[0] + len(lengths), had[1] + more)
                if size >= SEGMENT:
                    if full:
                        flush(full)
                        yield from closed(full[-1][0])
                    filled, full, size = [], filled, 0
        if full and size < SEGMENT // 2:
            if filled and filled[0][0] == full[-1][0]:
                (_, keys, held), *filled = filled
                full[-1][1].extend(keys)
                full[-1][2].extend(held)
            filled, full = full + filled, []
        for runs in (full, filled):
            if runs:
                flush(runs)
        yield from closed(None)

    return materialize(source.mapInArrow(run, "part int, file string, docs bigint, tokens bigint, task int"), "op8-files")


def read(files: DataFrame, path: str, kind: str = "bigint") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, decoded from the files; start: ids of all documents before it."""
    # One row a file: the running sum is over as many rows as there are files.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)

        def found(held: list, starts: list[int]) -> Iterator[pa.RecordBatch]:
            for (docs, ids), start in zip(decoded(held), starts, strict=True):
                n = docs.column(1).to_numpy()
                ends = np.cumsum(n)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (b - a) : 4 * b]) for a, b in zip(n.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(start + ends - n), docs.column(1), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

        held, starts, size = [], [], 0
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(name, compression=None) as source:
                    for one in coded_segments(source):
                        more = sum(one[2])
                        if held and size + more > SEGMENT:
                            yield from found(held, starts)
                            held, starts, size = [], [], 0
                        held.append(one)
                        starts.append(start)
                        size, start = size + more, start + more
        if held:
            yield from found(held, starts)

    # Small files that follow each other are one task's, so that their blocks are decoded side by side.
    tokens = files.agg(F.sum("tokens")).head()[0] or 0
    share = max(1, min(SEGMENT // 2, -(-tokens // files.sparkSession.sparkContext.defaultParallelism)))
    placed = files.select("file", before.cast("bigint").alias("start")).withColumn("group", F.expr(f"start div {share}"))
    n = max(1, placed.select("group").distinct().count())
    return placed.repartitionByRange(n, "group").select("file", "start").mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end: int = END, tokenizer: str | None = None) -> DataFrame:
    """Writes the files and reads them back: (id, start, n_tokens, ids_crc32)."""
    path = fresh_path(docs.sparkSession, "ids")
    files = write(docs, path, id_col, text_col, end, tokenizer)
    return read(files, path, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
