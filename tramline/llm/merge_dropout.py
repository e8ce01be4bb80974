"""Byte-pair encoding with seeded merge dropout, and lossless decoding.

A text's words (runs of spaces with what follows them) are the rows of a matrix of
symbols. Each round takes from every word's agenda its best merge, the one with the
highest piece score and then the leftmost, and enters the new neighbours. Whether a
candidate merge is skipped for good is decided when it enters the agenda, by a
keyed hash of the seed, the document, the place of the word and of the merge in it,
and the piece that it would make. So segmentations vary from place to place and
from seed to seed, yet the same call always gives the same pieces, on any executor.
Without dropout they are those of the library.

Characters outside the vocabulary, and the space mark itself, become byte pieces,
so decoding gives back every text byte for byte.

Nulls: a null text is an empty text, without pieces; a null id is hashed as such.
Very long texts are taken in blocks of words and very long words one by one,
through a heap. Rows that repeat an id and text repeat its pieces. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.common import column, slices

MODEL, DROPOUT, SEED = "piece_bpe_32k.model", 0.1, 42
SPACE = "▁"
#: Words are dealt to matrices of these widths; longer ones go through a heap.
WIDTHS = (4, 8, 12, 16, 24, 32)
#: Characters of a block.
BLOCK = 1 << 20
_NEVER = np.int32(2**31 - 1)
_BITS = 18
#: Stands for a space mark in a text, beyond all code points.
_MARK = 0x110000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each element."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@dataclass
class Vocabulary:
    """size pieces; chars: by code point, a piece or -1; two hash tables of symbol pairs to ranks; rank -> piece."""

    size: int
    chars: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    texts: list[bytes]
    first_byte: int

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        import sentencepiece

        if not path:
            import public_tokenizers

            path = public_tokenizers.path(MODEL)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))}
        order = sorted((p for p in plain if len(p) > 1), key=lambda p: (-sp.get_score(plain[p]), plain[p]))
        chars = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                chars[ord(p)] = i
        pairs = {}
        for rank, p in enumerate(order):
            for k in range(1, len(p)):
                if p[:k] in plain and p[k:] in plain:
                    pairs[plain[p[:k]] * n + plain[p[k:]]] = rank
        first_byte = sp.piece_to_id("<0x00>")
        texts = [bytes([i - first_byte]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() if sp.id_to_piece(i) in plain else b"" for i in range(n)]
        return cls(n, chars, *cls.tables(pairs), np.array([plain[p] for p in order], np.int32), texts, first_byte)

    @staticmethod
    def slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys.astype(np.uint64) * _M1
        return (h >> np.uint64(64 - _BITS)).astype(np.int64), ((h >> np.uint64(8)) & np.uint64(2**_BITS - 1)).astype(np.int64) + 2**_BITS

    @classmethod
    def tables(cls, pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Every pair in one of its two slots."""
        keys, ranks = np.full(2 << _BITS, -1, np.int64), np.full(2 << _BITS, _NEVER, np.int32)
        wanted = np.array(list(pairs), np.int64)
        for key, rank, *slots in zip(pairs, pairs.values(), *(x.tolist() for x in cls.slots(wanted)), strict=True):
            at = slots[0]
            for _ in range(500):
                key, keys[at] = int(keys[at]), key
                rank, ranks[at] = int(ranks[at]), rank
                if key < 0:
                    break
                one, two = (int(x[0]) for x in cls.slots(np.array([key])))
                at = two if at == one else one
            else:
                raise ValueError("the pairs do not fit their table")
        return keys, ranks

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of the merge of two symbols; _NEVER where there is none. Symbols from `size` on stand for characters outside the vocabulary."""
        key = left.astype(np.int64) * self.size + right
        key[(left >= self.size) | (right >= self.size)] = -2
        one, two = self.slots(key)
        return np.where(self.keys[one] == key, self.ranks[one], np.where(self.keys[two] == key, self.ranks[two], _NEVER))


class Encoder:
    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
        self.v, self.seed = vocabulary, seed
        self.limit = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))

    def offered(self, left: np.ndarray, right: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Ranks of candidates as they enter an agenda; the skipped ones never do."""
        rank = self.v.rank(left, right)
        if self.limit:
            with np.errstate(over="ignore"):
                skipped = mix(key + place.astype(np.uint64) * _M1 + rank.astype(np.uint64) * _M2) < self.limit
            rank = np.where(skipped, _NEVER, rank)
        return rank

    def matrix(self, sym: np.ndarray, length: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Merges words row by row; symbols that are gone become -1."""
        n, width = sym.shape
        sym, place = sym.ravel().copy(), np.arange(width)
        nxt = np.where(place + 1 < length[:, None], place + 1, -1).ravel()
        prv = np.broadcast_to(place - 1, (n, width)).ravel().copy()
        rank = np.full(n * width, _NEVER, np.int32)
        at = np.nonzero(nxt >= 0)[0]
        rank[at] = self.offered(sym[at], sym[at + 1], key[at // width], at % width)
        table, rows = rank.reshape(n, width), np.arange(n)
        while len(rows):
            best = table[rows]
            j = best.argmin(axis=1)
            best = best[np.arange(len(rows)), j]
            live = best != _NEVER
            rows, j, best = rows[live], j[live], best[live]
            at = rows * width + j
            gone = rows * width + nxt[at]
            sym[at], sym[gone], rank[gone] = self.v.made[best], -1, _NEVER
            after = nxt[gone]
            nxt[at] = after
            more = after >= 0
            rank[at] = _NEVER
            a, b = at[more], rows[more] * width + after[more]
            prv[b] = j[more]
            rank[a] = self.offered(sym[a], sym[b], key[rows[more]], j[more])
            less = prv[at] >= 0
            b = at[less]
            a = rows[less] * width + prv[b]
            rank[a] = self.offered(sym[a], sym[b], key[rows[less]], prv[b])
        return sym.reshape(n, width)

    def heap(self, sym: list[int], key: int) -> list[int]:
        """The same for one long word."""
        n = len(sym)
        nxt, prv, keys = [*range(1, n), -1], [*range(-1, n - 1)], np.array([key], np.uint64)
        first = self.offered(np.array(sym[:-1]), np.array(sym[1:]), np.broadcast_to(keys, (n - 1,)), np.arange(n - 1)) if n > 1 else []
        agenda = [(int(r), i, sym[i], sym[i + 1]) for i, r in enumerate(first) if r != _NEVER]
        heapq.heapify(agenda)

        def offer(i: int) -> None:
            j = nxt[i]
            r = self.offered(np.array([sym[i]]), np.array([sym[j]]), keys, np.array([i]))[0]
            if r != _NEVER:
                heapq.heappush(agenda, (int(r), i, sym[i], sym[j]))

        while agenda:
            r, i, left, right = heapq.heappop(agenda)
            j = nxt[i]
            if j < 0 or sym[i] != left or sym[j] != right:
                continue
            sym[i], sym[j] = int(self.v.made[r]), -1
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
                offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return sym

    def block(self, code: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all words, and how many each has. code: characters; start: of each word; key: a hash for each word."""
        v = self.v
        sym = np.where(code == _MARK, -1, v.chars[np.minimum(code, _MARK - 1)])
        sym = np.where(sym < 0, v.size + code.astype(np.int64), sym)
        length = np.diff(np.concatenate([start, [len(code)]]))
        counts, found = np.zeros(len(start), np.int64), []
        low = 0
        for width in (*WIDTHS, None):
            mine = np.nonzero((length > low) & (length <= width))[0] if width else np.nonzero(length > low)[0]
            if width is None:
                for w in mine:
                    a = start[w]
                    out = np.array(self.heap(sym[a : a + length[w]].tolist(), int(key[w])))
                    found.append((np.array([w]), out[out >= 0]))
                    counts[w] = len(found[-1][1])
            elif len(mine):
                place = np.arange(width)
                inside = place < length[mine, None]
                rows = np.where(inside, sym[np.minimum(start[mine, None] + place, len(sym) - 1)], -1)
                out = self.matrix(rows, length[mine], key[mine])
                here = out >= 0
                counts[mine] = here.sum(axis=1)
                found.append((mine, out[here]))
            low = width
        total = np.concatenate([[0], np.cumsum(counts)])
        pieces = np.empty(total[-1], np.int64)
        for mine, flat in found:
            c = counts[mine]
            pieces[np.repeat(total[mine] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(len(flat))] = flat
        return self.bytes_out(pieces, counts)

    def bytes_out(self, pieces: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary as byte pieces."""
        odd = np.nonzero(pieces >= self.v.size)[0]
        if not len(odd):
            return pieces.astype(np.int32), counts
        values, which = np.unique(pieces[odd] - self.v.size, return_inverse=True)
        raw = [(SPACE if x == _MARK else chr(x)).encode("utf-8", "surrogatepass") for x in values.tolist()]
        lens = np.ones(len(pieces), np.int64)
        lens[odd] = np.array([len(x) for x in raw])[which]
        ends = np.cumsum(lens)
        out = np.empty(ends[-1], np.int32)
        out[ends - lens] = np.where(pieces < self.v.size, pieces, 0)
        four = np.array([list(x.ljust(4, b"\0")) for x in raw], np.int64)
        for k in range(4):
            has = lens[odd] > k
            out[(ends - lens)[odd][has] + k] = self.v.first_byte + four[which[has], k]
        word = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(word, lens, len(counts)).astype(np.int64)

    def encode(self, texts: list[bytes], ids: list[object]) -> list[np.ndarray]:
        """Pieces of each text; ids key the dropout."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        codes, starts, keys, owners, size = [], [], [], [], 0

        def flush() -> None:
            nonlocal size
            if codes:
                pieces, counts = self.block(np.concatenate(codes), np.concatenate(keys), np.concatenate(starts))
                owner = np.concatenate(owners)
                edge = np.concatenate([[0], np.nonzero(np.diff(owner))[0] + 1])
                ends = np.concatenate([[0], np.cumsum(counts)])
                for a, b in zip(edge, [*edge[1:], len(owner)], strict=True):
                    out[owner[a]].append(pieces[ends[a] : ends[b]])
            for x in (codes, starts, keys, owners):
                x.clear()
            size = 0

        for i, (text, key) in enumerate(zip(texts, ids, strict=True)):
            if not text:
                continue
            code = np.frombuffer(text.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
            mark = code == ord(SPACE)
            code = np.concatenate([[np.uint32(32)], code])
            space = code == 32
            # A mark in the text is no space: it must come back as itself.
            code = np.where(space, np.uint32(ord(SPACE)), code)
            if mark.any():
                code[1:][mark] = np.uint32(_MARK)
            start = np.nonzero(space & ~np.concatenate([[False], space[:-1]]))[0]
            seed = np.uint64(xxhash.xxh64_intdigest(repr(key), self.seed & (2**64 - 1)))
            with np.errstate(over="ignore"):
                word = mix(seed + np.arange(len(start), dtype=np.uint64) * _M1)
            # Long texts in blocks of whole words.
            a = 0
            while a < len(start):
                b = len(start) if len(code) - start[a] <= BLOCK else max(a + 1, int(np.searchsorted(start, start[a] + BLOCK)))
                end = start[b] if b < len(start) else len(code)
                if size and size + end - start[a] > BLOCK:
                    flush()
                codes.append(code[start[a] : end])
                starts.append(start[a:b] - start[a] + size)
                keys.append(word[a:b])
                owners.append(np.full(b - a, i))
                size += int(end - start[a])
                a = b
        flush()
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]


def decode(pieces: np.ndarray, texts: list[bytes]) -> bytes:
    """The text of pieces; texts: bytes of each piece."""
    return b"".join(map(texts.__getitem__, pieces.tolist()))[1:]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED, model: str | None = None) -> DataFrame:
    """(id, text, pieces): pieces as an array of ids."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.load(model), dropout, seed)
        for part, texts in slices(batches, "text", 1 << 20):
            found = encoder.encode(texts, column(part, "id").to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found]), pa.int32()))
            yield pa.RecordBatch.from_arrays([column(part, "id"), column(part, "text"), arrays], ["id", "text", "pieces"])

    return source.mapInArrow(run, f"id {kind}, text string, pieces array<int>").withColumnsRenamed({"id": id_col, "text": text_col})


def decoded(rows: DataFrame, pieces_col: str = "pieces", model: str | None = None) -> DataFrame:
    """rows with decoded (binary) and pieces_crc32 (of little-endian 32-bit ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Vocabulary.load(model).texts
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                found = column(batch, pieces_col)
                flat, ends = found.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(found).fill_null(0).to_numpy(zero_copy_only=False))])
                parts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                more = [pa.array([decode(x, texts) for x in parts], pa.binary()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "decoded", "pieces_crc32"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType()), T.StructField("pieces_crc32", T.LongType())]))


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, pieces_crc32, decoded_bytes, lossless)."""
    rows = decoded(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), "pieces_crc32", F.octet_length("decoded").cast("bigint").alias("decoded_bytes"), (F.col("decoded") == F.col("text").cast("binary")).alias("lossless"))
