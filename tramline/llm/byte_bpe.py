"""Byte-level BPE by dynamic programming over prefixes.

A text is parted into pieces by the vocabulary's pattern, and each piece is encoded by
itself. Two neighbouring tokens are *compatible* if merging their joint bytes gives just
those two; a row of tokens is the encoding of its bytes exactly if each is what its own
bytes merge to and neighbours are compatible. So every prefix of a piece has exactly one
valid last token: the one among the tokens ending there that is compatible with the last
token of what it leaves. `PrefixTable` stores these last tokens. Reading them from the end
gives the encoding of any prefix; bytes appended need only their own entries; after an
edit entries are redone until as many in a row as the longest token has bytes are as they
were, from where on all others hold too. `TextIds` does the same for whole texts: it parts
anew from two pieces before an edit until boundaries meet the old ones.

A piece that is a token of its own is that token, whatever its merges give, as in the
library whose results these are. Characters' classes are asked of that library too, for
other regular-expression libraries follow other versions of Unicode.

Texts: a null text is an empty text and has no ids. Null and repeated ids are rows like any
other; the id may be of any type. Very long texts are parted and encoded piece by piece.
Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.common import column, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces that a worker remembers in each of two generations (about 220 bytes each), and pairs of tokens; beyond those it starts anew.
REMEMBERED, PAIRS = 250_000, 300_000
#: Pieces of a text in hand at a time.
PIECES = 100_000


def resolve(path: str | None) -> str:
    """path, or the place of the installed public vocabulary on this machine."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Vocabulary:
    """Byte strings by rank, which of them merging can give, and which may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary holds every single byte")
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.longest, self.never = max(map(len, ranks)), max(ranks.values()) + 1
        self.pairs: dict[int, bool] = {}
        #: What each token was last merged from; -1 for single bytes.
        self.left, self.right = [-1] * self.never, [-1] * self.never
        self.endings = ahocorasick.Automaton()
        for token, rank in ranks.items():
            parts, last = self._merge(token)
            if len(parts) == 1:
                self.endings.add_word(token.decode("latin-1"), (rank, len(token)))
                if last:
                    self.left[rank], self.right[rank] = ranks[last[0]], ranks[last[1]]
        self.endings.make_automaton()
        #: Parts come before what they make, as training leaves them.
        self.ordered = all(max(l, r) < i for i, (l, r) in enumerate(zip(self.left, self.right)))

    @classmethod
    def from_file(cls, path: str | None = None) -> Vocabulary:
        with open(resolve(path), "rb") as file:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)})

    def _merge(self, data: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """Merges the lowest-ranked union first, the leftmost of equals: the parts, and what the last union was made of. For short strings."""
        rank, never, last = self.ranks.get, self.never, None
        parts = [data[i : i + 1] for i in range(len(data))]
        union = [rank(a + b, never) for a, b in zip(parts, parts[1:])] + [never]
        while (best := min(union)) < never:
            i = union.index(best)
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [last[0] + last[1]]
            del union[i]
            if i + 1 < len(parts):
                union[i] = rank(parts[i] + parts[i + 1], never)
            if i:
                union[i - 1] = rank(parts[i - 1] + parts[i], never)
        return parts, last

    def merged(self, data: bytes) -> list[int]:
        return [self.ranks[p] for p in self._merge(data)[0]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' joint bytes gives just these two."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(left, right) if self.ordered else self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return found

    def _apart(self, x: int, y: int) -> bool:
        """Undoes the merges of both sides, the latest first, and looks whether those that touched were ever to be joined before either went on.

        Of equal ranks the leftmost goes first: a union within the left side before one across, that before one within the right side.
        """
        tokens, rank, never = self.tokens, self.ranks.get, self.never
        x_until = y_until = never
        while True:
            across = rank(tokens[x] + tokens[y], never)
            if across < x_until and across <= y_until and across < never:
                return False
            if self.left[x] >= 0 and (x > y or self.left[y] < 0):
                x_until, x = x, self.right[x]
            elif self.left[y] >= 0:
                y_until, y = y, self.left[y]
            else:
                return True


class PrefixTable:
    """The valid last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, b""
        self.last: list[int] = []
        self.append(data)

    def _fill(self, old: list[int] | None = None, settled: int = 0, shift: int = 0) -> bool:
        """Entries for the bytes that have none yet; True if it ended early, as entries from byte `settled` on equal the old ones, `shift` places before, for as long as a token can be."""
        v, last, begin = self.vocabulary, self.last, len(self.last)
        known, keep, back = v.pairs, self.last.append, max(0, begin - v.longest + 1)
        # Tokens that start before `back` end before `begin`.
        at, alike = begin, 0
        for stop, (token, n) in v.endings.iter((self.data[back:] if back else self.data).decode("latin-1")):
            stop += back
            if stop < at:
                continue
            if stop >= n:
                left = last[stop - n]
                fits = known.get(left << 32 | token)
                if not (v.compatible(left, token) if fits is None else fits):
                    continue
            keep(token)
            at = stop + 1
            if old is not None:
                alike = alike + 1 if stop >= settled and old[stop - shift] == token else 0
                if alike == v.longest:
                    return True
        return False

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill()

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Puts `new` in the place of bytes begin to end - 1; the number of entries that were worked out anew."""
        old, shift = self.last, len(new) - (end - begin)
        self.data, self.last = self.data[:begin] + new + self.data[end:], old[:begin]
        early = self._fill(old, begin + len(new), shift)
        done = len(self.last) - begin
        if early:
            self.last.extend(old[len(self.last) - shift :])
        return done

    def ids(self, upto: int | None = None) -> list[int]:
        """The encoding of the piece, or of its first `upto` bytes as a piece of their own."""
        at = len(self.data) if upto is None else upto
        whole = self.vocabulary.ranks.get(self.data if upto is None else self.data[:upto])
        if whole is not None:
            return [whole]
        found, last, tokens = [], self.last, self.vocabulary.tokens
        while at:
            found.append(last[at - 1])
            at -= len(tokens[found[-1]])
        return found[::-1]


@cache
def splitter(pattern: str | None = None, high: int = 0x110000) -> re.Pattern:
    """pattern (over letters, numbers and white space) with these classes written out as the library has them, for texts of characters below `high`."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}

    def ranges(name: str) -> str:
        asked, found = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=ranks, special_tokens={}), []
        for low in range(0, high, 256):
            block = "".join(map(chr, range(low, low + 256))) if not 0xD800 <= low < 0xE000 else ""
            for code in map(ord, bytes(asked.encode_ordinary(block)).decode()):
                if found and found[-1][1] == code - 1:
                    found[-1][1] = code
                else:
                    found.append([code, code])
        return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in found)

    classes = {name: ranges(name) for name in (r"\s", r"\p{L}", r"\p{N}")}
    out = []
    for part in re.split(r"(\[[^\]]*\])", (pattern or _public_pattern()).replace(r"\S", r"[^\s]")):
        around = "%s" if part.startswith("[") else "[%s]"
        for name, held in classes.items():
            part = part.replace(name, around % held)
        out.append(part)
    return re.compile("".join(out))


def split_for(text: str, pattern: str | None = None) -> re.Pattern:
    """The splitter with the shortest tables that do for text: Latin-1, the first 65,536 characters, or all."""
    try:
        text.encode("latin-1")
        high = 256
    except UnicodeEncodeError:
        high = 0x10000 if len(text.encode("utf-16-le")) == 2 * len(text) else 0x110000
    return splitter(pattern, high)


class PieceIds(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers.

    Of two generations: when one is full it becomes the old one, from which pieces that come again are taken over.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str | None = None, remembered: int = REMEMBERED):
        super().__init__()
        self.vocabulary, self.pattern, self.remembered = vocabulary, pattern, remembered
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            data = piece.encode()
            whole = self.vocabulary.ranks.get(data)
            found = array("I", PrefixTable(self.vocabulary, data).ids() if whole is None else [whole]).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.remembered:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        split = split_for(text, self.pattern)
        if len(text) < 16 * PIECES:
            return b"".join(map(self.__getitem__, split.findall(text)))
        pieces, out = (m[0] for m in split.finditer(text)), []
        while part := b"".join(map(self.__getitem__, islice(pieces, PIECES))):
            out.append(part)
        return b"".join(out)


class TextIds:
    """A whole text's encoding, kept up to date through edits."""

    def __init__(self, pieces: PieceIds, text: str = ""):
        self.pieces, self.text = pieces, ""
        self.starts: list[int] = []
        self.tables: list[PrefixTable] = []
        self.replace(0, 0, text)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, begin: int, end: int, new: str) -> int:
        """Puts `new` in the place of characters begin to end - 1; the number of pieces looked at anew."""
        shift = len(new) - (end - begin)
        self.text = self.text[:begin] + new + self.text[end:]
        # No piece but the two before the one at `begin` reads as far as there.
        first = max(0, bisect_right(self.starts, begin) - 3)
        starts, tables, at = [], [], self.starts[first] if first < len(self.starts) else 0
        rest = len(self.starts)
        for m in split_for(self.text, self.pieces.pattern).finditer(self.text, at):
            if m.start() >= begin + len(new):
                same = bisect_left(self.starts, m.start() - shift)
                if same < len(self.starts) and self.starts[same] == m.start() - shift:
                    rest = same
                    break
            starts.append(m.start())
            tables.append(self._table(first + len(tables), m[0].encode()))
        self.starts[first:] = starts + [s + shift for s in self.starts[rest:]]
        self.tables[first:] = tables + self.tables[rest:]
        return len(tables)

    def _table(self, place: int, data: bytes) -> PrefixTable:
        """The table of a piece, from the one in its place if that begins with the same bytes."""
        old = self.tables[place] if place < len(self.tables) else None
        if old is not None and old.data and data.startswith(old.data):
            grown = PrefixTable(self.pieces.vocabulary)
            grown.data, grown.last = old.data, list(old.last)
            grown.append(data[len(old.data) :])
            return grown
        return PrefixTable(self.pieces.vocabulary, data)

    def ids(self) -> list[int]:
        return [i for t in self.tables for i in t.ids()]


@cache
def shared_pieces(path: str | None = None, pattern: str | None = None) -> PieceIds:
    """One table a worker, which its tasks share."""
    return PieceIds(Vocabulary.from_file(path), pattern)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens, ids): ids are little-endian unsigned 32-bit integers in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared_pieces(path, pattern)
        for part, texts in slices(batches, "_text"):
            ids = [pieces.encode(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays([column(part, "_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(run, T.StructType([rows.schema["_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]))
    return out.withColumnRenamed("_id", id_col)


def decode(coded: DataFrame, ids_col: str = "ids", name: str = "decoded", path: str | None = None) -> DataFrame:
    """coded with the bytes that its ids stand for, as the column `name`, which replaces one of that name."""
    coded = coded.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared_pieces(path).vocabulary.tokens
        for part, ids in slices(batches, ids_col):
            raw = [b"".join(map(tokens.__getitem__, array("I", x))) for x in ids]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, name])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField(name, T.BinaryType())]))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256)."""
    return decode(encode(docs, id_col, text_col, path), path=path).select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
