"""Token ids by the tokenizers library, a word at a time.

The tokenizer used here lower-cases, drops white space, never joins what stands on
both sides of it and parts letters, single digits and runs of marks. So a text's ids
are its words' ids in a row, a word's are its parts', and each new part goes through
the library once and is remembered. Plain Latin letters need no normalisation but
lower case and go to the library's BPE model directly; words that hold anything
else, and whole texts that may spell a special token or hold combining accents, take
its full path. `tests/llm` hold this against encoding whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker remembers (about 230 bytes each); beyond that it starts anew.
REMEMBERED = 700_000
TOKENIZER = "word_bpe_49k.json"
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: Words that fall into letters, digits and marks; apostrophes begin endings of their own, so they are not among the marks.
_PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_MIXED = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
#: Bytes that are a mark by themselves behind letters.
_MARK = np.isin(np.arange(256), list(b"!,.:;?)"))
_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))


def resolve(path: str | None) -> str:
    """path, or the place of the installed public vocabulary on this machine."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: printable Latin-1 bytes stand for themselves, the others for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _parted(words: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Words with a mark behind lower-case letters a-z as two words each; and how many there are before each word, and in all."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words) or ends[0] == ends[-1]:
        return words, np.zeros(len(words) + 1, np.int64)
    letters = np.frombuffer(data, np.uint8)
    others = np.zeros(ends[-1] + 1, np.int32)
    np.cumsum(~_LETTER[letters[: ends[-1]]], out=others[1:])
    last = np.maximum(ends[1:] - 1, ends[:-1])
    parted = (last > ends[:-1]) & (others[last] == others[ends[:-1]]) & _MARK[letters[np.minimum(last, ends[-1] - 1)]]
    at = np.flatnonzero(parted)
    offsets = np.insert(ends, at + 1, last[at])
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), data), np.concatenate([[0], np.cumsum(parted)])


class WordIds(dict):
    """Lower-case UTF-8 word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str | None = None, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.remembered, self.letters = Tokenizer.from_file(resolve(path)), remembered, _byte_letters()
        self.model = self.library.model
        # The library's own memory of words is of no use here: a word comes to it once.
        self.model._resize_cache(0)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.remembered:
            self.clear()
        if word.isalpha() and word.islower():
            found = self[word] = array("I", [t.id for t in self.model.tokenize(word.decode())]).tobytes()
            return found
        text = word.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text):
            if not text.isascii():
                text = word.decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        elif _MIXED.fullmatch(text) and (parts := [p.lower().encode() for p in _PARTS.findall(text)]) != [word]:
            found = b"".join([self[p] for p in parts])
        else:
            found = self._library(text)
        self[word] = found
        return found

    def _library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def whole(text: bytes) -> bool:
        """Whether a text has to be encoded whole."""
        # Accents apart from their letters compose differently once the letter is lower case.
        return b"<|" in text or b"\xcc" in text or b"\xcd" in text

    def encode(self, text: bytes) -> bytes:
        """A text's ids, little-endian unsigned 32-bit."""
        if self.whole(text):
            return self._library(text.decode("utf-8", "replace"))
        return b"".join(map(self.__getitem__, text.lower().split()))

    def encode_all(self, texts: list[bytes], tail: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has), each with those of `tail` behind it; a word is looked up once for all texts."""
        whole = [i for i, text in enumerate(texts) if self.whole(text)]
        rest = [text.lower() for text in texts]
        for i in whole:
            rest[i] = b""
        # Texts need not be valid UTF-8: only bytes of white space count here.
        lists = pc.ascii_split_whitespace(pa.array(rest, pa.large_binary()).view(pa.large_string()))
        words, marks = _parted(lists.flatten())
        words = words.dictionary_encode()
        ids = list(map(self.__getitem__, words.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()))
        # The tail is a word at the end of each text; a text that is encoded whole is one word with it.
        last = np.full(len(texts), len(ids))
        last[whole] = len(ids) + 1 + np.arange(len(whole))
        ids += [tail, *(self._library(texts[i].decode("utf-8", "replace")) + tail for i in whole)]
        ends = lists.offsets.to_numpy()[1:].astype(np.int64) - int(lists.offsets[0].as_py())
        ends += marks[ends]
        words = np.insert(words.indices.to_numpy().astype(np.int64), ends, last)
        ends += np.arange(1, len(texts) + 1)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        start, n = np.cumsum(size) - size, size[words]
        upto = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(start[words] - upto[:-1], n)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(ids), "<u4")[at], np.diff(upto[ends], prepend=0)


@cache
def shared_words(path: str | None = None) -> WordIds:
    """One table a worker, which its tasks share."""
    return WordIds(path)
