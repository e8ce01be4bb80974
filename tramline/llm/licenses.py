"""Licence scans through a positional index of rare words.

Templates are whole licence texts, and the standard notices that files carry for licences
too long to be carried themselves. Every template is held as word positions, and the index
holds for each licence word where it stands in which templates. How rare a word is comes from
the number of documents that hold it, counted over all documents. Of a file, the rarest of the
words that it shares with a template are looked up, and their places in both say where the
template would start: postings are intersected by relative position, as far shifted as an edited
copy may be. Where enough of these words agree, the template counts if all its mandatory key
phrases stand within the stretch, word for word, and the stretch has most of its words.
Of each base phrase the rarest word is looked up, and the phrase verified around every place of it.

Nulls: a null text is an empty text, without words, places or labels. Very long
texts cost time in proportion. Repeated rows and ties give equal results. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import column, slices

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# The standard notices of public licences, and the phrases that must stand in each.
NOTICES = {
    "agpl": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["affero general public license"]),
    "apache": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ["apache license"]),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["source and binary forms"]),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["related or neighboring rights"]),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license"]),
    "lgpl": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["lesser general public license"]),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ["mozilla public license"]),
}
# Whole licence texts and the phrases that must stand in each.
TEXTS = {
    "bsd": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        ["source and binary forms", "this list of conditions and the following disclaimer"],
    ),
    "boost": (
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software,
        and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
        unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
        ["accompanying documentation covered by this license"],
    ),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        ["with or without fee"],
    ),
    "mit": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ["free of charge", "associated documentation files"],
    ),
    "unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
        We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
        ["free and unencumbered software"],
    ),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
        ["must not be misrepresented"],
    ),
}
#: Rarest words of a file that say where a template starts, the share of them that must agree, and the share of a template's words that must be there.
VOTERS, AGREE, COVERED = 12, 0.6, 0.7
#: Words by which an edited copy may be shifted: so many, and one more for so many words of the template.
SHIFT, SHIFT_EACH = 2, 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and anything beyond ASCII."""
    return text.translate(_TABLE).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[list[bytes]]

    def __post_init__(self) -> None:
        self.counts = Counter(self.words)
        self.shift = SHIFT + len(self.words) // SHIFT_EACH

    def share(self, stretch: list[bytes]) -> float:
        """The share of the template's words that a stretch of a file has, 0 without one of the key phrases."""
        if any(not any(stretch[k : k + len(key)] == key for k, w in enumerate(stretch) if w == key[0]) for key in self.keys):
            return 0.0
        return (self.counts & Counter(stretch)).total() / len(self.words)


TEMPLATES = [Template(label, words(text.encode()), [k.encode().split() for k in keys]) for held in (NOTICES, TEXTS) for label, (text, keys) in held.items()]
VOCABULARY = frozenset(w for t in TEMPLATES for w in t.words) | {w.encode() for p in PHRASES for w in p.split()}


@dataclass
class Index:
    """anchors: rarest word -> [(phrase words, its place in them, label)]; postings: word -> {template's number: its places there}; idf by word."""

    anchors: dict[bytes, list[tuple[list[bytes], int, str]]]
    postings: dict[bytes, dict[int, list[int]]]
    idf: dict[bytes, float]

    @classmethod
    def build(cls, holders: dict[bytes, int], n_docs: int) -> Index:
        idf = {w: float(np.log((n_docs + 1) / (holders.get(w, 0) + 1))) for w in VOCABULARY}
        anchors, postings = defaultdict(list), defaultdict(dict)
        for phrase, label in PHRASES.items():
            parts = phrase.encode().split()
            at = max(range(len(parts)), key=lambda i: (idf[parts[i]], -i))
            anchors[parts[at]].append((parts, at, label))
        for k, template in enumerate(TEMPLATES):
            for i, w in enumerate(template.words):
                postings[w].setdefault(k, []).append(i)
        return cls(dict(anchors), dict(postings), idf)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], dict[str, float]]:
        """(words, base places with labels, the method's labels with the share of their template's words)."""
        w = words(text)
        there = VOCABULARY.intersection(w)
        places = []
        if not self.anchors.keys().isdisjoint(there):
            for i, x in enumerate(w):
                for parts, at, label in self.anchors.get(x, ()):
                    if i >= at and w[i - at : i - at + len(parts)] == parts:
                        places.append((i - at, label))
        noted: dict[str, float] = {}
        if wanted := self.possible(there):
            at = defaultdict(list)
            for i, x in enumerate(w):
                if x in there:
                    at[x].append(i)
            for k in wanted:
                if (share := self.best(k, w, at)) >= COVERED:
                    noted[TEMPLATES[k].label] = max(share, noted.get(TEMPLATES[k].label, 0.0))
        return len(w), sorted(places), noted

    def possible(self, there: frozenset[bytes]) -> list[int]:
        """Templates of which a file that holds these licence words can have enough words, and all words of their key phrases."""
        found = []
        for k, t in enumerate(TEMPLATES):
            if all(x in there for key in t.keys for x in key) and sum(n for x, n in t.counts.items() if x in there) >= COVERED * len(t.words):
                found.append(k)
        return found

    def best(self, k: int, w: list[bytes], at: dict[bytes, list[int]]) -> float:
        """The largest share of a template's words in a stretch of a file where its rarest shared words agree on a start."""
        template = TEMPLATES[k]
        rare = sorted((x for x in template.counts if x in at), key=lambda x: (-self.idf[x], x))[:VOTERS]
        starts = sorted((p - q, v) for v, x in enumerate(rare) for p in at[x] for q in self.postings[x][k])
        need, held, low, most, done = int(np.ceil(AGREE * len(rare))), Counter(), 0, 0.0, None
        for start, v in starts:
            held[v] += 1
            while starts[low][0] < start - template.shift:
                held[starts[low][1]] -= 1
                if not held[starts[low][1]]:
                    del held[starts[low][1]]
                low += 1
            if len(held) >= need and starts[low][0] != done:
                done = starts[low][0]
                most = max(most, template.share(w[max(0, done - template.shift) : start + len(template.words) + template.shift]))
        return most


def holders(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """How many documents hold each licence word, and the number of documents: at most one row for each of the VOCABULARY's words comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for _, texts in slices(batches, "text"):
            found[""] += len(texts)
            for t in texts:
                found.update(w.decode() for w in VOCABULARY.intersection(words(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"].encode(): r["n"] for r in rows}
    return counts, counts.pop(b"", 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Labels are distinct, sorted and joined by commas. score is 1 with a base phrase, else
    the largest share of a template's words that is there, else 0.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index.build(*holders(docs, text_col)))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            rows = []
            for t in texts:
                n, places, noted = index.value.scan(t)
                base = {label for _, label in places}
                first, last = (places[0][0], places[-1][0]) if places else (None, None)
                rows.append((n, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | noted.keys())), 1.0 if base else max(noted.values(), default=0.0)))
            n = pa.int64()
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (n, n, n, n, pa.string(), pa.string(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([column(part, "id"), *cols], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    out = source.mapInArrow(run, f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
    return out.withColumnRenamed("id", id_col)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
