"""Byte-level BPE, resampling and the divergence audit against plain versions; the registered queries on the smallest tables."""

import collections
import hashlib
import math
import os
import random
import re
import zlib
from array import array

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tramline.llm import byte_bpe, divergence, queries, resampling

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ODD = [None, "", " ", "\n\t\x0b", "one", "One TWO", "é ñ ß İ 中文 🙂", "a\x00b \x1c c\x85d\xa0e", "x" * 5000, "the same line\n" * 40, "don't we'll I'VE '' 'r 'rex", "  two   spaces \t tab", "<|endoftext|> and ▁ marks", "*** ### 123456 ٣٤ Ⅷ", "\U000107bb\U00010940 \U00011de0", "中" * 700 + "🙂" * 50]
ALPHABET = st.sampled_from(list("abehinorst ETS'") + ["\n", "\t", "12", "é", "中", "🙂", "the", " of", "'re", "..."])


@pytest.fixture(scope="module")
def pieces():
    return byte_bpe.PieceIds(byte_bpe.Vocabulary.from_file())


@pytest.fixture(scope="module")
def library(pieces):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces.vocabulary.ranks, special_tokens={})


def mixed(rng, docs=140):
    """(doc_id, text, lang, source, n): a hot source, repeated rows and ids, nulls everywhere, names that operators use themselves."""
    words = "alpha Beta gamma's delta_x épsilon zeta9 eta THETA iota-kappa λάμδα mu".split()
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "1", "!"]) for _ in range(rng.randrange(5, 60))) for _ in range(docs)] + ODD + ["word " * 3000]
    rows = [(i * 7 + 1, t, ("en", "fr", None)[i % 3], "hot" if i % 2 else f"s{i % 5}", i) for i, t in enumerate(texts)]
    rows += [(None, "alpha beta " * 15, "en", None, 0), rows[3], rows[3], (9_999, None, "xx", "lonely", 1), (9_998, "", "xx", "other", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, {} long"


# Byte-level BPE.


def test_ids_are_those_of_the_library(pieces, library):
    rng = random.Random(4)
    tokens = list(pieces.vocabulary.ranks)
    texts = [t or "" for t in ODD] + [b"".join(rng.choices(tokens, k=rng.randrange(1, 6))).decode("utf-8", "ignore") for _ in range(3000)]
    assert [array("I", pieces.encode(t)).tolist() for t in texts] == [library.encode_ordinary(t) for t in texts]


def test_every_prefix_has_its_own_encoding(pieces, library):
    rng = random.Random(5)
    for _ in range(50):
        data = "".join(rng.choice("abcdeiounrsthé中") for _ in range(rng.randrange(1, 60))).encode()
        table = byte_bpe.PrefixTable(pieces.vocabulary, data)
        for upto in range(len(data) + 1):
            merged = pieces.vocabulary.merged(data[:upto])
            whole = pieces.vocabulary.ranks.get(data[:upto])
            assert table.ids(upto) == (merged if whole is None or not upto else [whole])


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=40), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9), st.lists(ALPHABET, max_size=6)), max_size=8))
def test_edits_leave_what_a_new_encoding_gives(pieces, library, start, edits):
    text = "".join(start)
    held, raw = byte_bpe.TextIds(pieces, text), byte_bpe.PrefixTable(pieces.vocabulary, text.encode())
    for at, n, new in edits:
        at, new = min(at, len(text)), "".join(new)
        end = min(len(text), at + n)
        begin, stop = len(text[:at].encode()), len(text[:end].encode())
        raw.replace(begin, stop, new.encode())
        held.replace(at, end, new)
        text = text[:at] + new + text[end:]
        assert held.text == text and held.ids() == library.encode_ordinary(text)
        assert raw.data == text.encode() and raw.last == byte_bpe.PrefixTable(pieces.vocabulary, text.encode()).last
    held.append(" more")
    assert held.ids() == library.encode_ordinary(text + " more")


def test_edits_touch_little_of_a_long_text(pieces, library):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(5000))
    held = byte_bpe.TextIds(pieces, text)
    assert held.replace(12_000, 12_004, "zz top") < 12 and held.append("end") < 6
    long = byte_bpe.PrefixTable(pieces.vocabulary, text.replace(" ", "").encode())
    assert long.replace(9_000, 9_001, b"q") < 3 * pieces.vocabulary.longest


def test_vocabularies_in_any_order_of_ranks():
    """Parts of a token that rank behind it: neighbours are then tried by merging."""
    rng = random.Random(7)
    singles = [bytes([b]) for b in range(256)]
    some = ["ab", "abc", "bc", "ca", "cab", "aa", "bb", "abab", "cc", "bcab"]
    for _ in range(20):
        order = singles + [s.encode() for s in rng.sample(some, len(some))]
        v = byte_bpe.Vocabulary({t: i for i, t in enumerate(order)})
        for _ in range(200):
            data = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))).encode()
            if v.ordered:
                assert byte_bpe.PrefixTable(v, data).ids() == ([v.ranks[data]] if data in v.ranks else v.merged(data))
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({b"a": 0})


def test_forgotten_pieces_are_worked_out_again(pieces, library):
    small = byte_bpe.PieceIds(pieces.vocabulary, remembered=3)
    text = "one two three four five one two six one seven " * 5
    assert array("I", small.encode(text)).tolist() == library.encode_ordinary(text) and len(small) <= 3


def test_round_trip_of_documents(spark, library):
    rows = mixed(random.Random(8))
    docs = spark.createDataFrame(rows, SCHEMA.format("ids")).repartition(3)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), digest(array("I", ids).tobytes()), digest((text or "").encode())))
    found = byte_bpe.round_trip(docs)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0


# Resampling.


def plain_words(text, letters):
    return re.findall(letters, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_resampling(docs, target, share=25):
    def features(text):
        w = plain_words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        return len(w), [*w, *map(" ".join, zip(w, w[1:]))]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (collections.Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([d[1] for d in docs], target))
    every, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (every + 10_000) / ((s[b] + 1) * (wanted + 10_000)))) for b in range(10_000)]
    out = []
    for i, text, *_ in docs:
        n, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[0] >= 20), key=lambda x: (-x[4], x[1] is not None, x[1] or 0))
    drawn = share * len(able) // 100
    ranks = [(x, k if k <= drawn else None) for k, x in enumerate(able, 1)] + [(x, None) for x in out if x[0] < 20]
    return sorted(((*x[1:], r) for x, r in ranks), key=str)


@pytest.mark.parametrize("nodes, block", [(1_000_000, 1 << 20), (50, 64)])
def test_resampling(spark, monkeypatch, nodes, block):
    """With tries that start anew all the time and texts in blocks too."""
    monkeypatch.setattr(resampling, "NODES", nodes)
    monkeypatch.setattr(resampling, "BLOCK", block)
    rows = mixed(random.Random(9))
    docs = spark.createDataFrame(rows, SCHEMA.format("score")).repartition(5)
    target = ["alpha beta gamma", None, "", "ZETA9 zeta9 mu", "épsilon λάμδα " * 4]
    found = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_resampling(rows, target)


def test_resampling_without_rows(spark):
    docs, target = (spark.createDataFrame([(1, "a b c")], "doc_id long, text string") for _ in range(2))
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert resampling.resample(docs, target.limit(0)).first()["rank"] is None


def test_crc_states_follow_each_other():
    rng, shift = random.Random(10), resampling.Shift()
    pairs = [(os.urandom(rng.randrange(0, 30)), os.urandom(rng.randrange(1, 700))) for _ in range(300)]
    first, second = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    joined = shift.joined(first, second, np.array([len(b) for _, b in pairs]))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("width", [1, 2, 4])
def test_tries_count_runs_of_any_width(width):
    texts = [b"a b a b a c", b"", b"a b a", b"c"]
    trie, runs = resampling.Trie(width), collections.Counter()
    trie.walk(texts)
    trie.walk(texts[:1])
    for t in [*texts, texts[0]]:
        w = t.split()
        runs.update(b" ".join(w[i : i + n]) for n in range(1, width + 1) for i in range(len(w) - n + 1))
    want = np.zeros(997, np.int64)
    for run, n in runs.items():
        want[zlib.crc32(run) % 997] += n
    assert trie.totals(997).tolist() == want.tolist() and trie.nodes == len(runs)


# Divergence.


def plain_divergence(docs):
    groups, times, seen = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source, *_ in docs:
        lang, source = lang or "", source or ""
        terms = plain_words(text, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
        groups[lang, source].update(terms)
        times[lang].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= 30]
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q, p = shares(times[lang]), {s: shares(c) for (l, s), c in groups.items() if l == lang}
        for s in p:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, 50)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


@pytest.mark.parametrize("held", [1_000_000, 3])
def test_divergence(spark, monkeypatch, held):
    """Over four shards; with counts handed on after every slice too."""
    monkeypatch.setattr(divergence, "HELD", held)
    rows = mixed(random.Random(11), 400)
    docs = spark.createDataFrame(rows, SCHEMA.format("term")).repartition(5)
    found = divergence.audit(docs)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plain_divergence(rows)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_best_terms_are_the_whole_tables(spark):
    """More than 50 terms above the language's share, spread over shards, with ties."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    rows = [(i, " ".join(words[:75] * (1 + i % 2) + words[75:] if i < 40 else words), "en", "a" if i < 40 else "b", 0) for i in range(80)]
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA.format("x")))
    assert sorted(map(tuple, found.collect())) == plain_divergence(rows)


# The registered queries on the tables.


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    found, want = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted(map(tuple, found.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_query_of_byte_bpe_on_the_tables(spark, library):
    texts = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{DATA}/documents.parquet'").fetchall())
    found = {r["doc_id"]: r for r in queries.op13_byte_bpe(spark, DATA).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode_ordinary(text)
        assert found[i]["n_tokens"] == len(ids) and found[i]["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
