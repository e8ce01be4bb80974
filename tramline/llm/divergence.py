"""How much the sources of a language differ in their words.

For each source of a language, smoothed shares of the language's terms are compared with
those of every other source (`pair`: the sum of absolute differences over all terms) and
with those of the whole language (`term`: the terms that the source has more of). All
arithmetic is on whole numbers.

Texts are parted and counted batch by batch; what leaves a task is one row a (language,
source, term) and flush, which Spark adds up. Rows are then dealt into shards by a hash of
language and term, so that all sources' rows of a term, at most one each, meet in one shard; the
number of shards grows with the counted rows. DuckDB holds one shard at a time in a task: a
first query sums counts and leaves the terms that are in enough documents; after Spark has
added up the totals of groups and languages, a second gives the shard's part of every
pair's sum and its best terms. Spark adds up these parts and ranks. A source with a third of
all documents is one row a term like any other by then.

Terms are `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. Nulls: a null
text, language or source is an empty one; ids are not needed. Empty texts have no terms,
but their (language, source) takes part in all pairs. A language without kept terms has
pairs of value 0 and no term rows. Repeated rows count as often as they occur. Ties are
ordered by the item's bytes. Very long texts are parted block by block. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import column, materialize, slices

LEAST_DOCS, TOP, SMOOTH, UNIT = 30, 50, 5, 1_000_000_000
#: Counted rows a shard holds on average, before and after rare terms are gone, and counts a task keeps before it hands them on.
SHARD_ROWS, KEPT_ROWS, HELD = 400_000, 50_000, 1_000_000
#: Bytes of a text that are parted into terms at a time.
BLOCK = 1 << 20
#: A-Z lower-cased; ASCII other than letters becomes a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

KEPT = f"""with c as (select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from shard group by all)
  select lang, source, term, n, row_number() over (partition by lang, term order by source) = 1 as leads
  from c qualify sum(docs) over (partition by lang, term) >= {LEAST_DOCS}"""
#: Shares of every kept term in all groups of its language, and in the language itself.
SHARES = f"""create temp table share as with
  t as (select lang, term, sum(n)::hugeint as n from shard group by all)
  select t.lang, g.source, t.term, coalesce(s.n, 0) > 0 as there,
    (1 + {UNIT}::hugeint * (coalesce(s.n, 0) + {SMOOTH}) // (g.total + {SMOOTH}::hugeint * g.terms))::bigint as p,
    (1 + {UNIT}::hugeint * (t.n + {SMOOTH}) // (g.lang_total + {SMOOTH}::hugeint * g.terms))::bigint as q
  from t join groups g using (lang) left join shard s on s.lang = t.lang and s.source = g.source and s.term = t.term"""
PARTS = f"""select 'pair' as part, a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value
  from share a join share b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all
union all select 'term', lang, source, term, p - q from share where there and p > q
  qualify row_number() over (partition by lang, source order by p - q desc, term) <= {TOP}"""


class Counts:
    """Occurrences and documents of terms by (language, source), until they are handed on."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.codes, self.n, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _numbers(self, text: bytes) -> np.ndarray:
        text, begin, out, number = text.translate(_TERMS), 0, [np.zeros(0, np.int64)], self.terms
        while begin < len(text):
            end = text.find(b" ", begin + BLOCK)
            words = text[begin : end if end >= 0 else len(text)].split()
            out.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
            begin = end if end >= 0 else len(text)
        return np.concatenate(out)

    def add(self, langs: list[str], sources: list[str], texts: list[bytes]) -> None:
        numbers = [self._numbers(t) for t in texts]
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources)], np.int64)
        sizes = np.array([len(x) for x in numbers], np.int64)
        flat, owner = np.concatenate(numbers), np.repeat(np.arange(len(texts)), sizes)
        # Once a (document, term) for documents, then once a (group, term).
        pairs, times = np.unique(owner << 32 | flat, return_counts=True)
        codes, back = np.unique(group[pairs >> 32] << 32 | pairs & 0xFFFFFFFF, return_inverse=True)
        n, docs = np.zeros(len(codes), np.int64), np.bincount(back.reshape(-1), minlength=len(codes))
        np.add.at(n, back.reshape(-1), times)
        every, back = np.unique(np.append(self.codes, codes), return_inverse=True)
        back, held = back.reshape(-1), len(self.codes)
        sums, seen = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        sums[back[:held]], seen[back[:held]] = self.n, self.docs
        sums[back[held:]] += n
        seen[back[held:]] += docs
        self.codes, self.n, self.docs = every, sums, seen

    def rows(self) -> Iterator[pa.RecordBatch]:
        groups, terms = list(self.groups), pa.array(list(self.terms), pa.binary()).cast(pa.string())
        langs, sources = pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string())
        for i in range(0, len(self.codes), 100_000):
            code = self.codes[i : i + 100_000]
            group, term = pa.array(code >> 32), pa.array(code & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(term), pa.array(self.n[i : i + 100_000]), pa.array(self.docs[i : i + 100_000])], schema=_PARTIAL)


def partial_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): sums over some of the documents; several rows a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for part, texts in slices(batches, "text"):
            counts.add(column(part, "lang").to_pylist(), column(part, "source").to_pylist(), texts)
            if len(counts.codes) >= HELD:
                yield from counts.rows()
                counts = Counts()
        yield from counts.rows()

    return docs.select(F.col(text_col).alias("text"), *_groups(lang_col, source_col)).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def _groups(lang_col: str, source_col: str) -> list:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]


def _session() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


def kept_counts(partial: DataFrame, shards: int) -> DataFrame:
    """(lang, source, term, n, leads): whole counts of the terms in enough documents; one row a (lang, term) leads."""

    def run(_: tuple, shard: pa.Table) -> pa.Table:
        with _session() as con:
            con.register("shard", shard)
            return con.sql(KEPT).to_arrow_table().cast(pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("leads", pa.bool_())]))

    dealt = partial.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "lang string, source string, term string, n bigint, leads boolean")


def shard_parts(kept: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """(part, lang, source, item, value): sums over the shard's terms for pairs of sources, and the shard's best terms."""

    def run(_: tuple, shard: pa.Table, totals: pa.Table) -> pa.Table:
        schema = pa.schema([(c, pa.string()) for c in ("part", "lang", "source", "item")] + [("value", pa.int64())])
        if not shard.num_rows:
            return schema.empty_table()
        with _session() as con:
            con.register("shard", shard)
            con.register("groups", totals)
            con.execute(SHARES)
            return con.sql(PARTS).to_arrow_table().cast(schema)

    # A row a group for each shard: no more than the sums of pairs that leave it.
    every = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("shard", F.col("shard").cast("bigint"))
    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)))
    return dealt.groupBy("shard").cogroup(every.groupBy("shard")).applyInArrow(run, "part string, lang string, source string, item string, value bigint")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    partial = partial_counts(docs, text_col, lang_col, source_col)
    # From here on a term has a row a source, however many tasks counted it.
    counted = materialize(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "op12-counts")
    kept = materialize(kept_counts(counted, counted.count() // SHARD_ROWS + 1), "op12-kept")
    found = docs.select(*_groups(lang_col, source_col)).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("leads").cast("bigint")).alias("terms"))
    groups = materialize(found.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "terms"]), "op12-groups")
    parts = materialize(shard_parts(kept, groups, kept.count() // KEPT_ROWS + 1), "op12-parts")
    half = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.union(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # Every pair of a language's sources is a row of the result, whether or not it has terms.
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item"))
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
    terms = parts.where("part = 'term'").select("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))).alias("rank")
    return pairs.union(terms).select("*", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
