"""The registry of this subpackage's queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramline.llm.byte_bpe import op13_byte_bpe
from tramline.llm.divergence import op12_divergence
from tramline.llm.licenses import op6_license_scans
from tramline.llm.merge_dropout import op3_merge_dropout
from tramline.llm.mixing_coder import op8_token_ids
from tramline.llm.packing import op5_packing
from tramline.llm.quality_classifier import op2_quality_classifier
from tramline.llm.quality_rules import op7_quality_rules
from tramline.llm.resampling import op11_resampling
from tramline.llm.simhash import op1_simhash
from tramline.llm.suffix_tree import op9_lm_scoring
from tramline.llm.transport import op4_media_columns
from tramline.llm.warc import op10_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_quality_classifier, op3_merge_dropout, op4_media_columns, op5_packing, op6_license_scans, op7_quality_rules, op8_token_ids, op9_lm_scoring, op10_warc, op11_resampling, op12_divergence, op13_byte_bpe)}


#: 160-bit digests in base 32: four runs of ten hex digits give eight letters each.
OP10_WARC = """with p as (select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
  f as (select *, min(page_id) over (partition by html) as first_id from p)
select page_id, octet_length(encode(html))::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(hex, cast(i // 8 * 10 + 1 as bigint), 10) as bigint) >> cast(35 - i % 8 * 5 as bigint)) & 31 as bigint) + 1, 1)), '') as payload_digest,
  case when first_id < page_id then 'revisit' else 'response' end as record_type,
  case when first_id < page_id then first_id end as refers_to, url as target_uri from f"""


#: The CRC-32 of every distinct feature, byte by byte over a table of 256 steps.
OP11_RESAMPLING = """with steps as (select list(list_reduce(list_prepend(i, range(8)), lambda a, k: xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end)) order by i) as step from range(256) t(i)),
  texts as (select true as mine, doc_id as id, text from documents union all select false, item_id, text from benchmark),
  words as (select mine, id, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from (select mine, id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from texts)),
  features as (select mine, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from words),
  times as (select mine, id, f, count(*) as n from features group by all),
  coded as (select f, hex(encode(f)) as h from (select distinct f from times)),
  placed as (select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: cast('0x' || substr(h, cast(2 * i + 1 as bigint), 2) as bigint))), lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1])), 4294967295) % 10000 as bucket from coded, steps),
  totals as (select bucket, coalesce(sum(n) filter (mine), 0)::double as s, coalesce(sum(n) filter (not mine), 0)::double as t from times join placed using (f) group by bucket),
  sums as (select coalesce(sum(s), 0) as every, coalesce(sum(t), 0) as wanted from totals),
  gains as (select bucket, floor(1000 * ln((t + 1) * (every + 10000) / ((s + 1) * (wanted + 10000))))::bigint as gain from totals, sums),
  weights as (select id, sum(n * gain)::bigint as total, sum(n)::bigint as n from times join placed using (f) join gains using (bucket) where mine group by id),
  scored as (select id as doc_id, len(w) as n_words, coalesce(n, 0)::bigint as n_features, coalesce(floor(total / n), 0)::bigint as weight,
      cast('0x' || substr(sha256('7:' || id), 1, 8) as bigint) as h from words left join weights using (id) where mine),
  noisy as (select doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from scored),
  places as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_words >= 20) as able from noisy)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 25 * able // 100 then place end as rank from places"""

OP12_DIVERGENCE = """with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
  groups as (select distinct lang, source from d),
  times as (select id, lang, source, term, count(*) as n from (select id, lang, source, unnest(w) as term from d) group by all),
  kept as (select lang, term, sum(n) as n from times group by all having count(*) >= 30),
  counts as (select lang, source, term, sum(times.n) as n from times join kept using (lang, term) group by all),
  langs as (select lang, sum(n) as total, count(*) as terms from kept group by lang),
  sizes as (select lang, source, coalesce(sum(n), 0) as total from groups left join counts using (lang, source) group by all),
  shares as (select k.lang, s.source, k.term, coalesce(c.n, 0) > 0 as there, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 5) // (s.total + 5 * l.terms) as p, 1 + 1000000000::hugeint * (k.n + 5) // (l.total + 5 * l.terms) as q
    from kept k join langs l using (lang) join sizes s using (lang) left join counts c on c.lang = k.lang and c.source = s.source and c.term = k.term),
  sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
  pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
  parts as (select * from pairs union all select lang, source, 'term', term, p - q from shares where there and p > q)
select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from parts qualify part = 'pair' or rank <= 50"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a whole result; the other queries are held against brute force in tests/llm."""
    return {"op10_warc": OP10_WARC, "op11_resampling": OP11_RESAMPLING, "op12_divergence": OP12_DIVERGENCE}
