"""One query for each operator of this subpackage, over its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.ann import ann_search
from sextant.llm.bpe_stream import encode_decode
from sextant.llm.decontaminate import contamination
from sextant.llm.divergence import source_divergence
from sextant.llm.html_extract import extract_text
from sextant.llm.langid import language_id
from sextant.llm.licenses import license_scan
from sextant.llm.licenses import oracle as license_oracle
from sextant.llm.line_dedup import line_dedup
from sextant.llm.quality import quality_scores
from sextant.llm.simhash import simhash_components
from sextant.llm.token_counts import token_counts
from sextant.llm.url_filter import url_filter
from sextant.llm.vector_codes import vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, from its whole html. A null or empty page has the empty text; ids may be null or repeat."""
    return extract_text(_table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document stands in benchmark windows of 13 words, and whose. Null and empty texts have no words;
    rows that repeat come back as often."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64-bit fingerprint of every document and the smallest doc_id that can be reached over links of 4 bits. Null and
    empty texts have the fingerprint zero; component_id is null only where no doc_id can be reached."""
    found = simhash_components(_table(spark, sf_dir, "documents"), size=4, bits=64, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and license notice or text found in it. Documents without any have no row."""
    return license_scan(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The co-trained score of every document; null and blank texts have score 0 and aren't kept."""
    found = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "score", "content_score", "meta_score", "keep")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out; null texts and texts without letters
    are `und`. Rows without a doc_id are not held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = language_id(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of those found for every twentieth vector, against all others; ties to the smaller vec_id. Unusable
    vectors take no part."""
    return ann_search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text; null texts are empty."""
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text and what they decode to, as digests; null texts are empty."""
    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that 10 documents or more share; null and empty texts are one empty line."""
    found = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product code of every usable vector, with what it loses, by itself and by label, and a digest of the codebooks."""
    return vector_codes(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


#: The list that urls are judged by: host, path, action.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_RULES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, the longest rule that fits and its verdict for every page's url; a url that none fits is allowed."""
    rules = spark.sql(f"select * from values {_RULES} as t(host, path, action)")
    found = url_filter(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's words are from those of every other source of its language, and its 200 most telling words."""
    return source_divergence(_table(spark, sf_dir, "documents"), min_docs=3, top=200)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _round(k: int) -> str:
    """Parts assigned to the codebooks of round k, and those of the next."""
    return f"""
a{k} as (select r, p, v, min({{'d': d, 'e': e}}) as best from (
  select x.r, x.p, x.v, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from x join c{k} c using (p)) group by r, p, v),
s{k} as (select p, e, list(m order by i) as v from (
    select p, best.e as e, i, ((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*))::bigint as m from a{k}, range(1, 1 + (select max(len(v)) from x)) t(i) group by all) group by p, e),
c{k + 1} as (select c.p, c.e, coalesce(s.v, c.v) as v from c{k} c left join s{k} s using (p, e))"""


ORACLES = {
    "op11_vector_codes": f"""
with kept as (select row_number() over (order by vec_id, embedding) as r, vec_id, label, embedding from embeddings where embedding is not null and len(list_filter(embedding, lambda z: z is null or not isfinite(z))) = 0),
x as (select r, p, list_transform(embedding[p * len(embedding) // 16 + 1 : (p + 1) * len(embedding) // 16], lambda z: floor(256 * z::double)::bigint) as v from kept, range(16) t(p)),
c0 as (select p, r - 1 as e, v from x where r <= 64),{_round(0)},{_round(1)},{_round(2).rpartition("s2 as")[0].rstrip().rstrip(",")},
o as (select r, string_agg(printf('%02x', best.e), '' order by p) as code, sum(best.d)::bigint as error from a2 group by r),
l as (select label, sum(error)::bigint as label_error from o join kept using (r) group by label)
select vec_id, code, error, label_error, (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from c2) as codebooks_sha256
from kept join o using (r) join l on kept.label is not distinct from l.label""",
    "op12_url_filter": f"""
with u as (select row_number() over () as r, page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
h as (select r, page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
rules as (select * from (values {_RULES}) t(host, path, action)),
fit as (select h.r, arg_max({{'rule': rules.host || rules.path, 'action': action}}, length(rules.host || rules.path)) as best
  from h join rules on (h.host = rules.host or ends_with(h.host, '.' || rules.host)) and starts_with(h.path, rules.path) group by h.r)
select page_id, host, path, best.rule as rule, coalesce(best.action, 'allow') as verdict from h left join fit using (r)""",
    "op13_source_divergence": rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct r) >= 3),
v as (select lang, count(*) as v from kept group by lang),
g as (select distinct lang, source from d),
c as (select t.lang, t.source, t.term, count(*) as n from t join kept using (lang, term) group by all),
full_ as (select g.lang, g.source, kept.term, coalesce(c.n, 0)::hugeint as n from g join kept using (lang) left join c using (lang, source, term)),
tot as (select lang, source, sum(n) as total from full_ group by all),
p as (select f.*, 1 + (1000000000 * (n + 1)) // (total + v) as p from full_ f join tot using (lang, source) join v using (lang)),
lt as (select lang, term, sum(n) as n from full_ group by all),
ln as (select lang, sum(n) as total from lt group by lang),
q as (select lt.lang, lt.term, 1 + (1000000000 * (n + 1)) // (total + v) as q from lt join ln using (lang) join v using (lang)),
sums as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b using (lang, term) group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sums.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source),
term as (select p.lang, p.source, 'term' as part, p.term as item, ((p - q) * (p - q)) // q as value from p join q using (lang, term) where n > 0 and p > q),
both_ as (select * from pair union all select * from term)
select lang, source, part, item, value::bigint as value, rank::integer as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from both_) where part = 'pair' or rank <= 200""",
    "op4_license_scan": license_oracle(),
    "op2_decontaminate": rf"""
with d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as k from b where len(w) > 0)),
sizes as (select distinct n from win),
occ as (
  select doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)),
m as (select o.doc_id, o.k, o.n, win.item_id from occ o join win on o.s = win.s and o.n = win.n),
hit as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(range(k, k + n)) as p from m) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items from (select distinct doc_id, cast(item_id as varchar) as i from m where item_id is not null) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(hit.n_hit, 0) as n_hit, coalesce(it.n_items, 0) as n_items,
  sha256(coalesce(it.items, '')) as items_sha256, coalesce(hit.n_hit, 0) > 0 and 20 * coalesce(hit.n_hit, 0) >= len(d.w) as contaminated
from d left join hit using (doc_id) left join it using (doc_id)""",
    "op10_line_dedup": rf"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (
  select r, doc_id, k, ls[k] as line, trim({_LOWER.format("ls[k]")}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key
  from (select r, doc_id, ls, unnest(range(1, len(ls) + 1)) as k from d)),
often as (select key from l where length(key) >= 1 group by key having count(distinct doc_id) + count(distinct r) filter (doc_id is null) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (often.key is not null) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by k) filter (often.key is null), '')) as kept_sha256
from l left join often on l.key = often.key group by r, doc_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_extract_html, op2_decontaminate, op3_simhash, op4_license_scan, op5_quality, op6_language_id, op7_ann, op8_token_counts, op9_bpe_round_trip, op10_line_dedup, op11_vector_codes, op12_url_filter, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
