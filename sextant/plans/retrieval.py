"""Queries over rankings: BM25, vectors, fusion, metrics, negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators.bm25_index import bm25_top_k, stored
from sextant.operators.metrics import by_slice, evaluate, group_metrics, worst
from sextant.operators.pairs import filter_chain, filter_stats, greedy_near_duplicates, hard_negatives
from sextant.operators.overlap import overlap_top_k
from sextant.operators.retrieval import dense, dense_ranks, rrf, top_k
from sextant.plans import Registry, spread, table
from sextant.plans.text import CONTENT, OVERLAP, TOKENS

R = Registry()
K = 10

BM25 = f"""dt as (select doc_id, {TOKENS.format("text")} as w from documents),
dn as (select doc_id, cast(len(w) as double) as dl, w from dt),
size as (select cast(count(*) as double) as n, avg(dl) as avgdl from dn),
post as (select doc_id, term, cast(count(*) as double) as tf from (select doc_id, unnest(w) as term from dn) group by all),
df as (select term, cast(count(*) as double) as df from post group by term),
raw as (select term, ln(n - df + 5e-1) - ln(df + 5e-1) as raw from df, size),
idf as (select term, case when raw < 0 then (select avg(raw) * 25e-2 from raw) else raw end as idf from raw),
qt as (select qid, term, cast(count(*) as double) as qtf from (select item_id as qid, unnest({TOKENS.format("text")}) as term from benchmark) group by all),
bs as (select qid, doc_id, round(sum(qtf * idf * tf * 25e-1 / (tf + 15e-1 * (1e0 - 75e-2 + 75e-2 * dl / avgdl))), 4) as score
  from qt join idf using (term) join post using (term) join dn using (doc_id), size group by qid, doc_id),
ball as (select item_id as qid, doc_id, coalesce(score, 0e0) as score from benchmark b cross join documents d left join bs on bs.qid = b.item_id and bs.doc_id = d.doc_id),
"""
BALL = BM25.replace("select item_id as qid, doc_id, coalesce(score, 0e0) as score", "select item_id as qid, d.doc_id, coalesce(score, 0e0) as score")
BTOP = BALL + "br as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from ball) where rank <= {k})"
QRELS = "qrels as (select item_id as qid, doc_id from benchmark b, documents d where contains(d.text, b.text))"


def metrics_sql(rank: str, qrels: str, slices: str) -> str:
    """Metrics of rankings by slice, given the names of three relations."""
    return f"""
h as (select q.qid, q.doc_id, r.rank from (select distinct qid, doc_id from {qrels}) q left join {rank} r on q.qid = r.qid and q.doc_id = r.doc_id and r.rank <= 10),
m as (select qid, count(*) as n_rel, max(case when rank <= 1 then 1e0 else 0 end) as hit_1, max(case when rank <= 5 then 1e0 else 0 end) as hit_5, max(case when rank <= 10 then 1e0 else 0 end) as hit_10,
  coalesce(max(1e0 / rank), 0) as mrr_10, coalesce(sum(1e0 / log2(rank + 1e0)), 0) as dcg from h group by qid),
mm as (select *, dcg / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda r: 1e0 / log2(r + 1e0))) as ndcg_10 from m)
select slice, count(*) as n, round(avg(hit_1), 6) as hit_1, round(avg(hit_5), 6) as hit_5, round(avg(hit_10), 6) as hit_10, round(avg(mrr_10), 6) as mrr_10, round(avg(ndcg_10), 6) as ndcg_10
from mm join {slices} using (qid) group by slice"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _bm25(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"), "documents").top_k(_items(spark, sf_dir), k)


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.plans.text import q_leak_contains

    return q_leak_contains(spark, sf_dir).withColumnRenamed("item_id", "qid")


@R.query(f"with {BTOP.format(k=K)} select qid, doc_id, score, cast(rank as integer) as rank from br")
def q_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir)


@R.query(f"with {BTOP.format(k=K).replace('round(sum(', 'round(cast(cast(sum(').replace('dl / avgdl))), 4) as score', 'dl / avgdl))) as float) as double), 4) as score')} select qid, doc_id, score, cast(rank as integer) as rank from br")
def q_bm25_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to single precision before they are rounded and ranked."""
    return stored(table(spark, sf_dir, "documents"), "documents").top_k(_items(spark, sf_dir), K, single=True)


@R.query(f"with {BTOP.format(k=K)}, {QRELS}, sl as (select item_id as qid, unnest(['all', case when item_id % 2 = 0 then 'even' else 'odd' end]) as slice from benchmark), {metrics_sql('br', 'qrels', 'sl')}")
def q_bm25_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = _items(spark, sf_dir).select("qid", F.array(F.lit("all"), F.when(F.col("qid") % 2 == 0, "even").otherwise("odd")).alias("slices"))
    return evaluate(_bm25(spark, sf_dir), _planted(spark, sf_dir), slices)


OVR = f"""oq as (select item_id as qid, {CONTENT.format("text")} as q from benchmark), od as (select doc_id, {CONTENT.format("text")} as p from documents),
orr as (select * from (select qid, doc_id, row_number() over (partition by qid order by score desc, doc_id) as rank from (select qid, doc_id, round({OVERLAP.format("q", "p")}, 6) as score from oq, od)) where rank <= 20),
fu as (select qid, doc_id, round(sum(1e0 / (60 + rank)), 9) as score from (select qid, doc_id, rank from br union all select qid, doc_id, rank from orr) group by qid, doc_id),
fr as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from fu) where rank <= 10)"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = overlap_top_k(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), _items(spark, sf_dir).withColumnRenamed("query", "text"), 20)
    return rrf([_bm25(spark, sf_dir, 20), shared], 10)


@R.query(f"with {BTOP.format(k=20)}, {OVR} select qid, doc_id, score, cast(rank as integer) as rank from fr")
def q_rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir)


@R.query(f"""with {BTOP.format(k=20)}, {OVR}
select qid, list_transform(list_sort(list({{'rank': rank, 'doc_id': doc_id}}) filter (doc_id <> qid)), lambda x: x.doc_id)[:5] as candidates from fr where rank <= 6 group by qid""")
def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six fused candidates without the item's own document, five at most."""
    top = _hybrid(spark, sf_dir).where("rank <= 6 and doc_id <> qid")
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    return top.groupBy("qid").agg(F.slice(names, 1, 5).alias("candidates"))


@R.query(f"""with {BTOP.format(k=100)}, {QRELS}, f as (select q.qid, coalesce(min(r.rank), 101) as rank from qrels q left join br r on q.qid = r.qid and q.doc_id = r.doc_id group by q.qid)
select f.qid, cast(f.rank as integer) as rank, t.top3, case when f.rank = 101 then 'missed' when f.rank > 1 then 'late' else 'untagged' end as tag from f
left join (select qid, string_agg(cast(doc_id as varchar), ',' order by rank) as top3 from br where rank <= 3 group by qid) t using (qid) order by f.rank desc, f.qid limit 10""")
def q_worst_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = worst(_bm25(spark, sf_dir, 100), _planted(spark, sf_dir), 10)
    tags = found.where("rank > 1").select("qid", F.when(F.col("rank") == 101, "missed").otherwise("late").alias("tag"))
    return found.join(tags, "qid", "left").select("qid", "rank", "top3", F.coalesce("tag", F.lit("untagged")).alias("tag"))


DOT = "round(list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::double * x[2]::double)), 6) + 0e0"
VQ = f"""vs as (select a.vec_id as qid, b.vec_id as doc_id, {DOT.format("a.embedding", "b.embedding")} as score from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
vr as (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from vs)"""


def _vectors(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Every twentieth vector, a stated query set, against all others."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("q"))
    found = dense(queries, rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), k + 1)
    return top_k(found.where("qid <> doc_id").drop("rank"), k)


@R.query(f"with {VQ} select qid, doc_id, score, cast(rank as integer) as rank from vr where rank <= 10")
def q_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir, 10)


@R.query(f"""with {VQ}, vq as (select a.vec_id as qid, b.vec_id as doc_id from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
sl as (select vec_id as qid, unnest(['all', cast(label as varchar)]) as slice from embeddings), {metrics_sql('vr', 'vq', 'sl')}""")
def q_dense_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label")
    found = group_metrics(_vectors(spark, sf_dir, 10), asked.select("qid", F.col("label").alias("group")), rows.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("group")))
    return by_slice(found, asked.select("qid", F.array(F.lit("all"), F.col("label").cast("string")).alias("slices")))


PICKED = "docs_ as (select d.source || '#' || lpad(cast(d.doc_id as varchar), 7, '0') as doc_id, d.doc_id as n, d.text, e.embedding as v from documents d join embeddings e on e.vec_id = d.doc_id)"
ASKED = "asked_ as (select doc_id as qid, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:12], ' ') as query, v as q from docs_ where n % 20 = 0)"


@R.query(f"""with {PICKED}, {ASKED}, {BM25.replace("from documents)", "from docs_)").replace("item_id as qid, unnest(" + TOKENS.format("text") + ") as term from benchmark", "qid, unnest(" + TOKENS.format("query") + ") as term from asked_").rpartition("ball as")[0]}
ball as (select q.qid, d.doc_id, coalesce(score, 0e0) as score from asked_ q cross join docs_ d left join bs on bs.qid = q.qid and bs.doc_id = d.doc_id),
br as (select qid, doc_id, row_number() over (partition by qid order by score desc, doc_id) as rank from ball where qid <> doc_id),
vr as (select qid, doc_id, row_number() over (partition by qid order by score desc, doc_id) as rank from (select q.qid, d.doc_id, {DOT.format("q.q", "d.v")} as score from asked_ q, docs_ d where q.qid <> d.doc_id)),
fu as (select qid, doc_id, round(sum(1e0 / (60 + rank)), 9) as score from (select * from br where rank <= 20 union all select * from vr where rank <= 20) group by qid, doc_id)
select qid, doc_id, score, cast(rank as integer) as rank from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from fu) where rank <= 10""")
def q_hybrid_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and vectors fused, over chunk ids (strings): documents that have a vector, every twentieth as a query by its
    first words and its vector, itself no candidate."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    docs = docs.select(F.concat("source", F.lit("#"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("doc_id"), F.col("doc_id").alias("n"), "text", F.col("embedding").alias("v"))
    asked = docs.where("n % 20 = 0").select(F.col("doc_id").alias("qid"), F.array_join(F.slice(T.words(F.col("text")), 1, 12), " ").alias("query"), F.col("v").cast("array<double>").alias("q"))
    others = [top_k(found.where("qid <> doc_id").drop("rank"), 20) for found in (bm25_top_k(docs, asked, 21), dense(asked, docs, 21))]
    return rrf(others, 10)


def _next_positive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The best 90 of every twentieth vector, and the next vector as its positive, with its score and rank.

    Hard negatives lie among ranks 10 to 60 of a pool without the positive, so more are never needed."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("q"))
    docs = rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    positives = queries.select("qid", (F.col("qid") + 1).alias("doc_id"))
    return _vectors(spark, sf_dir, 90).drop("rank"), dense_ranks(queries, docs, positives)


@R.query(f"with {VQ}, p as (select qid, doc_id, rank() over (partition by qid order by score desc) as rank from vs) select qid, doc_id, cast(rank as integer) as rank, rank <= 50 as kept from p where doc_id = qid + 1")
def q_rank_of_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, positives = _next_positive(spark, sf_dir)
    return positives.select("qid", "doc_id", "rank", (F.col("rank") <= 50).alias("kept"))


@R.query(f"""with {VQ}, pos as (select qid, doc_id, score from vs where doc_id = qid + 1),
pool as (select vs.qid, vs.doc_id, vs.score, pos.doc_id as pd, pos.score as ps, row_number() over (partition by vs.qid order by vs.score desc, vs.doc_id) as rank from vs join pos using (qid) where vs.doc_id <> pos.doc_id),
f as (select *, case when rank between 10 and 30 then 1 when rank between 31 and 60 then 2 end as w from pool where score <= 95e-2 * ps and abs(doc_id - pd) > 1 and rank between 10 and 60),
g as (select *, row_number() over (partition by qid order by md5('neg:' || qid || ':' || doc_id), doc_id) as k from (select *, min(w) over (partition by qid) as lw from f) where w = lw),
t as (select qid, min(w) as w, list(doc_id order by k) as negatives from g where k <= 3 group by qid)
select pos.qid, case when w = 1 then 'main' when w = 2 then 'fallback' else 'none' end as "window", coalesce(negatives, []) as negatives from pos left join t using (qid)""")
def q_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, positives = _next_positive(spark, sf_dir)
    return hard_negatives(scores, positives, "neg")


STYLES = ("incident_snapshot", "symptom", "how_to", "error_string")
#: Rows of a filter chain: each vector is a query of one of few siblings, with words of a benchmark item and a document as
#: its passage; some words repeat within a passage, some elsewhere too.
CHAIN = f"""base as (select e.vec_id as pos, e.vec_id // 8 as chunk_id, case when e.vec_id % 17 = 0 then 'The same Words, here' else b.text || ' number' || (e.vec_id - e.vec_id % 2) end as query,
  {list(STYLES)}[1 + label % 4] as style, d.text as passage, (label * 7 + e.vec_id) % 90 as rt_rank, embedding as v, d.lang as split
  from embeddings e join documents d on d.doc_id = e.vec_id join benchmark b on b.item_id = (e.vec_id // 2) % 40),
n as (select *, array_to_string(regexp_extract_all(lower(query), '[a-z0-9]+'), ' ') as norm, {CONTENT.format("query")} as q, {CONTENT.format("passage")} as p from base),
g as (select norm, count(distinct chunk_id) as groups, min(pos) as first from n group by norm),
o as (select n.*, round_even({OVERLAP.format("q", "p")}, 3) as overlap, case when groups > 1 then 'ambiguous' when pos > first then 'duplicate' else '' end as d0 from n join g using (norm)),
c as (select *, case when d0 <> '' then d0 when overlap > case style when 'incident_snapshot' then 6e-1 when 'symptom' then 75e-2 when 'how_to' then 9e-1 else 2 end then 'overlap' else '' end as d1 from o),
k as (select pos, chunk_id, v, rt_rank <= 50 as back, row_number() over (partition by chunk_id order by pos) as k from c where d1 = ''),
s as (select chunk_id, k, pos, false as near, case when back then [v] else [] end as kept from k where k = 1
  union all select k.chunk_id, k.k, k.pos, hit, case when hit or not back then kept else list_append(kept, k.v) end
  from (select k.*, s.kept, len(list_filter(s.kept, lambda x: list_sum(list_transform(list_zip(x, k.v), lambda y: y[1]::double * y[2]::double)) > 12e-2)) > 0 as hit from s join k on k.chunk_id = s.chunk_id and k.k = s.k + 1) k),
f as (select c.*, case when d1 <> '' then d1 when s.near then 'near_duplicate' when rt_rank > 50 then 'round_trip' else '' end as "drop" from c left join s using (pos))"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, docs, items = (table(spark, sf_dir, t) for t in ("embeddings", "documents", "benchmark"))
    pos = F.col("vec_id")
    query = F.when(pos % 17 == 0, "The same Words, here").otherwise(F.concat("words", F.lit(" number"), (pos - pos % 2).cast("string")))
    style = F.element_at(F.array(*map(F.lit, STYLES)), (F.col("label") % 4 + 1).cast("int"))
    joined = rows.join(docs.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("passage"), F.col("lang").alias("split")), "vec_id")
    joined = joined.withColumn("item_id", F.floor(pos / 2) % 40).join(items.select("item_id", F.col("text").alias("words")), "item_id")
    made = joined.select(pos.alias("pos"), F.floor(pos / 8).alias("chunk_id"), query.alias("query"), style.alias("style"), "passage", ((F.col("label") * 7 + pos) % 90).alias("rt_rank"), F.col("embedding").alias("v"), "split")
    return filter_chain(made, 0.12)


@R.query(f"with recursive {CHAIN} select pos, chunk_id, overlap, \"drop\" from f")
def q_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir).select("pos", "chunk_id", "overlap", "drop")


@R.query(f"""with recursive {CHAIN} select split, count(*) as generated, count(*) filter ("drop" = '') as kept, count(distinct chunk_id) filter ("drop" = '') as kept_chunks,
  (select string_agg(r || '=' || n, ',' order by r) from (select "drop" as r, count(*) as n from f g where g.split = f.split and "drop" <> '' group by 1)) as dropped,
  (select string_agg(r || '=' || n, ',' order by r) from (select style as r, count(*) as n from f g where g.split = f.split and "drop" = '' group by 1)) as kept_by_style from f group by split""")
def q_filter_chain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return filter_stats(_chain(spark, sf_dir), "split").select("split", "generated", "kept", "kept_chunks", shown("dropped"), shown("kept_by_style"))


@R.query(f"""with recursive v as (select vec_id, vec_id // 40 as g, embedding as e, row_number() over (partition by vec_id // 40 order by vec_id) as k from embeddings),
s as (select g, k, [vec_id] as kept, [e] as es from v where k = 1
  union all select v.g, v.k, case when ok then list_append(kept, v.vec_id) else kept end, case when ok then list_append(es, v.e) else es end
  from (select s.kept, s.es, v.*, len(list_filter(s.es, lambda x: list_sum(list_transform(list_zip(x, v.e), lambda y: y[1]::double * y[2]::double)) > 15e-2)) = 0 as ok from s join v on v.g = s.g and v.k = s.k + 1) v)
select g, count(*) as n, count(*) filter (list_contains(last.kept, v.vec_id)) as n_kept, min(v.vec_id) filter (not list_contains(last.kept, v.vec_id)) as first_dropped
from v join (select g, arg_max(kept, k) as kept from s group by g) last using (g) group by g""")
def q_near_dup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 40))
    found = greedy_near_duplicates(rows, "g", "vec_id", "embedding", 0.15)
    return found.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("near_duplicate")).alias("n_kept"), F.min(F.when(F.col("near_duplicate"), F.col("vec_id"))).alias("first_dropped"))


@R.query("""with t as (select label, vec_id, row_number() over (partition by label order by vec_id) as k, count(*) over () as n from embeddings),
p as (select a.vec_id as anchor, b.vec_id as positive, c.vec_id as negative from t a join t b on a.label = b.label and b.k = a.k + 1 join t c on c.label = (a.label + 1) % 10 and c.k = a.k),
r as (select *, row_number() over (order by md5('frac:' || anchor), anchor) as k, count(*) over () as n from p)
select anchor, positive, negative from r where k <= greatest(1, round_even(n * 25e-2, 0))""")
def q_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.operators.sampling import numbered_within, seeded_share

    t = numbered_within(table(spark, sf_dir, "embeddings").select("label", "vec_id"), ["label"], [F.col("vec_id")]).select("label", "vec_id", F.col("pos").alias("k"))
    other = t.select(((F.col("label") + 9) % 10).alias("label"), "k", F.col("vec_id").alias("negative"))
    pairs = t.withColumnRenamed("vec_id", "anchor").join(t.select("label", (F.col("k") - 1).alias("k"), F.col("vec_id").alias("positive")), ["label", "k"]).join(other, ["label", "k"])
    return seeded_share(pairs.select("anchor", "positive", "negative"), "anchor", "frac", 0.25)
