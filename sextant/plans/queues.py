"""Queries over review queues, caches and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import metrics, queues
from sextant.operators.bm25_index import stored
from sextant.operators.overlap import overlap_top_k
from sextant.operators.pairs import hard_negatives
from sextant.plans import Registry, spread, table
from sextant.plans.retrieval import BM25, VQ, _next_positive
from sextant.plans.text import CONTENT, OVERLAP, TOKENS
from sextant.session import checkpointed

R = Registry()
TEXT = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '</(p|pre|li|h\d)>|<br\s*/?>', chr(10), 'gi'), '<[^>]+>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;', '&'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\A\s+|\s+\z', '', 'g')".replace('\\"', '"')


@R.query(f"""with t as (select page_id, {TEXT} as q from pages), f as (select * from t where length(q) between 80 and 4000 and regexp_matches(q, '(?i)the|und|ver'))
select substr(sha256('["so","' || page_id || '"]'), 1, 16) as id, page_id, sha256(q) as question_sha256, array_to_string(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')[:20], ' ') as query
from f order by md5('so:' || page_id), page_id limit 25""")
def q_question_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = queues.question_queue(table(spark, sf_dir, "pages"), "so", 25, "the|und|ver", 80, 4000, 20, T.common_references)
    return found.select("id", "page_id", F.sha2("question", 256).alias("question_sha256"), "query")


@R.query("""with b as (select item_id, text, (row_number() over (order by item_id) - 1) as pos from benchmark)
select 'audit-' || lpad(cast(pos // 15 + 1 as varchar), 2, '0') || '.md' as file, count(*) as items,
  sha256(string_agg('<item id="' || item_id || '">' || chr(10) || '<query>' || text || '</query>' || chr(10) || '<candidate letter="A">' || text || '?' || '</candidate>' || chr(10) || '<candidate letter="B">none</candidate>' || chr(10) || '</item>', chr(10) || chr(10) order by pos)) as body_sha256
from b group by pos // 15""")
def q_labelling_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.array(F.concat("text", F.lit("?")), F.lit("none")).alias("candidates"), "item_id")
    return queues.labelling_batches(queue, [F.col("item_id")], 15, "audit").select("file", "items", F.sha2("body", 256).alias("body_sha256"))


CHUNKS = "c as (select 'c' || doc_id as chunk_id, source || ' > ' || lang as passage from documents)"
AUDIT = f"""with {CHUNKS}, q as (select item_id, cast(item_id as varchar) as id, text as query, 'c' || item_id as p, 'c' || (item_id + 1) as n, row_number() over (order by item_id) - 1 as pos from benchmark),
i as (select pos, '<item id="' || id || '">' || chr(10) || '<query>' || query || '</query>' || chr(10) || '<positive_chunk id="' || p || '">' || chr(10) || a.passage || chr(10) || '</positive_chunk>' || chr(10)
  || '<negative_chunk id="' || n || '">' || chr(10) || b.passage || chr(10) || '</negative_chunk>' || chr(10) || '<candidate letter="A" id="' || n || '">' || chr(10) || b.passage || chr(10) || '</candidate>' || chr(10)
  || '<candidate letter="B" id="' || p || '">' || chr(10) || a.passage || chr(10) || '</candidate>' || chr(10) || '</item>' as item from q join c a on a.chunk_id = p join c b on b.chunk_id = n)
select 'negatives_audit-' || lpad(cast(pos // 15 + 1 as varchar), 2, '0') || '.md' as file, count(*) as items, sha256('Read.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# Batch: task `negatives_audit`, ' || (pos // 15 + 1) || ' of ' || ((select count(*) from q) + 14) // 15 || ', ' || count(*) || ' items'
  || chr(10) || chr(10) || 'Label every item below for the task **`negatives_audit`**, following the instructions.' || chr(10) || chr(10) || string_agg(item, chr(10) || chr(10) order by pos) || chr(10)) as text_sha256
from i group by pos // 15"""


@R.query(AUDIT)
def q_task_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a task with its own passages, instructions and head."""
    chunk = lambda c: F.concat(F.lit("c"), c.cast("string"))
    chunks = table(spark, sf_dir, "documents").select(chunk(F.col("doc_id")).alias("chunk_id"), F.concat("source", F.lit(" > "), "lang").alias("passage"))
    own, other = chunk(F.col("item_id")), chunk(F.col("item_id") + 1)
    queue = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "item_id", F.col("text").alias("query"), own.alias("chunk_id"), other.alias("negative_id"), F.array(other, own).alias("candidates"))
    return queues.task_batches(queue, chunks, [F.col("item_id")], 15, "negatives_audit", "Read.\n").select("file", "items", F.sha2("text", 256).alias("text_sha256"))


FUSED = f"""with t as (select page_id, {TEXT} as q from pages), f as (select * from t where length(q) between 80 and 4000 and regexp_matches(q, '(?i)the|und|ver')),
asked_ as (select page_id as qid, array_to_string(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')[:20], ' ') as query from f order by md5('so:' || page_id), page_id limit 25),
{BM25.replace("item_id as qid, unnest(" + TOKENS.format("text") + ") as term from benchmark", "qid, unnest(" + TOKENS.format("query") + ") as term from asked_").rpartition("ball as")[0]}
ball as (select q.qid, d.doc_id, coalesce(score, 0e0) as score from asked_ q cross join documents d left join bs on bs.qid = q.qid and bs.doc_id = d.doc_id),
br as (select qid, doc_id, row_number() over (partition by qid order by score desc, doc_id) as rank from ball),
orr as (select qid, doc_id, row_number() over (partition by qid order by score desc, doc_id) as rank from (select qid, doc_id, round({OVERLAP.format("q", "p")}, 6) as score from (select qid, {CONTENT.format("query")} as q from asked_), (select doc_id, {CONTENT.format("text")} as p from documents))),
fu as (select qid, doc_id, round(sum(1e0 / (60 + rank)), 9) as score from (select * from br where rank <= 20 union all select * from orr where rank <= 20) group by qid, doc_id)
select qid as page_id, list(doc_id order by rank) as candidates from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from fu) where rank <= 10 group by qid"""


@R.query(FUSED)
def q_question_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the documents that BM25 and word overlap agree on."""
    found = checkpointed(queues.question_queue(table(spark, sf_dir, "pages"), "so", 25, "the|und|ver", 80, 4000, 20, T.common_references))
    docs, asked = table(spark, sf_dir, "documents"), found.select(F.col("page_id").alias("qid"), "query")
    rankings = [stored(docs, "documents").top_k(asked, 20), overlap_top_k(spread(docs.select("doc_id", "text")), asked.withColumnRenamed("query", "text"), 20)]
    return queues.with_candidates(found, "page_id", rankings, 10).select("page_id", "candidates")


@R.query("""with k as (select item_id, text, sha256('m' || chr(10) || text) as key from benchmark) select key, item_id from k where key not in (select key from k where length(text) > 200)""")
def q_embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    cache = items.where("length(text) > 200").select(F.sha2(F.concat(F.lit("m\n"), "text"), 256).alias("key"))
    return queues.cache_misses(items, "text", cache, "m").select("key", "item_id")


@R.query(f"""with {VQ}, pos as (select qid, doc_id, score from vs where doc_id = qid + 1),
pool as (select vs.qid, vs.doc_id, vs.score, pos.doc_id as pd, pos.score as ps, row_number() over (partition by vs.qid order by vs.score desc, vs.doc_id) as rank from vs join pos using (qid) where vs.doc_id <> pos.doc_id),
f as (select qid, min(case when rank between 10 and 30 then 1 when rank between 31 and 60 then 2 end) as w from pool where score <= 95e-2 * ps and abs(doc_id - pd) > 1 and rank between 10 and 60 group by qid)
select case when w = 1 then 'main' when w = 2 then 'fallback' else 'none' end as "window", count(*) as n from pos left join f using (qid) group by 1""")
def q_negative_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, positives = _next_positive(spark, sf_dir)
    return hard_negatives(scores, positives, "neg").groupBy("window").agg(F.count(F.lit(1)).alias("n"))


@R.query("""select doc_id, source from documents order by source, doc_id limit 16 offset 24""")
def q_offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("source", "doc_id").offset(24).limit(16)


@R.query("""select event_type, round(avg(value), 6) as val_mean, round(max(value), 6) as val_max from events group by event_type""")
def q_metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics under long names, those that are wanted picked out by suffix and renamed."""
    each = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("a"), F.round(F.max("value"), 6).alias("b"), F.min("value").alias("c"))
    named = each.select("event_type", F.create_map(F.lit("eval_cosine_mean@10"), "a", F.lit("eval_cosine_max@10"), "b", F.lit("eval_dot_min@10"), "c").alias("m"))
    kept = named.select("event_type", metrics.renamed(F.col("m"), {"cosine_mean@10": "mean", "cosine_max@10": "max"}, "val_").alias("m"))
    return kept.select("event_type", F.col("m")["val_mean"].alias("val_mean"), F.col("m")["val_max"].alias("val_max"))


@R.query("""with q as (select item_id as qid from benchmark), r as (select item_id as qid, item_id % 7 as chunk_id from benchmark where length(text) > 200 union all select item_id, 50 + item_id % 2 from benchmark where length(text) > 200)
select qid, list_sort(list(distinct chunk_id)) as relevant from q join r using (qid) group by qid""")
def q_ir_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    some = items.where("length(query) > 200")
    rel = some.select("qid", (F.col("qid") % 7).alias("chunk_id")).unionByName(some.select("qid", (50 + F.col("qid") % 2).alias("chunk_id")))
    queries, _, relevant = metrics.ir_data(items, rel, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("passage")))
    return queries.join(relevant, "qid").select("qid", "relevant")
