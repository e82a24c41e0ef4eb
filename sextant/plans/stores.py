"""Queries that write tables with the library's sinks and read them back with its readers, and over what is stored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import cache, corpus, freeze, incident
from sextant.operators.labels import latest
from sextant.plans import Registry, table
from sextant.plans.derived import CAPTURED
from sextant.session import shared_folder
from sextant.sources import readers, sinks

R = Registry()


def _folder(spark: SparkSession) -> str:
    """A folder of its own for each run."""
    return f"{shared_folder(spark)}/stores-{uuid.uuid4().hex}"


@R.query("""select doc_id as id, lang, source, sha256(coalesce(text, '')) as text_sha256, (select count(*) from documents) as written from documents""")
def q_jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, counted as they are written, and every line checked as it is read."""
    path = _folder(spark)
    n = sinks.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), path)
    rows = readers.jsonl(spark, path, "doc_id long, lang string, source string, text string", check=True)
    return rows.select(F.col("doc_id").alias("id"), "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.lit(n).cast("long").alias("written"))


@R.query("""select source || '#' || lpad(cast(doc_id as varchar), 7, '0') as chunk_id, source as doc_id, cast(n_chars // 5 as integer) as n_tokens, lang as kind from documents""")
def q_corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of chunks, written and read with its keys checked."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("#"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("chunk_id"), F.col("source").alias("doc_id"), "source", "text", F.floor(F.col("n_chars") / 5).cast("int").alias("n_tokens"), F.create_map(F.lit("kind"), "lang").alias("meta"))
    sinks.write_jsonl(rows, path)
    return readers.corpus(spark, path).select("chunk_id", "doc_id", "n_tokens", F.col("meta")["kind"].alias("kind"))


@R.query("""with l as (select doc_id, quality, toxic, 1 as k from labels union all select doc_id, 1 - quality, toxic, 2 from labels where doc_id % 3 = 0)
select doc_id, quality, toxic, n from (select *, count(*) over (partition by doc_id) as n, row_number() over (partition by doc_id order by k desc) as r from l) where r = 1""")
def q_label_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of labels, appended to twice; the last of each counts."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    sinks.append_labels(rows.withColumn("pos", F.lit(1)), path)
    sinks.append_labels(rows.where("doc_id % 3 = 0").withColumns({"quality": 1 - F.col("quality"), "pos": F.lit(2)}), path)
    log = spark.read.parquet(path)
    times = log.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return latest(log, ["doc_id"], ["pos"]).join(times, "doc_id").select("doc_id", "quality", "toxic", "n")


@R.query("""with m as (select event_type as slice, count(*) as n, avg(value) as a, max(value) as b from events group by event_type)
select 'test' as split, 'bm25' as ranker, slice, n, printf('%.4f', a) as hit_1, printf('%.4f', b) as hit_5 from m""")
def q_metric_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of results as CSV, four digits each, and back."""
    path = _folder(spark)
    each = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("hit_1"), F.max("value").alias("hit_5"))
    sinks.write_metrics(each.withColumns({c: F.lit(0.0) for c in ("hit_10", "mrr_10", "ndcg_10")}), path, "test", "bm25")
    rows = readers.csv_results(spark, path, "split string, ranker string, slice string, n long, hit_1 string, hit_5 string, hit_10 string, mrr_10 string, ndcg_10 string")
    return rows.select("split", "ranker", "slice", "n", "hit_1", "hit_5")


@R.query("""with q as (select 'val/' || lpad(cast(item_id as varchar), 5, '0') as qid, case item_id % 3 when 0 then 'how_to' when 1 then 'symptom' else 'error_string' end as slice from benchmark
  union all select 'hand/' || lpad(cast(doc_id as varchar), 3, '0'), 'handwritten' from documents where doc_id % 50 = 7)
select 'queries' as name, count(*) as rows, (select string_agg(slice || '=' || n, ',' order by slice) from (select slice, count(*) as n from q group by slice)) as slices, true as sound from q
union all select 'qrels', (select count(*) from benchmark) + 2 * (select count(*) from documents where doc_id % 50 = 7), null, true""")
def q_frozen_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set put together of pairs and handwritten rows, checked, frozen and verified: what its manifest says."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    style = F.when(F.col("item_id") % 3 == 0, "how_to").when(F.col("item_id") % 3 == 1, "symptom").otherwise("error_string")
    pairs = items.select(F.col("item_id").alias("pos"), F.col("text").alias("query"), style.alias("style"), F.lit("docs").alias("source"), F.concat(F.lit("c"), "item_id").alias("chunk_id"))
    hand = docs.where("doc_id % 50 = 7").select(F.col("doc_id").alias("pos"), F.col("text").alias("query"), F.array(F.concat(F.lit("c"), "doc_id"), F.lit("c0"), F.lit("c0")).alias("relevant"))
    (q1, r1), (q2, r2) = freeze.val_pairs(pairs), freeze.handwritten(hand)
    queries, rel = q1.unionByName(q2), r1.unionByName(r2)
    known = items.select(F.concat(F.lit("c"), "item_id").alias("chunk_id")).unionByName(docs.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"))).distinct()
    path = _folder(spark)
    found = sinks.freeze({"queries": queries, "qrels": rel}, path)
    sound = not sinks.verify(spark, path) and freeze.problems(sinks.frozen(spark, path, "queries"), sinks.frozen(spark, path, "qrels"), known).isEmpty()
    slices = F.array_join(F.transform(F.array_sort(F.map_entries("slices")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.select("name", "rows", slices.alias("slices"), F.lit(sound).alias("sound"))


@R.query("""select item_id, length(text) as chars, sha256('m' || chr(10) || text) as key, item_id % 2 = 0 as known from benchmark""")
def q_vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that holds what was made for every other item, asked for all: the others are made, and then it has all."""
    path, items = _folder(spark), table(spark, sf_dir, "benchmark")
    make = lambda rows: rows.select("key", F.length("text").alias("chars"))
    keyed = items.select("item_id", "text", cache.key_of("m", F.col("text")).alias("key"))
    cache.cached(items.where("item_id % 2 = 0"), path, "m", "text", "chars int", make)
    before = cache.load(spark, path, "chars int", keyed).select("key", F.lit(True).alias("known"))
    before = spark.createDataFrame(before.toArrow())  # the answer of now: a stated set
    rows = cache.cached(items, path, "m", "text", "chars int", make).select("item_id", "chars")
    return rows.join(keyed.select("item_id", "key"), "item_id").join(before, "key", "left").select("item_id", F.col("chars").cast("long").alias("chars"), "key", F.coalesce("known", F.lit(False)).alias("known"))


@R.query("""select event_id, sha256('{"kind":"' || event_type || '","of":{"user_id":' || user_id || ',"value":' || cast(value as varchar) || '},"props":{"k":' || coalesce(json_extract_string(props, '$.k'), 'null') || '},"tags":["' || event_type || '",null]}') as hash from events""")
def q_json_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested object of each event, its props among it, as canonical JSON."""
    p = F.from_json("props", "k bigint")
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(p.alias("props"), F.col("event_type").alias("kind"), F.array("event_type", F.lit(None).cast("string")).alias("tags"), F.struct("value", "user_id").alias("of")).alias("o"))
    return rows.select("event_id", T.stable_hash(F.col("o"), rows.schema["o"].dataType).alias("hash"))


@R.query("""with l as (select doc_id, source, k, ls[k] as t from (select doc_id, source, ls, unnest(range(1, len(ls) + 1)) as k from (select doc_id, source, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
p as (select * from l where trim(t) <> ''), f as (select *, row_number() over (partition by t order by doc_id, k) as r from p),
e as (select count(*) as n from documents where doc_id not in (select doc_id from p))
select source, count(distinct doc_id) as docs, count(*) as chunks, cast(null as bigint) as duplicate_chunks, cast(null as bigint) as empty_docs from f where r = 1 group by source
union all select null, count(distinct doc_id), count(*), (select count(*) from f where r > 1), (select n from e) from f where r = 1""")
def q_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What building a corpus of lines keeps, and what it drops: lines that were there before, documents without any."""
    docs = table(spark, sf_dir, "documents")
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t, k: F.struct(k.alias("k"), t.alias("t"))), lambda x: F.trim(x["t"]) != "")
    pieces = docs.select("doc_id", "source", F.explode_outer(lines).alias("x")).select("doc_id", "source", F.col("x.k").alias("k"), F.col("x.t").alias("t"))
    return corpus.summary(pieces, "doc_id", "source", "t", ["doc_id", "k"])


@R.query("""select source as doc_id, list(lang || doc_id order by n_chars, doc_id) as chunks from documents group by source""")
def q_doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.struct("n_chars", "doc_id").alias("pos"), F.concat("lang", F.col("doc_id").cast("string")).alias("chunk_id"))
    return freeze.doc_chunks(rows)


@R.query("""select 'build' as name, 'ok' as status, '{"rows": ' || (select count(*) from documents) || '}' as metrics, '{"seed": 1}' as config union all select 'broken', 'failed:ValueError', '{}', '{}'""")
def q_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs as the log has them: one that counts documents, one that fails."""
    path = _folder(spark)
    with sinks.tracked(spark, path, "build", {"seed": 1}) as metrics:
        metrics["rows"] = table(spark, sf_dir, "documents").count()
    try:
        with sinks.tracked(spark, path, "broken", {}):
            raise ValueError("of no use")
    except ValueError:
        pass
    return spark.read.parquet(path).where("driver_mb > 0 and length(run_id) = 12").select("name", "status", "metrics", "config")


@R.query("""with e as (select event_type, count(*) as n from events group by event_type),
l as (select 0 as pos, '# Events' as line union all select 2, '| event_type | n |' union all select 3, '| --- | --- |' union all select 3 + row_number() over (order by event_type), '| ' || event_type || ' | ' || n || ' |' from e)
select pos, line from l""")
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as Markdown, written over another one, read line by line."""
    path = f"{_folder(spark)}/report.md"
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy("event_type")
    for text in ("an older report", sinks.report(counts, "Events")):
        sinks.write_text(spark, path, text)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return lines.where("line <> ''").select(F.col("pos").cast("long").alias("pos"), "line")


SHOT = {
    "id": "'shot-' || event_id", "runbook": "'rb-' || user_id % 7", "status": "case when event_id % 11 = 0 then 'failed' else 'ok' end", "namespace": "'ns-' || event_type",
    "pods": f"{CAPTURED['pods']}", "logs": f"{CAPTURED['logs']} || ' of ns-' || event_type",
}


@R.query(f"""with v as (select event_id as k, {", ".join(f"{x} as {c}" for c, x in SHOT.items())} from events), s as (select * from v where status = 'ok'),
pr as (select id, k, regexp_split_to_array(trim(x), '\\s+') as c from (select id, generate_subscripts(ls, 1) as k, unnest(ls) as x from (select id, list_filter(string_split(pods, chr(10)), lambda x: trim(x) <> '')[2:] as ls from s))),
pb as (select id, list(c[1] || ' ' || c[2] || ' ' || c[3] || ' ' || case when starts_with(coalesce(c[5], ''), '(') then c[4] || ' ' || c[5] || ' ' || c[6] else c[4] end order by k)[:3] as x
  from pr where len(c) >= 4 and contains(c[2], '/') and (split_part(c[2], '/', 1) <> split_part(c[2], '/', 2) or c[3] <> 'Running' or c[4] <> '0') group by id),
lg as (select id, list_transform(list_filter(list_transform(string_split(logs, chr(10)), lambda x: trim(x)), lambda x: x <> '' and not starts_with(x, 'unable to retrieve') and not starts_with(x, 'Error from server') and regexp_matches(x, '(?i){T.ERROR_LINE.replace("'", "''")}'))[-2:], lambda x: 'log: ' || x) as x from s),
q as (select s.id, s.runbook, namespace, coalesce(pb.x, []) as p, lg.x as l from s left join pb using (id) join lg using (id)),
w as (select id, runbook, replace(array_to_string(list_concat(p, case when len(l) = 2 and l[1] = l[2] then [l[1]] else l end), ' | '), namespace, 'prod') as full_, replace(array_to_string(list_concat(p[:1], l[:1]), ' | '), namespace, 'prod') as brief from q),
sc as (select distinct 'rb-' || user_id % 7 as runbook from events where user_id % 7 <> 3)
select 'incident/' || id || '/' || variant as qid, query, variant, ['runbook/' || runbook, 'runbook/other'] as relevant_docs, case runbook when 'rb-1' then 'test' when 'rb-2' then 'val' else 'train' end as runbook_split
from (select id, runbook, 'full' as variant, full_ as query from w union all select id, runbook, 'brief', brief from w) join sc using (runbook)""")
def q_incident_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture of each event, written as JSON and read back, made into queries that are joined with scenarios and splits."""
    path = _folder(spark)
    section = lambda title, c: F.struct(F.lit(title).alias("title"), F.lit("c").alias("command"), F.col(c).alias("output"))
    shots = table(spark, sf_dir, "events").selectExpr("event_id as k", *[f"{x} as {c}" for c, x in SHOT.items()])
    shots.select("id", "runbook", "status", "namespace", F.array(section("pods", "pods"), section("logs web", "logs")).alias("sections")).write.json(path)
    captures = readers.captures(spark, path, lines=True)
    runbooks = table(spark, sf_dir, "events").select(F.concat(F.lit("rb-"), F.col("user_id") % 7).alias("runbook")).distinct()
    scenarios = captures.select("id", "runbook").where("runbook <> 'rb-3'").withColumn("also_relevant", F.array(F.lit("other")))
    split = F.when(F.col("runbook") == "rb-1", "test").when(F.col("runbook") == "rb-2", "val").otherwise("train")
    rows = incident.incident_rows(captures, scenarios, runbooks.select(F.concat(F.lit("runbook/"), "runbook").alias("doc_id"), split.alias("split")))
    return rows.select("qid", "query", "variant", "relevant_docs", "runbook_split")
