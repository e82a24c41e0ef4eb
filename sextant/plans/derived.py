"""Queries over rows made of the given tables, row by row, by expressions that Spark and the SQL share: texts of kinds that
the tables hold no examples of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import generation, incident, pairs
from sextant.operators.sampling import batches
from sextant.plans import Registry, table
from sextant.sources.sinks import with_time

R = Registry()
FENCE = "`" * 3
NL = "chr(10)"


def _made(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*[f"{x} as {c}" for c, x in columns.items()])


def _sql(name: str, columns: dict[str, str]) -> str:
    return "select " + ", ".join(f"{x} as {c}" for c, x in columns.items()) + f" from {name}"


ELIGIBLE = {
    "path": "case when doc_id % 3 = 0 then 'draft/' else 'docs/' end || source || '-' || doc_id || case when doc_id % 5 = 0 then '.txt' else '.md' end",
    "style": "case doc_id % 5 when 0 then 'how_to' when 1 then 'symptom' when 2 then 'incident_snapshot' else 'error_string' end",
    "ov": "cast((doc_id * 37) % 10007 as double) / 10007e0",
    "body": f"case doc_id % 3 when 0 then coalesce(text, '') when 1 then '{FENCE}' || {NL} || coalesce(text, '') || {NL} || '{FENCE}' || {NL} || substr(coalesce(text, ''), 1, cast(doc_id % 300 as int)) else substr(coalesce(text, ''), 1, 200) || {NL} || '{FENCE}' || {NL} || lang || {NL} || '{FENCE}' || source end",
    "headings": "split('Guide,' || case doc_id % 4 when 0 then 'What' || chr(39) || 's Next' when 1 then 'REFERENCE' else lang end, ',')",
}


@R.query(f"""with v as ({_sql("documents", ELIGIBLE)}),
c as (select *, list_sum(list_transform(regexp_extract_all(body, '(?s){FENCE}.*?{FENCE}'), lambda x: length(x))) as code, trim(regexp_replace(body, '(?s){FENCE}.*?{FENCE}', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) as prose from v)
select path, round(coalesce(code, 0) / greatest(length(body), 1)::double, 6) as fraction, coalesce(code, 0) / greatest(length(body), 1)::double <= 8e-1 and length(prose) >= 120 as eligible,
  case style when 'incident_snapshot' then 6e-1 when 'symptom' then 75e-2 when 'how_to' then 9e-1 end as cap,
  coalesce(round_even(ov, 3) > case style when 'incident_snapshot' then 6e-1 when 'symptom' then 75e-2 when 'how_to' then 9e-1 end, false) as over,
  len(list_filter(headings, lambda h: lower(h) in ('what''s next', 'reference'))) > 0 as excluded, not regexp_matches(path, '^draft/.*\\.md$') as included from c""")
def q_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, "documents", ELIGIBLE)
    cap = pairs.overlap_cap(F.col("style"))
    over = pairs.first_reason(F.lit(""), F.col("style"), F.col("ov"), F.lit(1)) == "overlap"
    return rows.select("path", F.round(T.code_fraction(F.col("body")), 6).alias("fraction"), T.eligible(F.col("body")).alias("eligible"), cap.alias("cap"), over.alias("over"), T.excluded(F.col("headings"), ["What's Next", "Reference"]).alias("excluded"), (~F.col("path").rlike(T.glob_pattern("draft/*.md"))).alias("included"))


FILES = {
    "path": "'f' || doc_id || '.jsonl'",
    "text": f"""'Here you go:' || {NL} || '{{"id": "q' || doc_id || '", "verdict": "Correct", "reason": "x", "also_relevant": ["B", "' || lang || '"]}},' || {NL} || '{{"id": "r' || doc_id || '", "verdict": "' || source || '"}}' || case when doc_id % 7 = 0 then {NL} || '{{"id": broken' || doc_id || '}}' else '' end || case when doc_id % 14 = 0 then {NL} || '{{again' || {NL} || '{{"id": "s"}}' else '' end""",
}


@R.query(f"""with f as ({_sql("documents", FILES)}), l as (select path, k as line, rtrim(trim(ls[k]), ',') as j from (select path, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as k from f)),
o as (select * from l where starts_with(j, '{{')), bad as (select path, arg_min(j, line) as j from o where not json_valid(j) group by path)
select path, json_extract_string(j, '$.id') as id, json_extract_string(j, '$.verdict') as verdict, coalesce(array_to_string(from_json(json_extract(j, '$.also_relevant'), '["VARCHAR"]'), ','), '') as also, cast(null as varchar) as error from o where path not in (select path from bad)
union all select path, null, null, null, 'not valid JSON: ' || substr(j, 1, 80) from bad""")
def q_answer_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of answers for each document."""
    files = _made(spark, sf_dir, "documents", FILES)
    rows = generation.answer_rows(files).select("path", "id", "verdict", F.coalesce(F.array_join("also_relevant", ","), F.lit("")).alias("also"), F.lit(None).cast("string").alias("error"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("id", "verdict", "also")]
    return rows.unionByName(generation.answer_errors(files).select("path", *nothing, "error"))


CAPTURED = {
    "id": "event_id",
    "pods": f"'NAME READY STATUS RESTARTS AGE' || {NL} || 'web-' || user_id || ' ' || (event_id % 3) || '/2 ' || case when event_id % 4 = 0 then 'Running' else 'CrashLoopBackOff' end || ' ' || (event_id % 2) || case when event_id % 3 = 0 then ' (12s ago)' else '' end || ' 5m' || {NL} || 'db-0 1/1 Running 0 9m' || {NL} || event_type || '-x 2/2 Running ' || (user_id % 3) || ' 1h' || {NL} || 'job x'",
    "events": f"'LAST TYPE REASON OBJECT MESSAGE' || {NL} || '1m Normal Scheduled pod/web ok' || {NL} || '2m Warning BackOff pod/web Back-off ' || event_type || {NL} || '3m Warning ' || case when event_id % 3 = 0 then 'BackOff' else 'Failed' end || ' pod/web Back-off ' || event_type || {NL} || '4m Warning Failed pod/db image ' || user_id || ' not found'",
    "described": f"'Name: web' || {NL} || 'Status: ' || case when event_id % 2 = 0 then 'Running' else 'Failed' end || {NL} || '  State:   Waiting' || {NL} || '   Reason:  ' || event_type || {NL} || '   Reason:  ' || event_type || {NL} || '  Exit Code:   ' || (user_id % 5) || {NL} || 'Message: <none>'",
    "logs": f"'starting up' || {NL} || 'unable to retrieve container logs' || {NL} || event_type || ': of ' || user_id || case when event_id % 5 = 0 then {NL} || ' connection refused by ' || user_id else '' end || {NL} || 'ok' || case when event_id % 7 = 0 then {NL} || 'timed out' || {NL} else '' end",
}
SAID = r"^\s*(Status|State|Reason|Exit Code|Message|Last State):\s*(.+)$"


@R.query(f"""with v as ({_sql("events", CAPTURED)}),
pr as (select id, k, regexp_split_to_array(trim(x), '\\s+') as c from (select id, generate_subscripts(ls, 1) as k, unnest(ls) as x from (select id, list_filter(string_split(pods, chr(10)), lambda x: trim(x) <> '')[2:] as ls from v))),
pb as (select id, list(c[1] || ' ' || c[2] || ' ' || c[3] || ' ' || case when starts_with(coalesce(c[5], ''), '(') then c[4] || ' ' || c[5] || ' ' || c[6] else c[4] end order by k)[:3] as x
  from pr where len(c) >= 4 and contains(c[2], '/') and (split_part(c[2], '/', 1) <> split_part(c[2], '/', 2) or c[3] <> 'Running' or c[4] <> '0') group by id),
er as (select id, k, regexp_extract(x, '^\\S+\\s+(\\S+)\\s+(\\S+)\\s+\\S+\\s+(.+)$', ['t', 'r', 'm']) as e from (select id, generate_subscripts(ls, 1) as k, unnest(ls) as x from (select id, string_split(events, chr(10))[2:] as ls from v)) where trim(x) <> ''),
ev as (select id, list(x order by k)[:4] as x from (select id, min(k) as k, e.t || ' ' || e.r || ' ' || e.m as x from er where e.r not in ('Scheduled') group by id, e) group by id),
dr as (select id, list(x order by k)[:8] as x from (select id, min(k) as k, x from (select id, k, regexp_extract(x, '{SAID}', 1) || ': ' || trim(regexp_extract(x, '{SAID}', 2)) as x
  from (select id, generate_subscripts(ls, 1) as k, unnest(ls) as x from (select id, string_split(described, chr(10)) as ls from v)) where regexp_matches(x, '{SAID}') and not regexp_matches(x, 'Running|<none>')) group by id, x) group by id),
lg as (select id, list_filter(list_transform(string_split(logs, chr(10)), lambda x: trim(x)), lambda x: x <> '' and not starts_with(x, 'unable to retrieve') and not starts_with(x, 'Error from server') and regexp_matches(x, '(?i){T.ERROR_LINE.replace("'", "''")}'))[-2:] as x from v)
select id, coalesce(array_to_string(pb.x, ';'), '') as pods, coalesce(array_to_string(ev.x, ';'), '') as events, coalesce(array_to_string(dr.x, ';'), '') as described, array_to_string(lg.x, ';') as logs
from v left join pb using (id) left join ev using (id) left join dr using (id) left join lg using (id)""")
def q_incident_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture for each event."""
    rows = _made(spark, sf_dir, "events", CAPTURED)
    made = {"pods": incident.problem_pods(F.col("pods")), "events": incident.event_lines(F.col("events")), "described": incident.describe_lines(F.col("described")), "logs": T.error_lines(F.col("logs"))}
    return rows.select("id", *[F.array_join(c, ";").alias(k) for k, c in made.items()])


ANSWERS = {
    "batch": "doc_id",
    "answer": f"""case when doc_id % 5 = 0 then 'not json at all ' || doc_id else case when doc_id % 2 = 0 then '{FENCE}json' || {NL} else '' end || '{{"results": [{{"passage": 1, "suitable": ' || case when doc_id % 3 = 0 then 'false' else 'true' end || ', "queries": [{{"style": "how_to", "query": " How  to ' || source || '? "}}, {{"style": "bad", "query": "x"}}, {{"style": "symptom", "query": "how to ' || case when doc_id % 7 = 0 then lang else source end || '?"}}, {{"style": "symptom", "query": "Node ' || doc_id || ' stuck"}}, {{"style": "how_to", "query": "fourth"}}]}}, {{"passage": 2, "suitable": true, "queries": [{{"style": "symptom", "query": ""}}, {{"style": "kubectl_output", "query": "Pod ' || lang || ' pending"}}]}}]}}' || case when doc_id % 2 = 0 then {NL} || '{FENCE}' else '' end end""",
}


@R.query(f"""with v as (select batch, regexp_replace(answer, '(?s)\\A\\s*{FENCE}(?:json)?\\s*(.*?)\\s*{FENCE}\\s*\\z', '\\1') as j from ({_sql("documents", ANSWERS)})),
r as (select batch, unnest(from_json(json_extract(j, '$.results'), '[{{"passage": "INTEGER", "suitable": "BOOLEAN", "queries": [{{"style": "VARCHAR", "query": "VARCHAR"}}]}}]')) as r from v where json_valid(j)),
q as (select batch, r.passage as passage, list_filter(r.queries, lambda x: x.style in ('incident_snapshot', 'symptom', 'how_to', 'error_string', 'kubectl_output') and length(trim(x.query)) >= 1)[:3] as qs from r where r.suitable),
e as (select batch, passage, generate_subscripts(qs, 1) as k, unnest(qs) as q from q),
f as (select batch, passage, q.style as style, trim(regexp_replace(q.query, '\\s+', ' ', 'g')) as query, k from e),
p as (select doc_id as batch, 1 as passage, 'a#' || doc_id as chunk_id from documents union all select doc_id, 2, 'b#' || doc_id from documents where doc_id % 4 <> 1)
select p.chunk_id, style, query from (select *, row_number() over (partition by batch, passage, lower(query) order by k) as n from f) f join p on f.batch = p.batch and f.passage = p.passage where n = 1""")
def q_llm_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each document, about two passages of it; some answers speak of one that isn't there."""
    docs = table(spark, sf_dir, "documents")
    first = docs.select(F.col("doc_id").alias("batch"), F.lit(1).alias("passage"), F.concat(F.lit("a#"), "doc_id").alias("chunk_id"))
    second = docs.where("doc_id % 4 <> 1").select(F.col("doc_id").alias("batch"), F.lit(2).alias("passage"), F.concat(F.lit("b#"), "doc_id").alias("chunk_id"))
    return generation.parsed_answers(_made(spark, sf_dir, "documents", ANSWERS), first.unionByName(second))


SECTIONS = ["Symptoms", "Fix"]
RUNBOOKS = {
    "id": "case when doc_id % 9 = 0 then 'Bad_' else 'doc-' end || doc_id",
    "body": f"case when doc_id % 4 = 0 then '# Title' || {NL} else '' end || '## Symptoms' || case when doc_id % 3 = 0 then '  ' else '' end || {NL} || substr(coalesce(text, ''), 1, cast((doc_id * 37) % 6000 as int)) || {NL} || case when doc_id % 5 = 0 then '' else '## Fix' || {NL} end || 'Raise the limit of ' || source",
    "related": "split('doc-' || (doc_id + 1) || ',gone-' || lang, ',')",
    "expect": "split('(?i)' || lang || ',^Raise,missing', ',')",
}


@R.query(f"""with v as ({_sql("documents", RUNBOOKS)}), w as (select *, len(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')) as n from v),
loose as (select id, string_agg(r, ',' order by r) as dangling from (select id, unnest(related) as r from v) where r not in (select id from v) group by id)
select id, array_to_string(list_filter([case when not regexp_matches(id, '^[a-z0-9]+(?:-[a-z0-9]+)*$') then 'name' end, case when regexp_extract_all(body, '(?m)^##\\s+(.+?)\\s*$', 1) <> ['Symptoms', 'Fix'] then 'sections' end,
  case when regexp_matches(body, '(?m)^#\\s') then 'title' end, case when n not between 8 and 700 then 'words' end], lambda x: x is not null), ',') as errors,
  coalesce(dangling, '') as dangling, array_to_string(list_filter(expect, lambda p: not regexp_matches(body, '(?m)' || p)), ',') as unmatched,
  id not in (select 'doc-' || doc_id from documents where doc_id % 2 = 0) as uncovered from w left join loose using (id)""")
def q_validation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A runbook for each document, a scenario for every other."""
    rows = _made(spark, sf_dir, "documents", RUNBOOKS)
    scenarios = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("doc-"), "doc_id").alias("id"))
    loose = generation.dangling(rows).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("related")), ",").alias("dangling"))
    bare = generation.uncovered(rows, scenarios, "id").where("side = 'left'").select("id", F.lit(True).alias("bare"))
    joined = rows.join(loose, "id", "left").join(bare, "id", "left")
    return joined.select("id", F.array_join(generation.runbook_errors(F.col("id"), F.col("body"), SECTIONS, 8), ",").alias("errors"), F.coalesce("dangling", F.lit("")).alias("dangling"), F.array_join(incident.unmatched(F.col("expect"), F.col("body")), ",").alias("unmatched"), F.coalesce("bare", F.lit(False)).alias("uncovered"))


POD = {
    "pod": """case event_id % 4 when 0 then '{"metadata": {"name": "new-' || event_id || '"}}' else '{"metadata": {"name": "web-' || event_id || '"}, "status": {' || case when event_id % 3 = 0 then '"initContainerStatuses": [{"name": "init", "restartCount": 0, "state": {"terminated": {"exitCode": ' || (user_id % 2) || '}}}], ' else '' end || '"containerStatuses": [{"name": "' || event_type || '", "restartCount": ' || (user_id % 4) || case when user_id % 3 = 0 then ', "lastState": {"terminated": {"exitCode": 1}}' else '' end || ', "state": ' || case when event_id % 2 = 0 then '{"running": {"startedAt": "t"}}' else '{"waiting": {"reason": "x"}}' end || '}]}}' end"""
}


@R.query(f"""with v as (select pod::json as j from ({_sql("events", POD)})), c as (select json_extract_string(j, '$.metadata.name') as pod, unnest(list_concat(coalesce(from_json(json_extract(j, '$.status.initContainerStatuses'), '["JSON"]'), []), coalesce(from_json(json_extract(j, '$.status.containerStatuses'), '["JSON"]'), []))) as c from v)
select pod, json_extract_string(c, '$.name') as container, true as previous from c where coalesce(cast(json_extract(c, '$.restartCount') as integer), 0) > 0 or json_exists(c, '$.lastState.terminated')
union all select pod, json_extract_string(c, '$.name'), false from c where json_exists(c, '$.state.running') or json_exists(c, '$.state.terminated')""")
def q_pod_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pod for each event."""
    return incident.log_targets(_made(spark, sf_dir, "events", POD), "pod")


HELP = {
    "doc_id": "doc_id",
    "message": "case doc_id % 4 when 0 then 'no hint' when 1 then 'Retry in ' || (doc_id % 50) || 's' when 2 then 'Please retry in ' || (doc_id % 60) || 'm' || (doc_id % 50) || '.5s.' else 'retry in ' || (doc_id % 30) || 'h' || (doc_id % 60) || 'm' || (doc_id % 50) || '.25s' end",
    "path": "source || case doc_id % 4 when 0 then '.yaml' when 1 then '.conf' when 2 then '.sh' else '.unknown' end",
    "body": "'cost $' || doc_id || ' in {ns}: ' || substr(coalesce(text, ''), 1, 60) || '{ns}'",
    "items": "split(lang || ',' || source || case when doc_id % 3 = 0 then ',more' else '' end, ',')",
}


@R.query(f"""with v as (select *, regexp_extract(message, '(?i)retry in (?:(\\d+)h)?(?:(\\d+)m)?(?:([\\d.]+)s)?', ['h', 'm', 's']) as r from ({_sql("documents", HELP)}))
select doc_id, case when r.h || r.m || r.s <> '' then coalesce(try_cast(r.h as double), 0) * 3600 + coalesce(try_cast(r.m as double), 0) * 60 + coalesce(try_cast(r.s as double), 0) end as seconds,
  coalesce(case regexp_extract(path, '(\\.[^./]+)$', 1) when '.yaml' then 'yaml' when '.sh' then 'shell' when '.conf' then '' end, '') as language, replace(replace(body, '{{ns}}', 'prod'), '$', '\\$') as body,
  array_to_string(list_transform(items, lambda x, i: '<candidate letter="' || chr(64 + i::integer) || '">' || x || '</candidate>'), chr(10)) as listed from v""")
def q_text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, "documents", HELP)
    return rows.select("doc_id", T.retry_seconds(F.col("message")).alias("seconds"), T.fence_language(F.col("path")).alias("language"), T.escape_dollars(T.filled(F.col("body"), {"ns": F.lit("prod")})).alias("body"), T.lettered(F.col("items")).alias("listed"))


@R.query("""with b as (select item_id, text, (row_number() over (order by item_id) - 1) // 8 as batch, (row_number() over (order by item_id) - 1) % 8 + 1 as pos from benchmark)
select batch, sha256(string_agg('[' || pos || '] ' || text, chr(10) || chr(10) order by pos)) as prompt_sha256 from b group by batch""")
def q_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batches(table(spark, sf_dir, "benchmark").withColumn("all", F.lit(0)), "all", [F.col("item_id")], 8)
    return generation.prompts(rows.select("batch", F.col("item_id").alias("pos"), F.col("text").alias("passage"))).select("batch", F.sha2("prompt", 256).alias("prompt_sha256"))


@R.query("""select doc_id, true as shaped, true as recent from labels""")
def q_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the time in UTC to the second at which they are given: whether it has that form and is now."""
    given = with_time(table(spark, sf_dir, "labels")).select("doc_id", "labeled_at")
    age = F.unix_timestamp() - F.unix_timestamp(F.to_timestamp("labeled_at", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return given.select("doc_id", F.col("labeled_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$").alias("shaped"), age.between(-5, 3600).alias("recent"))
