"""Captures of incidents: tables and logs as text, parsed into the lines that make a query. All in array functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions.text import ERROR_LINE, all_error_lines, error_lines

#: Events that happen all the time.
ROUTINE = "Scheduled SuccessfulCreate ScalingReplicaSet Pulled Pulling Created Started SuccessfulDelete SandboxChanged Completed RegisteredNode Starting".split()
#: Lines of a description that tell something; what marks the strongest error lines; what else a table says of
#: an error; names of machines and of the cluster, and what stands for them.
DESCRIBED = r"^\s*(Status|State|Reason|Exit Code|Message|Last State):\s*(.+)$"
STRONG, TABLE_ERROR = "(?i)error|forbidden|denied|cannot|failed", "<pending>|<unknown>|NotReady"
PLACES = (("k3d-rr-faults-agent-0", "worker-1"), ("k3d-rr-faults-server-0", "worker-2"), ("rr-faults", "cluster"))
SECTION = "array<struct<title:string,command:string,output:string>>"
#: Schema of a capture record.
CAPTURE = f"id string, runbook string, description string, status string, error string, captured_at string, namespace string, missing array<string>, seconds double, versions struct<client:string,server:string>, sections {SECTION}"


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")


def _fields(line: Column, most: int = -1) -> Column:
    return F.split(F.trim(line), r"\s+", most)


def problem_pods(table: Column, most: int = 3) -> Column:
    """Pods of a table that aren't fully ready and running: name, readiness, status, restarts with their time if given."""
    rows = F.transform(F.slice(_lines(table), 2, 1 << 30), lambda x: _fields(x))
    rows = F.filter(rows, lambda c: (F.size(c) >= 4) & F.contains(c[1], F.lit("/")))

    def restarts(c: Column) -> Column:
        timed = F.coalesce(F.startswith(F.get(c, 4), F.lit("(")), F.lit(False))
        return F.when(timed, F.concat_ws(" ", c[3], F.get(c, 4), F.get(c, 5))).otherwise(c[3])

    def bad(c: Column) -> Column:
        ready = F.split(c[1], "/", 2)
        return (ready[0] != ready[1]) | (c[2] != "Running") | (restarts(c) != "0")

    return F.slice(F.transform(F.filter(rows, bad), lambda c: F.concat_ws(" ", c[0], c[1], c[2], restarts(c))), 1, most)


def describe_lines(text: Column, most: int = 8) -> Column:
    """States, reasons, exit codes and messages, each once; what is running or none says nothing."""
    pattern = DESCRIBED
    found = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(pattern) & ~F.trim(F.regexp_extract(x, pattern, 2)).isin("Running", "<none>"))
    said = F.transform(found, lambda x: F.concat(F.regexp_extract(x, pattern, 1), F.lit(": "), F.regexp_replace(F.trim(F.regexp_extract(x, pattern, 2)), r"\s+", " ")))
    return F.slice(F.array_distinct(said), 1, most)


def event_lines(table: Column, most: int = 4) -> Column:
    """Events out of the routine: type, reason, message, each once."""
    rows = F.transform(F.slice(F.split(table, r"\r?\n"), 2, 1 << 30), lambda x: _fields(x, 5))
    rows = F.filter(rows, lambda c: (F.size(c) >= 5) & ~c[2].isin(ROUTINE))
    return F.slice(F.array_distinct(F.transform(rows, lambda c: F.concat_ws(" ", c[1], c[2], c[4]))), 1, most)


def last_error_lines(rows: DataFrame, group: str, pos: str, text: str, last: int = 2, ties: Sequence[str] = ()) -> DataFrame:
    """rows: group, pos, text: a log for each value of group, its texts (a line or more each, none if null) below each other in
    the order of pos, then of ties. group, n_lines (that look like errors), lines (the last of them, in order); groups
    without such lines have no row. Lines are counted and picked where they are, so a log may be of any length."""
    order = [pos, *ties, "_at"]
    found = rows.select(group, pos, *ties, F.posexplode(all_error_lines(F.col(text))).alias("_at", "_line"))
    counts = found.groupBy(group).agg(F.count(F.lit(1)).alias("n_lines"))
    latest = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    picked = found.withColumn("_k", F.row_number().over(latest)).where(F.col("_k") <= last)
    picked = picked.groupBy(F.col(group).alias("_group")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, "_line"))), lambda x: x["_line"]).alias("lines"))
    return counts.join(picked, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def _output(sections: Column, title: str) -> Column:
    return F.coalesce(F.get(F.filter(sections, lambda s: s["title"] == title), 0)["output"], F.lit(""))


def snapshot_queries(captures: DataFrame, most_words: int = 160, places: tuple[tuple[str, str], ...] = PLACES) -> DataFrame:
    """captures: CAPTURE rows. id, full, brief for those whose status is ok: what is seen, errors first, as one line."""
    s = F.col("sections")
    is_log = lambda x: F.startswith(x["title"], F.lit("logs"))
    logs = F.flatten(F.transform(F.filter(s, is_log), lambda x: error_lines(x["output"])))
    other = F.filter(s, lambda x: ~is_log(x) & ~x["title"].isin("pods", "describe pods", "events"))
    errors = F.flatten(F.transform(other, lambda x: F.filter(F.transform(F.split(x["output"], r"\r?\n"), lambda y: F.trim(y)), lambda y: y.rlike("(?i)" + ERROR_LINE) | y.rlike(TABLE_ERROR))))
    strong = lambda x: x.rlike(STRONG)
    rows = captures.where("status = 'ok'").select(
        "id", "namespace", problem_pods(_output(s, "pods")).alias("pods"), describe_lines(_output(s, "describe pods")).alias("describe"), event_lines(_output(s, "events")).alias("events"),
        F.transform(F.slice(F.array_distinct(logs), 1, 2), lambda x: F.concat(F.lit("log: "), x)).alias("logs"), F.array_distinct(errors).alias("errors"),
    )
    rows = rows.withColumn("extra", F.slice(F.concat(F.filter("errors", strong), F.filter("errors", lambda x: ~strong(x))), 1, 4))
    told = F.transform("events", lambda x: F.concat(F.lit("event: "), x))
    warned = F.filter("events", lambda x: F.startswith(x, F.lit("Warning")))
    full = F.concat("pods", "describe", told, "logs", "extra")
    brief = F.concat(F.slice("pods", 1, 1), F.slice(F.concat(warned, "logs", "extra", "events", "describe"), 1, 1))

    def line(parts: Column) -> Column:
        text = F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), " | ")
        text = F.regexp_replace(F.trim(anonymous(text, F.col("namespace"), places)), r"\s+", " ")
        return F.array_join(F.slice(F.split(text, " "), 1, most_words), " ")

    return rows.select("id", line(full).alias("full"), line(brief).alias("brief"))


def anonymous(text: Column, namespace: Column, places: tuple[tuple[str, str], ...] = PLACES) -> Column:
    """Names of the place that a capture comes from, replaced: namespace, machines, cluster; generated names of pods need
    operators.markdown.randomized."""
    text = F.replace(text, namespace, F.lit("prod"))
    for name, other in places:
        text = F.replace(text, F.lit(name), F.lit(other))
    return text


def incident_rows(captures: DataFrame, scenarios: DataFrame, splits: DataFrame) -> DataFrame:
    """qid, query, variant, scenario, doc_id, relevant_docs, runbook_split: both variants of each good capture's query,
    with names of pods regenerated, joined with its scenario (id, runbook, also_relevant) and its runbook's split (doc_id,
    split). Captures without a scenario or a split have no rows; scenarios and splits are small tables of people."""
    from sextant.operators.markdown import randomized

    doc = lambda name: F.concat(F.lit("runbook/"), name)
    made = snapshot_queries(captures).select("id", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("query")) for v in ("full", "brief")])).alias("q"))
    rows = made.join(captures.where("status = 'ok'").select("id", F.col("runbook").alias("_seen")), "id").join(scenarios.select("id", "runbook", "also_relevant"), "id")
    rows = rows.withColumn("doc_id", doc(F.col("_seen"))).join(splits.select("doc_id", "split"), "doc_id")
    relevant = F.transform(F.concat(F.array("runbook"), F.coalesce("also_relevant", F.array().cast("array<string>"))), doc)
    return rows.select(F.concat_ws("/", F.lit("incident"), "id", "q.variant").alias("qid"), randomized(F.col("q.query")).alias("query"), "q.variant", F.col("id").alias("scenario"), "doc_id", relevant.alias("relevant_docs"), F.col("split").alias("runbook_split"))


POD = "metadata struct<name:string>, status struct<initContainerStatuses:{0},containerStatuses:{0}>".format("array<struct<name:string,restartCount:int,lastState:struct<terminated:struct<exitCode:int>>,state:struct<running:struct<startedAt:string>,terminated:struct<exitCode:int>>>>")


def log_targets(pods: DataFrame, column: str) -> DataFrame:
    """column: JSON of one pod. pod, container, previous: logs worth reading, of containers that crashed or restarted
    (previous) and of those that run or ended."""
    pod = pods.select(F.from_json(column, POD).alias("p"))
    none = F.array().cast(POD.split("initContainerStatuses:")[1].split(",containerStatuses:")[0])
    each = pod.select(F.col("p.metadata.name").alias("pod"), F.explode(F.concat(F.coalesce("p.status.initContainerStatuses", none), F.coalesce("p.status.containerStatuses", none))).alias("c"))
    before = each.where((F.coalesce("c.restartCount", F.lit(0)) > 0) | F.col("c.lastState.terminated").isNotNull()).select("pod", F.col("c.name").alias("container"), F.lit(True).alias("previous"))
    now = each.where(F.col("c.state.running").isNotNull() | F.col("c.state.terminated").isNotNull()).select("pod", F.col("c.name").alias("container"), F.lit(False).alias("previous"))
    return before.unionByName(now)


def unmatched(patterns: Column, text: Column) -> Column:
    """Patterns that no line of the text matches."""
    return F.filter(patterns, lambda p: ~F.rlike(text, F.concat(F.lit("(?m)"), p)))
