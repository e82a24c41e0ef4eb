"""Generated queries and runbooks: parsing answers, validating rows, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import one_line, unfenced

STYLES = ("incident_snapshot", "symptom", "how_to", "error_string", "kubectl_output")
ANSWER = "results array<struct<passage:int,suitable:boolean,queries:array<struct<style:string,query:string>>>>"


def parsed_answers(answers: DataFrame, chunks: DataFrame, each: int = 3) -> DataFrame:
    """answers: batch, answer (JSON, perhaps in a code fence); chunks: batch, passage (from 1), chunk_id. One row for each
    valid query: passage known and suitable, style known, query not empty; of a passage the first `each` valid ones,
    the same words only once. An answer that isn't JSON has no rows; one bad query doesn't spoil the others."""
    results = F.from_json(unfenced(F.col("answer")), ANSWER)["results"]
    rows = answers.select("batch", F.explode(results).alias("r")).where(F.coalesce("r.suitable", F.lit(False)))
    good = F.filter("r.queries", lambda q: q["style"].isin(*STYLES) & (F.length(one_line(q["query"])) >= 1))
    rows = rows.select("batch", F.col("r.passage").alias("passage"), F.posexplode(F.slice(good, 1, each)).alias("k", "q"))
    rows = rows.join(chunks, ["batch", "passage"]).select("batch", "passage", "chunk_id", "k", F.col("q.style").alias("style"), one_line(F.col("q.query")).alias("query"))
    first = rows.groupBy("batch", "passage", "chunk_id", F.lower("query").alias("_q")).agg(F.min_by(F.struct("style", "query"), "k").alias("row"))
    return first.select("chunk_id", "row.style", "row.query")


def json_lines(text: Column) -> Column:
    """Lines of a text that are objects, a comma at their ends aside."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.rtrim(F.trim(x), F.lit(",")))
    return F.filter(lines, lambda x: F.startswith(x, F.lit("{")))


def answer_rows(files: DataFrame, schema: str = "id string, verdict string, reason string, relevant array<string>, also_relevant array<string>") -> DataFrame:
    """files: path, text. The answers of all files whose object lines are all JSON, with pos: their order by path and
    line. A file with a line that isn't JSON is left out as a whole; answer_errors names it."""
    rows = _answer_lines(files)
    good = rows.join(answer_errors(files).select("path"), "path", "left_anti")
    return good.select("path", "line", F.from_json("json", schema).alias("a")).select("path", "line", "a.*")


def _answer_lines(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.posexplode(json_lines(F.col("text"))).alias("line", "json"))
    return rows.withColumn("valid", F.try_parse_json("json").isNotNull())


def answer_errors(files: DataFrame) -> DataFrame:
    """path, error for each file that answer_rows leaves out: its first line that isn't JSON."""
    bad = _answer_lines(files).where("not valid").groupBy("path").agg(F.min_by("json", "line").alias("json"))
    return bad.select("path", F.concat(F.lit("not valid JSON: "), F.substring("json", 1, 80)).alias("error"))


def runbook_errors(name: Column, body: Column, sections: list[str], least: int = 150, most: int = 700) -> Column:
    """What is wrong with a runbook: its name, its second-level headings, a first-level one, its length."""
    headings = F.regexp_extract_all(body, F.lit(r"(?m)^##\s+(.+?)\s*$"), F.lit(1))
    words = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))
    return F.array_compact(
        F.array(
            F.when(~name.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), "name"),
            F.when(headings != F.array(*[F.lit(s) for s in sections]), "sections"),
            F.when(body.rlike(r"(?m)^#\s"), "title"),
            F.when(~words.between(least, most), "words"),
        )
    )


def dangling(runbooks: DataFrame) -> DataFrame:
    """runbooks: id, related (array). References to runbooks that aren't there."""
    named = runbooks.select("id", F.explode("related").alias("related"))
    return named.join(runbooks.select(F.col("id").alias("related")), "related", "left_anti").select("id", "related")


def uncovered(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side that the other lacks, with the side: none if both cover each other."""
    left = a.select(key).distinct().join(b, key, "left_anti").select(F.lit("left").alias("side"), key)
    return left.unionByName(b.select(key).distinct().join(a, key, "left_anti").select(F.lit("right").alias("side"), key))


def prompts(batches: DataFrame) -> DataFrame:
    """batches: batch, pos, passage (text). One text a batch: its passages, numbered from 1."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "passage")))
    return batches.groupBy("batch").agg(F.array_join(F.transform(rows, lambda x, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), x["passage"])), "\n\n").alias("prompt"))
