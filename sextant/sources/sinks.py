"""Writers: whole tables replaced at once, logs appended to, results formatted."""

from __future__ import annotations

import json
import resource
import subprocess
import time
import traceback
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sextant.operators.freeze import slice_counts
from sextant.operators.metrics import METRICS
from sextant.sources.readers import exists

#: Slices in the order in which reports have them.
SLICES = ("all", "incident_snapshot", "error_string", "symptom", "how_to", "kubectl_output", "low_overlap", "real_incident_heldout", "real_incident_seen", "stackoverflow", "handwritten")
#: The file of a frozen set that names the folder that counts. Its name begins with no underscore, so Spark reads it.
POINTER = "current.txt"
RUN = "run_id string, started string, phase string, name string, status string, commit string, seed long, seconds double, driver_mb double, executor_mb double, config string, metrics string, notes string"


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Replaces the table at path, all or nothing; returns its rows, counted as they are written."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def metric_table(results: DataFrame, split: str, ranker: str) -> DataFrame:
    """Results by slice as text, four digits each, in the fixed order of slices, then by name."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SLICES]), F.col("slice")), F.lit(0))
    place = F.when(place == 0, len(SLICES) + 1).otherwise(place)
    rows = results.orderBy(place, "slice")
    return rows.select(F.lit(split).alias("split"), F.lit(ranker).alias("ranker"), "slice", F.col("n").cast("string").alias("n"), *[F.format_string("%.4f", m).alias(m) for m in METRICS])


def write_metrics(results: DataFrame, path: str, split: str, ranker: str) -> None:
    """One CSV file with a header: a row for each slice, so small whatever the data."""
    metric_table(results, split, ranker).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append(rows: DataFrame, path: str) -> None:
    """Appends to a Parquet log; other columns than the log has are an error."""
    spark = rows.sparkSession
    if exists(spark, path):
        there = spark.read.parquet(path)
        if [(f.name, f.dataType) for f in there.schema] != [(f.name, f.dataType) for f in rows.schema]:
            raise ValueError(f"{path} has the columns {there.columns}, not {rows.columns}")
    rows.write.mode("append").parquet(path)


def with_time(labels: DataFrame) -> DataFrame:
    """Adds labeled_at: the time in UTC to the second."""
    return labels.withColumn("labeled_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def append_labels(labels: DataFrame, path: str) -> None:
    """Appends labels, each with the time."""
    append(with_time(labels), path)


MANIFEST = "name string, rows long, content string, slices map<string,long>"


def freeze(tables: dict[str, DataFrame], path: str, force: bool = False) -> DataFrame:
    """Writes tables as Parquet below path and a manifest of their rows, contents and, where they have a column `slice`, rows
    by slice; refuses to replace a set unless forced. A table's content is the sum of its rows' hashes, so it doesn't
    hang on files or on the order of rows.

    All or nothing: tables and manifest are written to a folder of their own, and one small file, replaced at the end,
    says which folder counts. Until then readers see the old set, and afterwards the new one; folders that don't count
    are left for whoever reads them still.
    """
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, f"{path}/{POINTER}") and not force:
        raise FileExistsError(f"{path} is frozen")
    name = f"set-{uuid.uuid4().hex}"
    found = None
    for table, rows in tables.items():
        rows.write.parquet(f"{path}/{name}/{table}")
        one = content(spark.read.parquet(f"{path}/{name}/{table}"), table)
        found = one if found is None else found.unionByName(one)
    found.coalesce(1).write.json(f"{path}/{name}/manifest")
    write_text(spark, f"{path}/{POINTER}", name)
    return manifest(spark, path)


def frozen_folder(spark: SparkSession, path: str) -> str:
    """The folder of the set that counts."""
    return f"{path}/{spark.read.text(f'{path}/{POINTER}').first()[0]}"


def frozen(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a frozen set."""
    return spark.read.parquet(f"{frozen_folder(spark, path)}/{table}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, rows, content, slices of each table of a frozen set."""
    return spark.read.schema(MANIFEST).json(f"{frozen_folder(spark, path)}/manifest")


def content(rows: DataFrame, name: str) -> DataFrame:
    """name, rows, content, slices (null without a column of that name) of a table."""
    value = F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct("*")), 256), 1, 15), 16, 10).cast("decimal(38,0)"))
    whole = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(value, F.lit(0)).cast("string").alias("content"))
    if "slice" in rows.columns:
        each = slice_counts(rows).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("slice", F.lit("")), "n")))).alias("slices"))
    else:
        each = rows.sparkSession.range(1).select(F.lit(None).cast("map<string,long>").alias("slices"))
    return whole.join(F.broadcast(each), how="cross").select(F.lit(name).alias("name"), "rows", "content", "slices")


def verify(spark: SparkSession, path: str) -> list[str]:
    """Names of frozen tables that aren't what the manifest says."""
    wrong = []
    for r in manifest(spark, path).collect():
        now = content(frozen(spark, path, r["name"]), r["name"]).first()
        if (now["rows"], now["content"], now["slices"]) != (r["rows"], r["content"], r["slices"]):
            wrong.append(r["name"])
    return wrong


def report(rows: DataFrame, title: str) -> str:
    """A Markdown table of a small result, such as a table of metrics."""
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows.collect()], ""])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small text file, such as a report, all or nothing: written beside it, then renamed over it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{time.time_ns()}")
    stream = files.create(beside, True)
    try:
        stream.write(text.encode())
        stream.close()
        # a rename that replaces is one step of the file system, where rename alone may refuse
        how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, target, how)
    finally:
        files.delete(beside, False)


def commit_of(folder: str = ".") -> str | None:
    """The commit that a folder's files are of, if it is a git repository."""
    try:
        done = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None


def executor_peak_mb(spark: SparkSession) -> float | None:
    """The most memory, heap and beyond, that any executor has told of so far; null before the first has."""
    known = spark._jsc.sc().statusStore().executorList(True)
    peaks = [known.apply(k).peakMemoryMetrics() for k in range(known.size())]
    found = [p.get().getMetricValue("JVMHeapMemory") + p.get().getMetricValue("JVMOffHeapMemory") for p in peaks if p.isDefined()]
    return round(max(found) / (1 << 20), 1) if found else None


@contextmanager
def tracked(spark: SparkSession, path: str, name: str, config: dict, phase: str = "", seed: int | None = None) -> Iterator[dict]:
    """Runs a block and appends a row about it to the log at path: how it ended, how long it took, the commit, the driver's and
    the executors' peak memory, and what it put into the dictionary that it is given (of that, `notes` by itself)."""
    metrics: dict = {}
    started, began, status = time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime()), time.time(), "ok"
    try:
        yield metrics
    except BaseException:
        status = "failed:" + traceback.format_exc().strip().rpartition("\n")[2].partition(":")[0]
        raise
    finally:
        notes = str(metrics.pop("notes", ""))
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        as_json = lambda x: json.dumps(x, sort_keys=True, default=str)
        row = (uuid.uuid4().hex[:12], started, phase, name, status, commit_of(), seed, round(time.time() - began, 1), round(peak, 1), executor_peak_mb(spark), as_json(config), as_json(metrics), notes)
        append(spark.createDataFrame([row], RUN), path)
