"""Readers: strict schemas, errors that name the file, and the order of rows where it matters."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sextant.functions.text import FRONT, doc_id, glob_pattern
from sextant.operators.corpus import repeated_keys
from sextant.operators.generation import dangling, runbook_errors
from sextant.operators.incident import CAPTURE

FRONT_MATTER = r"(?s)\A" + FRONT
CHUNK = "chunk_id string, doc_id string, source string, source_path string, url string, title string, section string, text string, n_tokens int, meta map<string,string>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _is_object(line: Column) -> Column:
    return F.startswith(F.ltrim(line), F.lit("{")) & F.try_parse_json(line).isNotNull()


def jsonl_problems(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1), value of each line that is neither blank nor a JSON object.

    A line's number is the number of lines in the parts of its file before its own, and its place there; rows of a part
    are read in order, so a count and a least number for each part are all that is gathered.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), "value")
    parts = rows.groupBy("path", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).drop("n")
    bad = rows.where((F.trim("value") != "") & ~_is_object(F.col("value")))
    return bad.join(parts, ["path", "part"]).select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType, check: bool = False) -> DataFrame:
    """A row for each line that isn't blank, and its file as `path`; a line that isn't an object of the schema is an error
    that names its file when it is read. check: all lines are looked at first, and the error names file and line."""
    if check and (bad := jsonl_problems(spark, path).orderBy("path", "line").limit(5).collect()):
        raise ValueError("not a JSON object: " + "; ".join(f"{r['path']}:{r['line']}: {r['value'][:80]}" for r in bad))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.trim("value") != "")
    wrong = F.concat(F.lit("not a JSON object, in "), "path", F.lit(": "), F.substring("value", 1, 80))
    checked = F.when(_is_object(F.col("value")), F.col("value")).otherwise(F.raise_error(wrong))
    return lines.select("path", F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("row")).select("row.*", "path")


def optional_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An empty table where there is no file."""
    return jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], f"{schema}, path string")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of chunks; a chunk_id that occurs twice is an error."""
    rows = jsonl(spark, path, CHUNK).drop("path")
    if twice := repeated_keys(rows, "chunk_id").limit(5).collect():
        raise ValueError(f"chunk_ids occur more than once: {[r['chunk_id'] for r in twice]}")
    return rows


def _hidden(spark: SparkSession, root: str) -> DataFrame:
    """file, text of Markdown files whose names begin with _, which Spark's sources leave out: index pages of folders.
    They are listed and read by the driver, through Hadoop's file systems."""
    jvm, top = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    rows, files = [], fs.listFiles(top, True)
    while files.hasNext():
        path = files.next().getPath()
        if path.getName().startswith("_") and path.getName().endswith(".md"):
            stream = fs.open(path)
            rows.append((path.toString(), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
    return spark.createDataFrame(rows, "file string, text string")


def markdown_tree(spark: SparkSession, root: str, include: Iterable[str] = ("**",), exclude: Iterable[str] = ()) -> DataFrame:
    """path, doc_id, text of the Markdown files below root whose relative path an include pattern matches and no exclude
    pattern does; pos gives their order by parts of the path, as a listing of directories has it. title is that of the front
    matter, null without one, meta its plain entries, and text what follows it. An include pattern that no file matches is an error."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    base = root.rstrip("/").rpartition(":")[2].lstrip("/")
    shown = files.select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file"), F.col("value").alias("text"))
    rows = shown.unionByName(_hidden(spark, root)).select(F.substring_index("file", base + "/", -1).alias("path"), "text")

    def any_of(globs: Iterable[str]):  # noqa: ANN202
        found = F.lit(False)
        for g in globs:
            found = found | F.col("path").rlike(glob_pattern(g))
        return found

    include = list(include)
    met = rows.agg(*[F.max(F.col("path").rlike(glob_pattern(g))).alias(f"g{k}") for k, g in enumerate(include)]).first()
    if missing := [g for g, found in zip(include, met, strict=True) if not found and g != "**"]:
        raise FileNotFoundError(f"no file below {root} matches {missing}")
    rows = rows.where(any_of(include) & ~any_of(exclude)).distinct()
    front = F.regexp_extract("text", FRONT_MATTER, 1)
    title = F.regexp_replace(F.trim(F.regexp_extract(front, r"(?m)^title:[ \t]*(.*)$", 1)), r"^(['\"])(.*)\1$", "$2")
    return rows.select("path", doc_id(F.col("path")).alias("doc_id"), F.nullif(title, F.lit("")).alias("title"), F.regexp_replace("text", FRONT_MATTER, "").alias("text"), F.split("path", "/").alias("pos"), front_matter(front).alias("meta"))


def front_matter(front: Column) -> Column:
    """The plain entries of a front matter, name: value, as a map; of several of a name the last one. Nested ones are left out."""
    lines = F.filter(F.split(front, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:[ \t]*\S"))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[\w-]+:[ \t]*(.*)$", 1)), r"^(['\"])(.*)\1$", "$2").alias("value"))
    return F.aggregate(lines, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != entry(x)["key"]), F.create_map(entry(x)["key"], entry(x)["value"])))


def list_entry(value: Column) -> Column:
    """The items of an entry such as [a, b], or a, b."""
    items = F.transform(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ","), lambda x: F.regexp_replace(F.trim(x), r"^(['\"])(.*)\1$", "$2"))
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x != "")


def runbooks(spark: SparkSession, root: str, sections: list[str], least: int = 150, most: int = 700) -> DataFrame:
    """id, title, body, related of the runbooks below root: Markdown files, their id the file's name. All files are looked at
    before anything is raised: the error lists everything that is wrong with any of them, rules and references alike."""
    rows = markdown_tree(spark, root).select(F.regexp_replace(F.element_at("pos", -1), r"\.md$", "").alias("id"), "title", F.trim("text", F.lit(" \t\r\n")).alias("body"), list_entry(F.col("meta")["related"]).alias("related"))
    wrong = rows.select("id", F.explode(F.concat(runbook_errors(F.col("id"), F.col("body"), sections, least, most), F.when(F.col("title").isNull(), F.array(F.lit("no title"))).otherwise(F.array().cast("array<string>")))).alias("error"))
    wrong = wrong.unionByName(dangling(rows).select("id", F.concat(F.lit("related runbook '"), "related", F.lit("' does not exist")).alias("error")))
    found = [f"{r['id']}: {r['error']}" for r in wrong.orderBy("id", "error").toLocalIterator()]
    if rows.isEmpty():
        raise ValueError(f"no runbooks in {root}")
    if found:
        raise ValueError("invalid runbooks:\n  " + "\n  ".join(found))
    return rows


def captures(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Captures of incidents: a JSON document each, or a line each."""
    return spark.read.schema(CAPTURE).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def csv_results(spark: SparkSession, path: str, schema: str, slice_: str | None = None) -> DataFrame:
    """A result table with its header, of one slice if named."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return rows if slice_ is None else rows.where(F.col("slice") == slice_)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256, size of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def scenarios(spark: SparkSession, texts: dict[str, str], schema: str) -> DataFrame:
    """Scenarios from the text of small YAML files by name, read by the driver; names that begin with _ are left out, a
    repeated id is an error. YAML is optional; JSON, which is YAML too, is read without it."""
    rows = []
    for name in sorted(texts):
        if not name.startswith("_"):
            rows.append(_yaml(name, texts[name]))
    ids = [r["id"] for r in rows]
    if len({*ids}) < len(ids):
        raise ValueError(f"ids occur more than once: {sorted(i for i in {*ids} if ids.count(i) > 1)}")
    kind = T.StructType.fromDDL(schema)
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in rows], kind)


def _yaml(name: str, text: str) -> dict:
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"{name} is YAML, and PyYAML isn't installed") from e
    return yaml.safe_load(text)
