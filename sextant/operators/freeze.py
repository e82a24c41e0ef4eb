"""Evaluation sets: assembling queries and relevance, checking them, and the manifest that pins them down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.operators.sampling import halves


def doc_chunks(corpus: DataFrame) -> DataFrame:
    """doc_id, chunks: its chunk_ids in corpus order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "chunk_id")))
    return corpus.groupBy("doc_id").agg(F.transform(rows, lambda x: x["chunk_id"]).alias("chunks"))


def qrels(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """queries: qid, relevant_docs (array). One row for each chunk of each relevant document, once a query."""
    named = queries.select("qid", F.explode("relevant_docs").alias("doc_id"))
    return named.join(corpus.select("doc_id", "chunk_id"), "doc_id").select("qid", "chunk_id", F.lit(1).alias("relevance")).distinct()


def qrel_counts(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """What qrels gives, counted: qid, n (chunks), first, last (the smallest and the largest) of each query that has any, without
    a row for each pair. Chunks are counted by the set of documents that they are in, which is mostly one, and queries
    with the same set of documents are looked up once."""
    within = corpus.where("doc_id is not null").groupBy("chunk_id").agg(F.array_sort(F.collect_set("doc_id")).alias("within"))
    sizes = within.groupBy("within").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last"))
    asked = queries.select("qid", F.explode("relevant_docs").alias("doc_id")).groupBy("qid").agg(F.array_sort(F.collect_set("doc_id")).alias("asked"))
    each = sizes.select("within", F.explode("within").alias("doc_id"))
    met = asked.select("asked").distinct().select("asked", F.explode("asked").alias("doc_id")).join(each, "doc_id").select("asked", "within").distinct()
    found = met.join(sizes, "within").groupBy("asked").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return asked.join(found, "asked").select("qid", "n", "first", "last")


def _judged(queries: DataFrame, chunks: Column) -> DataFrame:
    """qid, chunk_id, relevance: each chunk of an array once."""
    return queries.select("qid", F.explode(F.array_distinct(chunks)).alias("chunk_id"), F.lit(1).alias("relevance"))


def test_pairs(queue: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """queue: id, query, chunk_id and, if there, style and source; labels: id, verdict, also_relevant. Queries (qid, query,
    slice, source) and qrels of the pairs held correct."""
    good = queue.join(labels.where("verdict = 'correct'").select("id", "also_relevant"), "id").withColumn("qid", F.concat(F.lit("gen/"), F.col("id").cast("string")))
    named = [F.col(c).alias(n) if c in queue.columns else F.lit(None).cast("string").alias(n) for c, n in (("style", "slice"), ("source", "source"))]
    return good.select("qid", "query", *named), _judged(good, F.concat(F.array("chunk_id"), F.coalesce("also_relevant", F.array().cast("array<string>"))))


def outcomes(queue: DataFrame, labels: DataFrame) -> DataFrame:
    """verdict, n of a queue's items; those without a label are unlabeled."""
    joined = queue.select("id").join(labels.select("id", "verdict"), "id", "left")
    return joined.groupBy(F.coalesce("verdict", F.lit("unlabeled")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def incidents(rows: DataFrame, corpus: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """rows: qid, query, relevant_docs, runbook_split. Queries and qrels for val (runbooks of val) or test (all others); the
    slice tells whether the runbook was held out of training."""
    here = rows.where((F.col("runbook_split") == "val") == F.lit(split == "val"))
    slice_ = F.when(F.col("runbook_split").isin("test", "val"), "real_incident_heldout").otherwise("real_incident_seen")
    return here.select("qid", "query", slice_.alias("slice"), F.lit("runbook").alias("source")), qrels(here, corpus)


def questions(queue: DataFrame, labels: DataFrame, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """queue: id, dataset_row, query, author; labels: id, relevant. Queries and qrels of the labelled questions that some chunk
    answers, and the others, out of scope, with half (val for the first half by hash, test for the rest)."""
    known = queue.join(labels.select("id", "relevant"), "id").withColumn("qid", F.concat(F.lit("so/"), F.col("dataset_row").cast("string")))
    has = F.size(F.coalesce("relevant", F.array().cast("array<string>"))) > 0
    shown = lambda df, name: df.select("qid", "query", F.lit(name).alias("slice"), F.lit("stackoverflow").alias("source"), "author")
    met = known.where(has)
    return shown(met, "stackoverflow"), _judged(met, F.col("relevant")), halves(shown(known.where(~has), "out_of_scope"), "qid", seed)


def val_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs: pos (from 0), query, style, source, chunk_id. Queries val/00000 and so on, and qrels."""
    named = pairs.withColumn("qid", F.format_string("val/%05d", F.col("pos").cast("long")))
    return named.select("qid", "query", F.col("style").alias("slice"), "source"), _judged(named, F.array("chunk_id"))


def handwritten(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: pos (from 0), query, relevant (chunk_ids). Queries hand/000 and so on, and qrels, each chunk once a query."""
    named = rows.withColumn("qid", F.format_string("hand/%03d", F.col("pos").cast("long")))
    return named.select("qid", "query", F.lit("handwritten").alias("slice"), F.lit("human").alias("source")), _judged(named, F.col("relevant"))


def slice_counts(queries: DataFrame) -> DataFrame:
    """slice, n: what a manifest says of a set besides its rows."""
    return queries.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


def problems(queries: DataFrame, rel: DataFrame, corpus: DataFrame) -> DataFrame:
    """problem, id: repeated qids, queries without relevance, chunks that the corpus lacks. None: the set is sound."""
    twice = queries.groupBy("qid").count().where("count > 1").select(F.lit("repeated query").alias("problem"), F.col("qid").cast("string").alias("id"))
    bare = queries.join(rel, "qid", "left_anti").select(F.lit("no relevance").alias("problem"), F.col("qid").cast("string").alias("id"))
    strange = rel.join(corpus, "chunk_id", "left_anti").select(F.lit("unknown chunk").alias("problem"), F.col("chunk_id").cast("string").alias("id")).distinct()
    return twice.unionByName(bare).unionByName(strange)


def manifest(files: DataFrame, rows: DataFrame) -> DataFrame:
    """files: name, content (binary); rows: name, rows. name, sha256, rows: what a frozen set is checked against."""
    return files.select("name", F.sha2("content", 256).alias("sha256")).join(rows, "name", "left")


def changed(files: DataFrame, frozen: DataFrame) -> DataFrame:
    """Names whose content isn't the frozen one's, or is gone."""
    now = files.select("name", F.sha2("content", 256).alias("now"))
    return frozen.join(now, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("name")
