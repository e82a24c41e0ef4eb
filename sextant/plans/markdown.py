"""Queries that follow documents line by line. SQL can't say them; tests compare them with plain loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.corpus import numbered, without_duplicates
from sextant.operators.markdown import chunked, clean_markdown, randomized
from sextant.plans import Registry, table

R = Registry()


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: a heading for each line of two words or fewer, the rest paragraphs."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(F.size(F.split(x, " ")) <= 2, F.concat(F.lit("## "), x)).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.array_join(lines, "\n\n").alias("text"))


@R.query()
def q_clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _markdown(spark, sf_dir).select("doc_id", clean_markdown(F.concat(F.lit("See [the *guide*](http://x/(y)) &amp; {{< note >}}**this**\n\n"), "text")).alias("text"))
    return rows.select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@R.query()
def q_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = chunked(_markdown(spark, sf_dir), ["what's next"])
    kept = without_duplicates(pieces, "text", ["doc_id", "piece_pos"])
    return numbered(kept, "doc_id", ["piece_pos"]).select("chunk_id", "doc_id", "section", "n_tokens", F.sha2("text", 256).alias("text_sha256"))


@R.query()
def q_randomize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    name = F.concat(F.lit("pod web-app-"), F.substring(F.md5(F.col("user_id").cast("string")), 1, 10), F.lit("-"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 5), F.lit(" failed"))
    return events.select("event_id", randomized(name).alias("text"))
