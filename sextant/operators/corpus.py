"""Building a corpus: exact duplicates, numbering, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.operators.sampling import numbered_within


def without_duplicates(pieces: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of each text. Texts are compared by SHA-256, so long ones are not shuffled as keys, and the first
    row is a minimum, so a text that a third of all rows share is summed up before the shuffle."""
    first = F.min_by(F.struct(*[F.col(c) for c in pieces.columns]), F.struct(*[F.col(c) for c in order]))
    return pieces.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_h")).agg(first.alias("_row")).select("_row.*")


def numbered(pieces: DataFrame, doc: str, order: list[str], small: bool = True) -> DataFrame:
    """Adds chunk_id, doc#000 and so on: dense within each document. small: no document has more pieces than a task can
    sort; else they are dealt by ranges."""
    if small:
        out = pieces.withColumn("pos", F.row_number().over(Window.partitionBy(doc).orderBy(*order)))
    else:
        out = numbered_within(pieces, [doc], [F.col(c) for c in order]).drop("n")
    return out.withColumn("chunk_id", F.format_string("%s#%03d", F.col(doc).cast("string"), F.col("pos") - 1)).drop("pos")


def statistics(chunks: DataFrame, by: str, size: str) -> DataFrame:
    """For each source and for all (null): rows, and size's least, largest, and interpolated median and 90th percentile."""
    return chunks.rollup(by).agg(
        F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("most"),
        F.percentile(size, F.lit(0.5)).cast("int").alias("p50"), F.percentile(size, F.lit(0.9)).cast("int").alias("p90"),
    )


def summary(pieces: DataFrame, doc: str, source: str, text: str, order: list[str]) -> DataFrame:
    """pieces: doc, source, text and what orders them; a document without any is one row with a null text. source (null for
    all), docs, chunks (first rows of their text) of each source; for all also duplicate_chunks and empty_docs, which
    are dropped. One shuffle by the text's hash counts everything; another, of kept rows, puts sources together."""
    first = F.min_by(F.struct(F.col(doc).alias("doc"), F.col(source).alias("source")), F.struct(*[F.col(c) for c in order]))
    texts = pieces.groupBy(F.sha2(text, 256).alias("h")).agg(first.alias("row"), F.count(F.lit(1)).alias("n")).select("h", "n", F.when(F.col("h").isNotNull(), F.col("row.doc")).alias("doc"), F.col("row.source").alias("source"))
    kept = texts.where("h is not null").rollup("source").agg(F.count_distinct("doc").alias("docs"), F.count(F.lit(1)).alias("chunks"), F.grouping("source").alias("all"))
    gone = texts.agg(F.coalesce(F.sum(F.when(F.col("h").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicate_chunks"), F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("n"))), F.lit(0)).alias("empty_docs"))
    shown = [F.when(F.col("all") == 1, F.col(c)).alias(c) for c in ("duplicate_chunks", "empty_docs")]
    return kept.join(F.broadcast(gone), how="cross").select("source", "docs", "chunks", *shown)


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: must be empty for a corpus."""
    return rows.groupBy(key).count().where("count > 1")
