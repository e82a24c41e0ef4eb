"""What the operators of this subpackage share: batch bounds, checkpoints and safe column names."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch sent to a Python worker. Texts may be very long, so the byte bound matters more.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the size of Arrow batches so that a Python worker holds few long texts at once; never raises it."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df with a reliable checkpoint in the folder named by spark.checkpoint.dir.

    Where no folder is named a temporary one is set if all runs on one machine, as in tests; it goes when the driver
    ends. On a cluster that is an error: executors don't share the driver's folders.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not named:
            if sc.master.partition("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="sextant-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Has the driver forget plans that nothing refers to any more, so that Spark deletes their shuffle files. Between the
    rounds of an iteration; else files of all rounds stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def texts(column: pa.Array) -> Iterator[str]:
    """The strings of a column one at a time, null as the empty string."""
    for x in column:
        yield x.as_py() or ""


def ascii_lower(c):  # noqa: ANN001, ANN201
    """A-Z in lower case, nothing else; lower() is much faster and does the same where all characters are ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def fields(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name do no harm. Column names match as Spark resolves them."""
    return df.select(*[df[f"`{n}`"] for n in names])


def wrapped(docs: DataFrame, made: Iterable[str], **columns: str) -> DataFrame:
    """`row`, a struct of all columns of docs but those named in `made` (in any case), and the named columns of docs cast
    to the given kinds: inside of `row` no name can clash with one that an operator makes."""
    kept = [docs[f"`{c}`"] for c in _kept(docs, made)]
    return docs.select(F.struct(*kept).alias("row"), *[docs[c].cast(kind).alias(c) for c, kind in columns.items()])


def unwrapped(rows: DataFrame, docs: DataFrame, made: Iterable[str]) -> DataFrame:
    """The columns of docs that `wrapped` put into `row`, and those made."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in _kept(docs, made)], *made)


def _kept(docs: DataFrame, made: Iterable[str]) -> list[str]:
    gone = {c.lower() for c in made}
    return [c for c in docs.columns if c.lower() not in gone]


def small(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """df, to be broadcast if its values written out take `most` bytes at most; else as it is, for Spark to decide how it is
    joined. Reads df once, so give it a checkpoint."""
    size = df.select(F.sum(sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("long") for c in df.columns), F.lit(16)))).first()[0]
    return F.broadcast(df) if (size or 0) <= most else df
