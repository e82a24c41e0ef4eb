"""A label log as a stream: the table of latest labels kept up to date, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.operators.labels import latest
from sextant.sources.readers import exists

#: Parts of the table by the hash of the id: a batch reads and writes those that it has a label of.
BUCKETS = 64


def label_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """New files of a JSONL log as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def keep_latest(log: DataFrame, path: str, checkpoint: str, id_: list[str], order: list[str], buckets: int = BUCKETS) -> StreamingQuery:
    """Folds each batch of the log into the table of latest labels below path.

    The table is cut into buckets by id. A batch reads the newest version of those buckets that it has labels of, from
    before its own, and writes its own version of them; others stay as they are. So a batch costs as much as it
    touches, and one that is run again after a failure gives the same table: a version counts once its whole batch is
    written, and of a bucket the one before the newest is kept until a third is there.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*id_), F.lit(buckets)).cast("int")).persist()
        try:
            touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
            known: dict[int, list[int]] = {}
            for version, bucket in _written(spark, path):
                if bucket in touched and version < number:
                    known.setdefault(bucket, []).append(version)
            before = [f"{path}/version={max(v)}/bucket={b}" for b, v in known.items()]
            both = rows.drop("bucket")
            if before:
                both = both.unionByName(spark.read.schema(batch.schema).parquet(*before))
            kept = latest(both, id_, order).withColumn("bucket", F.pmod(F.xxhash64(*id_), F.lit(buckets)).cast("int"))
            kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
        finally:
            rows.unpersist()
        for bucket, versions in known.items():
            for old in sorted(versions)[:-1]:
                name = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}/bucket={bucket}")
                name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)

    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark: SparkSession, path: str) -> Iterator[tuple[int, int]]:
    """Version and bucket of all that whole batches have written."""
    if not exists(spark, path):
        return
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in files.listStatus(top):
        version = s.getPath().getName()
        if version.startswith("version=") and exists(spark, f"{path}/{version}/_SUCCESS"):
            for b in files.listStatus(s.getPath()):
                if b.getPath().getName().startswith("bucket="):
                    yield int(version.removeprefix("version=")), int(b.getPath().getName().removeprefix("bucket="))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table: the newest version of each bucket."""
    newest: dict[int, int] = {}
    for version, bucket in _written(spark, path):
        newest[bucket] = max(version, newest.get(bucket, -1))
    if not newest:
        raise FileNotFoundError(f"no labels at {path}")
    return spark.read.parquet(*[f"{path}/version={v}/bucket={b}" for b, v in sorted(newest.items())])
