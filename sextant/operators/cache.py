"""A keyed store of what is dear to make, such as vectors or generated texts: made once, kept by a hash of what made it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.session import checkpointed
from sextant.sources.readers import exists


def key_of(maker: str, *made_of: Column) -> Column:
    """The key of what `maker` (a model's name or fingerprint) makes of some texts."""
    return F.sha2(F.concat(F.lit(maker + "\n"), F.concat_ws("\n", *[c.cast("string") for c in made_of])), 256)


def load(spark: SparkSession, path: str, schema: str, keys: DataFrame) -> DataFrame:
    """The entries (key and the columns of `schema`) that the store has of keys (key). Only parts that hold one are read; an
    entry that was written twice comes once."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"key string, {schema}")
    wanted = keys.select("key", _part(F.col("key")).alias("part")).distinct()
    rows = spark.read.schema(f"key string, {schema}, part string").parquet(path).join(wanted, ["part", "key"], "left_semi")
    return rows.dropDuplicates(["key"]).drop("part")


def save(rows: DataFrame, path: str) -> None:
    """Adds entries (key, values). Keys are hashes of what made the values, so an entry never changes: files are only ever
    added, by the first two digits of the key, and one that is there already does no harm."""
    rows.withColumn("part", _part(F.col("key"))).repartition("part").write.mode("append").partitionBy("part").parquet(path)


def cached(rows: DataFrame, path: str, maker: str, made_of: str, schema: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns of `schema`, from the store at path or else made: make is given key and made_of of what the
    store lacks, each once, and returns key and the columns. What is made is stored before it is used, so a run that
    fails later, or is run again, makes nothing twice. Rows with a null made_of have nulls.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("key", F.when(F.col(made_of).isNotNull(), key_of(maker, F.col(made_of))))
    asked = keyed.where("key is not null").groupBy("key").agg(F.first(made_of).alias(made_of))
    # what is there is decided once, before anything is added
    lacking = checkpointed(asked.join(load(spark, path, schema, asked).select("key"), "key", "left_anti"))
    if not lacking.isEmpty():
        save(make(lacking), path)
    return keyed.join(load(spark, path, schema, asked), "key", "left").drop("key")


def _part(key: Column) -> Column:
    return F.substring(key, 1, 2)
