"""Splits, samples and batches. All chance is the order of md5(seed:id), the same at every size and on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.session import checkpointed


def shuffled(seed: str, *ids: Column) -> list[Column]:
    """Columns to order by: the salted hash, then the ids."""
    return [F.md5(F.concat_ws(":", F.lit(seed), *[i.cast("string") for i in ids])), *ids]


def numbered_within(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Adds pos, from 1 in each group in the order, and n, the group's size. No task sorts more than a share of the rows,
    even if one group holds them all: rows are dealt by ranges of group and order, and the rows of a group in earlier
    ranges are added. The ranges are drawn from samples, so they are pinned down by a checkpoint."""
    keys = [f"_o{k}" for k in range(len(order))]
    dealt = rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*group, *keys)
    dealt = checkpointed(dealt.withColumn("_part", F.spark_partition_id()))
    named = {f"_g{k}": F.col(g) for k, g in enumerate(group)}
    sizes = dealt.groupBy(F.col("_part").alias("_p"), *[c.alias(k) for k, c in named.items()]).agg(F.count(F.lit(1)).alias("_m"))
    inside = Window.partitionBy(*(named or [F.lit(0)]))
    before = F.sum("_m").over(inside.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("*", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_m").over(inside).alias("n"))
    same = F.col("_part") == F.col("_p")
    for k, c in named.items():
        same = same & c.eqNullSafe(F.col(k))
    k = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*keys))
    out = dealt.withColumn("_k", k).join(sizes, same)
    return out.withColumn("pos", (F.col("_k") + F.col("_before")).cast("long")).drop("_k", "_before", "_m", "_p", "_part", *keys, *named)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds pos, from 1 in the order, and n, all rows."""
    return numbered_within(rows, [], order)


def stratified_split(docs: DataFrame, id_: str, stratum: str, seed: str, share: float = 0.1, least: int = 3, strict: bool = False) -> DataFrame:
    """Adds split: in each stratum max(least, share, rounded half to even) documents are test, as many val, the rest
    train. Sizes are exact; membership follows the hash. A stratum needs 2 * least + 1 documents; strict: else it is an
    error that names some."""
    if strict and (few := too_small(docs, stratum, least).limit(5).collect()):
        raise ValueError(f"strata with too few documents: {sorted(str(r[stratum]) for r in few)}")
    out = numbered_within(docs, [stratum], shuffled(seed, F.col(id_)))
    n = F.greatest(F.lit(least), F.bround(F.col("n") * share))
    return out.withColumn("split", F.when(F.col("pos") <= n, "test").when(F.col("pos") <= 2 * n, "val").otherwise("train")).drop("pos", "n")


def too_small(docs: DataFrame, stratum: str, least: int = 3) -> DataFrame:
    """Strata that can't be split: the caller raises if there are any."""
    return docs.groupBy(stratum).count().where(F.col("count") < 2 * least + 1)


def one_each(rows: DataFrame, group: str, id_: str, seed: str) -> DataFrame:
    """One row of each group, by hash: a minimum, so partial results suffice."""
    best = F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*shuffled(seed, F.col(id_))))
    return rows.groupBy(group).agg(best.alias("_row")).select("_row.*")


def round_robin(rows: DataFrame, style: str, id_: str, seed: str, n: int, first: Column | None = None) -> DataFrame:
    """All rows where `first` holds, then rounds over the styles until n rows: adds round (0 for the first ones)."""
    first = F.lit(False) if first is None else first
    ahead = rows.where(first).withColumn("round", F.lit(0))
    left = max(0, n - ahead.count())
    # of a style no more than `left` rows can count, so the window keeps as many a task, before and after the shuffle
    k = F.row_number().over(Window.partitionBy(style).orderBy(*shuffled(seed, F.col(id_))))
    rest = rows.where(~first).withColumn("round", k).where(F.col("round") <= left)
    return ahead.unionByName(rest.orderBy("round", style).limit(left))


def halves(rows: DataFrame, id_: str, seed: str) -> DataFrame:
    """Adds half: val for the first half by hash, rounded down, test for the rest."""
    return ranked(rows, shuffled(seed, F.col(id_))).withColumn("half", F.when(F.col("pos") <= F.floor(F.col("n") / 2), "val").otherwise("test")).drop("pos", "n")


def hash_sample(rows: DataFrame, id_: str, seed: str, n: int) -> DataFrame:
    """Exactly n rows (all, if fewer), by hash: each task keeps n at most."""
    return rows.orderBy(*shuffled(seed, F.col(id_))).limit(n)


def sample_each(rows: DataFrame, group: str, id_: str, seed: str, n: int) -> DataFrame:
    """Up to n rows of each group, by hash: of a group a task keeps n at most, before the shuffle and after."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(*shuffled(seed, F.col(id_))))
    return rows.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")


def seeded_share(rows: DataFrame, id_: str, seed: str, share: float) -> DataFrame:
    """That share of the rows by hash, rounded half to even, one at least. No rows are an error: nothing could be trained on."""
    if rows.isEmpty():
        raise ValueError("no rows to take a share of")
    found = ranked(rows, shuffled(seed, F.col(id_)))
    return found.where(F.col("pos") <= F.greatest(F.lit(1), F.bround(F.col("n") * share))).drop("pos", "n")


def batches(rows: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """Adds batch: consecutive rows of a group, `size` each, numbered from 0."""
    out = numbered_within(rows, [group], order)
    return out.withColumn("batch", F.floor((F.col("pos") - 1) / size)).drop("pos", "n")
