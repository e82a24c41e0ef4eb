"""Hit rate, reciprocal rank and NDCG of rankings, by query and by slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS, DEPTH = (1, 5, 10), 10
METRICS = [*[f"hit_{k}" for k in CUTS], "mrr_10", "ndcg_10"]


def query_metrics(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """rankings: qid, doc_id, rank; qrels: qid, doc_id. One row for each query that has qrels; without hits all are 0.

    The ideal DCG is of the query's relevant documents, ten at most.
    """
    relevant = qrels.select("qid", "doc_id").distinct()
    hits = relevant.join(rankings.where(F.col("rank") <= DEPTH).select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    return _of_ranks(hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"), *_ranks()))


def _ranks() -> list[Column]:
    """Aggregates over rows with a rank, null for none."""
    return [
        *[F.max(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).cast("double").alias(f"hit_{k}") for k in CUTS],
        F.coalesce(F.max(1 / F.col("rank")), F.lit(0.0)).alias("mrr_10"),
        F.coalesce(F.sum(1 / F.log2(F.col("rank") + 1.0)), F.lit(0.0)).alias("dcg"),
    ]


def _of_ranks(found: DataFrame) -> DataFrame:
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(DEPTH)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    return found.select("qid", "n_rel", *[f"hit_{k}" for k in CUTS], "mrr_10", (F.col("dcg") / ideal).alias("ndcg_10"))


def group_metrics(rankings: DataFrame, asked: DataFrame, members: DataFrame) -> DataFrame:
    """query_metrics, where relevant are all documents of a query's own groups but the one that is the query, without a row
    for each of them. asked: qid, group, each of them a document too; members: doc_id, group. rankings leave out the
    query's own document."""
    from sextant.operators.freeze import qrel_counts

    of = asked.groupBy("qid").agg(F.collect_set("group").alias("relevant_docs"))
    sizes = qrel_counts(of, members.select(F.col("group").alias("doc_id"), F.col("doc_id").alias("chunk_id")))
    sizes = sizes.where("n > 1").select(F.col("qid").alias("_qid"), (F.col("n") - 1).alias("_n"))
    top = rankings.where(F.col("rank") <= DEPTH).select("qid", "doc_id", "rank")
    hits = top.join(members, "doc_id").join(asked, ["qid", "group"]).select("qid", "doc_id", "rank").distinct()
    # a document that is ranked more than once counts as often, as in query_metrics
    found = hits.groupBy("qid").agg((F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("_again"), *_ranks())
    found = sizes.join(found, F.col("_qid") == F.col("qid"), "left").drop("qid").withColumn("n_rel", F.col("_n") + F.coalesce("_again", F.lit(0)))
    return _of_ranks(found.withColumnRenamed("_qid", "qid").fillna(0.0, [*[f"hit_{k}" for k in CUTS], "mrr_10", "dcg"]))


def slices_of(own: Column, generated: Column, overlap: Column, low: float = 0.5) -> Column:
    """all, a query's own slice, and low_overlap for generated queries that share few words with their passage."""
    return F.array_compact(F.array(F.lit("all"), own, F.when(generated & (overlap <= low), F.lit("low_overlap"))))


def by_slice(metrics: DataFrame, slices: DataFrame, digits: int = 6) -> DataFrame:
    """slices: qid, slices (array). The mean of each metric and the number of queries in each slice."""
    each = metrics.join(slices, "qid").select("*", F.explode("slices").alias("slice"))
    return each.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), digits).alias(m) for m in METRICS])


def evaluate(rankings: DataFrame, qrels: DataFrame, slices: DataFrame) -> DataFrame:
    return by_slice(query_metrics(rankings, qrels), slices)


def first_relevant(rankings: DataFrame, qrels: DataFrame, depth: int = 100) -> DataFrame:
    """qid, rank of the first relevant document, depth + 1 where there is none within depth."""
    hits = qrels.select("qid", "doc_id").distinct().join(rankings.where(F.col("rank") <= depth).select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    return hits.groupBy("qid").agg(F.coalesce(F.min("rank"), F.lit(depth + 1)).alias("rank"))


def worst(rankings: DataFrame, qrels: DataFrame, n: int, depth: int = 100) -> DataFrame:
    """The n queries whose first relevant document comes last, with the three documents ranked first."""
    top = rankings.where("rank <= 3").groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("top3"))
    return first_relevant(rankings, qrels, depth).join(top, "qid", "left").orderBy(F.desc("rank"), "qid").limit(n)


def renamed(metrics: Column, suffixes: dict[str, str], prefix: str = "") -> Column:
    """A map of metrics with only the keys that end in one of the suffixes, under the prefix and the suffix's own name."""
    kept = F.map_filter(metrics, lambda k, v: F.array_contains(F.transform(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.endswith(k, s)), True))
    name = F.lit(None).cast("string")
    names = list(suffixes.items())

    def put(k: Column, v: Column) -> Column:
        out = name
        for suffix, new in reversed(names):
            out = F.when(F.endswith(k, F.lit(suffix)), F.lit(prefix + new)).otherwise(out)
        return out

    return F.transform_keys(kept, put)


def ir_data(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a trainer evaluates on: queries (qid, query), passages (chunk_id, passage), and each query's set of chunks.
    Only queries with relevance, and the whole corpus."""
    relevant = qrels.groupBy("qid").agg(F.array_sort(F.collect_set("chunk_id")).alias("relevant"))
    return queries.join(relevant.select("qid"), "qid", "left_semi").select("qid", "query"), corpus.select("chunk_id", "passage"), relevant
