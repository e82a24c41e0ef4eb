"""Ranking: dense vectors, reciprocal rank fusion, rankers by name. Rankings are rows: qid, doc_id, score, rank from 1. Ids
are of any kind that has an order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from sextant.functions.text import COMPOUND

_COMPOUND, _SEPARATOR = re.compile(COMPOUND), re.compile("[._:/-]")


def arrow_type(kind: str) -> pa.DataType:
    """The Arrow type of a column of this kind, as Spark names it: Python's numbers don't tell int from long."""
    return to_arrow_type(StructType.fromDDL(f"x {kind}")["x"].dataType)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller doc_id. The window is cut to k rows before the shuffle and after."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def split_tokens(text: str) -> list[str]:
    """What functions.text.tokens gives, for one text in Python."""
    found, out = _COMPOUND.findall(text.lower()), list[str]()
    if all(map(str.isalnum, found)):
        return found
    for c in found:
        if not c.isalnum():
            out += _SEPARATOR.split(c)
        out.append(c)
    return out


def best_of_batch(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """scores: a row for each query, a column for each document. Query row, document, score of each query's k best, ties
    to the smaller document: what may still be among the k best of all batches."""
    if scores.shape[1] > 4 * k:  # all that score as much as the k-th best, in case of ties
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        row, column = np.nonzero(scores >= least[:, None])
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], ids[column[keep]], scores[row[keep], column[keep]]


def _best_of(parts: list[pa.Table], k: int) -> pa.Table:
    """Of tables of row (a query's), doc_id, score the k best of each query, ties to the smaller doc_id."""
    t = pa.concat_tables(parts).combine_chunks()
    t = t.take(pc.sort_indices(t, [("row", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_start"))
    row = t.column("row").to_numpy()
    return t.filter(pa.array(np.arange(len(row)) - np.searchsorted(row, row) < k)).combine_chunks()


def ranked_batches(docs: DataFrame, blocks: Iterable[tuple[list, object]], score: Callable[[object, pa.RecordBatch], np.ndarray], k: int, qid: str = "long") -> DataFrame:
    """A stated query set against all documents (doc_id and what score needs), block by block: each block is broadcast,
    each batch of documents scored against all of it at once, and only each query's k best of a task are shuffled."""
    spark, out, of = docs.sparkSession, None, arrow_type(qid)
    kind = f"qid {qid}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    for names, block in blocks:
        given = spark.sparkContext.broadcast((names, block))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            names, block = given.value
            held, size = list[pa.Table](), 0
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    # ids of any kind by their places in order
                    order = pc.sort_indices(b.column("doc_id"), null_placement="at_start").to_numpy()
                    place = np.argsort(order)
                    row, at, value = best_of_batch(score(block, b), place, k)
                    held.append(pa.table({"row": pa.array(row, pa.int32()), "doc_id": b.column("doc_id").take(pa.array(order[at])), "score": pa.array(value, pa.float64())}))
                    size += len(row)
                    if size > 2 * k * len(names) + (1 << 16):
                        held = [_best_of(held, k)]
                        size = held[0].num_rows
            for b in _best_of(held, k).to_batches(1 << 14) if held else []:
                yield pa.RecordBatch.from_arrays([pa.array([names[r] for r in b.column("row").to_pylist()], of), b.column("doc_id"), b.column("score")], ["qid", "doc_id", "score"])

        some = docs.mapInArrow(run, kind)
        out = some if out is None else out.unionByName(some)
    return spark.createDataFrame([], kind) if out is None else out


def in_blocks(rows: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of at most size, streamed to the driver partition by partition."""
    held: list = []
    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


#: Queries and different terms of a block that is scored at once.
BLOCK_QUERIES, BLOCK_TERMS = 256, 8192


def dense(queries: DataFrame, docs: DataFrame, k: int = 100, digits: int = 6, block: int = 1024) -> DataFrame:
    """queries: qid, q (vector); docs: doc_id, v (vector). Exact inner products in double precision, the k best each."""
    rows = docs.select("doc_id", F.col("v").cast("array<double>").alias("v"))
    blocks = (([r["qid"] for r in some], np.array([r["q"] for r in some], np.float64)) for some in in_blocks(queries.select("qid", "q"), block))

    def score(q: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
        return np.round(q @ v.T, digits) + 0.0

    return top_k(ranked_batches(rows, blocks, score, k, queries.schema["qid"].dataType.simpleString()), k)


def rrf(rankings: list[DataFrame], k: int = 100, constant: int = 60) -> DataFrame:
    """Rankings fused: each adds 1 / (constant + rank); ties to the smaller doc_id."""
    both = rankings[0].select("qid", "doc_id", "rank")
    for r in rankings[1:]:
        both = both.unionByName(r.select("qid", "doc_id", "rank"))
    fused = both.groupBy("qid", "doc_id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score"))
    return top_k(fused, k)


def rank_of(scores: DataFrame, positives: DataFrame) -> DataFrame:
    """qid, doc_id, rank of each query's positive: 1 and the count of strictly larger scores, so ties favour it. scores: qid,
    doc_id, score. Scores are counted where they are: a row for each query and task is all that is shuffled of them."""
    own = scores.join(positives.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi").groupBy("qid", "doc_id").agg(F.max("score").alias("_own"))
    better = scores.select("qid", "score").join(own, "qid").where(F.col("score") > F.col("_own")).groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return own.join(better, ["qid", "doc_id"], "left").select("qid", "doc_id", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("rank"))


def dense_ranks(queries: DataFrame, docs: DataFrame, positives: DataFrame, digits: int = 6, block: int = 1024) -> DataFrame:
    """qid, doc_id, score, rank of each query's positives (qid, doc_id), as rank_of has it, without a row for each pair: a
    block of queries goes out with the scores of its positives, and a batch of documents leaves a count for each.

    queries: qid, q (vector), a stated set; docs: doc_id, v (vector). A query's own document, where doc_id = qid, is no rival.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("v").cast("array<double>").alias("v"))
    target = positives.join(queries, "qid").join(rows, "doc_id").select("qid", "doc_id", "q", "v")
    kinds = {c: target.schema[c].dataType.simpleString() for c in ("qid", "doc_id")}
    of, kinds = [arrow_type(x) for x in kinds.values()], ", ".join(f"{c} {x}" for c, x in kinds.items())
    out = None
    for some in in_blocks(target, block):
        q, v = (np.array([r[c] for r in some], np.float64).reshape(len(some), -1) for c in ("q", "v"))
        own = np.round(np.einsum("ij,ij->i", q, v), digits) + 0.0
        given = spark.sparkContext.broadcast(([r["qid"] for r in some], [r["doc_id"] for r in some], q, own))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            names, docs_, q, own = given.value
            counts = np.zeros(len(names), np.int64)
            rows_of: dict[object, list[int]] = {}
            for i, x in enumerate(names):
                rows_of.setdefault(x, []).append(i)
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    b = whole.slice(at, 4096)
                    better = np.round(q @ b.column("v").flatten().to_numpy().reshape(b.num_rows, -1).T, digits) + 0.0 > own[:, None]
                    for j, x in enumerate(b.column("doc_id").to_pylist()):
                        better[rows_of.get(x, []), j] = False
                    counts += better.sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(names, of[0]), pa.array(docs_, of[1]), pa.array(own), pa.array(counts)], ["qid", "doc_id", "score", "n"])

        part = rows.mapInArrow(run, f"{kinds}, score double, n long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"{kinds}, score double, rank int")
    return out.groupBy("qid", "doc_id").agg(F.max("score").alias("score"), (F.sum("n") + 1).cast("int").alias("rank"))


#: Other names of rankers.
ALIASES = {"okapi": "bm25", "vectors": "dense"}


def ranker(name: str, known: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame], DataFrame]:
    """A ranker by name: one of `known` (queries to rankings), an alias of one, or hybrid:<name>, its fusion with bm25."""
    if name.startswith("hybrid:"):
        other = ranker(name.removeprefix("hybrid:"), known)
        return lambda queries: rrf([other(queries), known["bm25"](queries)])
    name = ALIASES.get(name, name)
    if name not in known:
        raise ValueError(f"no ranker is named {name}")
    return known[name]
