"""A stored BM25 index: written once, then read for any number of query sets without the documents."""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.retrieval import BLOCK_QUERIES, arrow_type, best_of_batch, split_tokens, top_k
from sextant.session import bounded_batches, checkpointed, shared_folder

#: Documents and tokens of a shard, at most (or one document): what one task scores at a time.
SHARD_DOCS, SHARD_TOKENS = 4096, 1 << 21
#: Tokens that are made lists of at once, at most (or those of one bucket): a part of a shard.
LIST_TOKENS = 1 << 18
#: Different terms of the queries that one reading of the postings serves.
ASKED_TERMS = 1 << 20
#: Documents of a partition: an ordinal is the partition's number times this and the place in it.
SPAN = 1 << 33
_MADE = "shard long, n int, ids array<{id}>, lengths array<int>, bucket int, terms array<string>, counts array<int>, places array<int>, tfs array<int>"
_NAMES = ["shard", "n", "ids", "lengths", "bucket", "terms", "counts", "places", "tfs"]


def _bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


@dataclass
class Statistics:
    """Of a collection: documents, tokens a document, different terms, the sum of their raw idf; and parts of the postings."""

    documents: int
    average: float
    terms: int
    raw: float
    buckets: int


@dataclass
class Index:
    """What is stored in a folder: `shards` (shard: its smallest ordinal, n, lengths), `documents` (ord, doc_id), `postings` by
    shard and bucket of terms (shard, bucket, terms; for each term the count of its documents; places and tfs of all
    terms, one after the other), `terms` (term, df) and statistics. Ordinals and shards follow the order of doc_ids."""

    path: str
    statistics: Statistics

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        return Index(path, Statistics(**json.loads(spark.read.text(f"{path}/statistics").first()[0])))

    @staticmethod
    def write(docs: DataFrame, path: str, shard_docs: int = SHARD_DOCS, buckets: int | None = None) -> Index:
        """docs: doc_id (of any kind that has an order), text; other columns are ignored. Rows are documents, also such that
        share a doc_id; a null text has no tokens. What is at path is replaced; statistics come last, so a half
        written index can't be opened.

        Documents are dealt by ranges of doc_id and split into tokens once; a shard leaves its documents and a row for each
        bucket, the hash of a term (as many as Spark's shuffle partitions, if not said), with the lists of its terms
        there, made of a part of the buckets at a time. These are written where they are made: postings aren't shuffled,
        and are a row for many terms.
        """
        spark, id_ = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = buckets or parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ord_ = TaskContext.get().partitionId() * SPAN
            ids, lengths, found = [], [], array("i")
            words: defaultdict[str, int] = defaultdict()
            words.default_factory = words.__len__
            ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())

            def shard() -> Iterator[pa.RecordBatch]:
                n, m = len(ids), len(words)
                none = [pa.nulls(1, kind_) for kind_ in (pa.int32(), strings, ints, ints, ints)]
                yield pa.RecordBatch.from_arrays([pa.array([ord_]), pa.array([n], pa.int32()), pa.array([ids], pa.list_(kind)), pa.array([lengths], ints), *none], _NAMES)
                if not m:
                    return
                of = np.fromiter((_bucket(t, buckets) for t in words), np.int32, m)
                order = np.argsort(of, kind="stable")
                terms = pa.array([*words], pa.string()).take(pa.array(order))
                rank = np.empty(m, np.int32)
                rank[order] = np.arange(m)
                # each token's term, by bucket, and document
                at = np.frombuffer(found, np.int32)
                at[:] = rank[at]
                doc = np.repeat(np.arange(n, dtype=np.min_scalar_type(n)), lengths)
                here, first = np.unique(of[order], return_index=True)
                ends = np.append(first, m)
                before, lo = np.append(0, np.cumsum(np.bincount(at, minlength=m)))[ends], 0
                while lo < len(here):
                    hi = max(lo + 1, int(np.searchsorted(before, before[lo] + LIST_TOKENS, "right")) - 1)
                    some, (a, z) = ends[lo : hi + 1] - ends[lo], ends[[lo, hi]]
                    # a number for each term and document, in order: the lists one after the other
                    own = np.flatnonzero((at >= a) & (at < z))
                    keys = np.subtract(at[own], a, dtype=np.int64) * n + doc[own]
                    keys.sort()
                    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                    tfs = np.diff(np.append(starts, len(keys))).astype(np.int32)
                    keys = keys[starts]
                    counts = np.bincount(keys // n, minlength=z - a).astype(np.int32)
                    by_term, by_place = pa.array(some, pa.int32()), pa.array(np.append(0, np.cumsum(counts))[some], pa.int32())
                    columns = [pa.ListArray.from_arrays(by_term, terms.slice(a, z - a)), pa.ListArray.from_arrays(by_term, pa.array(counts))]
                    columns += [pa.ListArray.from_arrays(by_place, pa.array(x)) for x in ((keys % n).astype(np.int32), tfs)]
                    b = hi - lo
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b, ord_)), pa.nulls(b, pa.int32()), pa.nulls(b, pa.list_(kind)), pa.nulls(b, ints), pa.array(here[lo:hi]), *columns], _NAMES)
                    lo = hi

            tokens = 0
            for b in batches:
                kind = b.schema.field("doc_id").type
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                    own = split_tokens(text.as_py() or "")
                    if ids and (len(ids) == shard_docs or tokens + len(own) > SHARD_TOKENS):
                        yield from shard()
                        ord_ += len(ids)
                        ids, lengths, found, tokens = [], [], array("i"), 0
                        words.clear()
                    found.extend(map(words.__getitem__, own))
                    ids.append(doc_id)
                    lengths.append(len(own))
                    tokens += len(own)
            if ids:
                yield from shard()

        bounded_batches(spark)
        rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
        rows.mapInArrow(run, _MADE.format(id=id_)).write.mode("overwrite").parquet(f"{path}/postings")
        made = spark.read.schema(_MADE.format(id=id_)).parquet(f"{path}/postings")
        heads, lists = made.where("bucket is null"), made.where("bucket is not null")
        heads.select("shard", "n", "lengths").write.mode("overwrite").parquet(f"{path}/shards")
        heads.select("shard", F.posexplode("ids").alias("at", "doc_id")).select((F.col("shard") + F.col("at")).alias("ord"), "doc_id").write.mode("overwrite").parquet(f"{path}/documents")
        each = lists.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
        each.groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
        size = heads.agg(F.sum("n").alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("tokens")).first()
        n = size["n"] or 0
        df = spark.read.schema("term string, df long").parquet(f"{path}/terms")
        raw = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")).first()
        found = Statistics(n, (size["tokens"] / n if n else 0) or 1.0, raw["n"], raw["raw"] or 0.0, buckets)
        spark.createDataFrame([(json.dumps(asdict(found)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/statistics")
        return Index(path, found)

    def top_k(self, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, digits: int = 4, block: int = BLOCK_QUERIES, single: bool = False, dense: int = 0) -> DataFrame:
        """queries: qid, query, a stated set. qid, doc_id, score, rank: the k best documents of every query by BM25, those that
        score 0 included, ties to the smaller doc_id; see retrieval.bm25_top_k for the score.

        Only lists of terms that are asked for leave the tasks that read their buckets; they are dealt by shard. A task keeps
        each query's k best so far, and leaves out a shard for a query that its best possible score, from each term's
        best document there, can't bring among them. Documents without any of a query's terms score 0: of these only the
        first shards can count, as many as hold k documents (`dense`, more if that turns out not to be enough).
        """
        spark = queries.sparkSession
        kind, out = queries.schema["qid"].dataType.simpleString(), None
        shards = [(r["shard"], r["n"]) for r in spark.read.parquet(f"{self.path}/shards").orderBy("shard").limit(max(1, dense) + k).collect()] if self.statistics.documents else []
        first: dict[int, int] = {}
        for s, n in shards:
            if len(first) >= dense and sum(first.values()) >= k:
                break
            first[s] = n
        for held in _asked(queries.select("qid", "query"), block):
            if not first:
                break
            asked = sorted({t for _, ts in held for t in ts})
            terms = spark.createDataFrame(pa.table({"term": pa.array(asked, pa.string())}))
            df = {r["term"]: r["df"] for r in spark.read.parquet(f"{self.path}/terms").join(F.broadcast(terms), "term", "left_semi").collect()}
            lists, lengths = self._lists(spark, sorted(df)), spark.read.parquet(f"{self.path}/shards").select("shard", "lengths")
            scored = _scored(lists, lengths, first, held, self._idf(df, epsilon), k, (k1, b, self.statistics.average), digits, single, kind, block)
            out = scored if out is None else out.unionByName(scored)
        if out is None:
            return spark.createDataFrame([], f"qid {kind}, doc_id {spark.read.parquet(f'{self.path}/documents').schema['doc_id'].dataType.simpleString()}, score double, rank int")
        best = checkpointed(top_k(out.select("qid", F.col("ord").alias("doc_id"), "score"), k))
        last = F.lit(max(first) + first[max(first)])
        if len(first) == len(shards):
            lacking = 0  # there are no other shards
        else:
            of = best.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.count_if((F.col("score") <= 0) & (F.col("doc_id") >= last)).alias("later"))
            lacking = of.where((F.col("n") < k) | (F.col("least") < 0) | ((F.col("least") == 0) & (F.col("later") > 0))).count()
        if lacking:
            return self.top_k(queries, k, k1, b, epsilon, digits, block, single, 8 * len(first))
        return _named(best, spark.read.parquet(f"{self.path}/documents"))

    def _lists(self, spark: SparkSession, asked: list[str]) -> DataFrame:
        """shard, term, places, tfs: a row for each shard that has one of the terms."""
        by: dict[int, list[str]] = {}
        for t in asked:
            by.setdefault(_bucket(t, self.statistics.buckets), []).append(t)
        given = spark.sparkContext.broadcast(by)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by = {b: pa.array(ts, pa.string()) for b, ts in given.value.items()}
            for batch in batches:
                columns = [batch.column(c) for c in ("shard", "bucket", "terms", "counts", "places", "tfs")]
                for r in range(batch.num_rows):
                    shard, bucket, terms, counts, places, tfs = (c[r] for c in columns)
                    asked = by.get(bucket.as_py())
                    found = pc.indices_nonzero(pc.is_in(terms.values, value_set=asked)) if asked is not None else ()
                    if len(found):
                        ends = pa.array(np.append(0, np.cumsum(counts.values.to_numpy())), pa.int32())
                        lists = [pa.ListArray.from_arrays(ends, x.values).take(found) for x in (places, tfs)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), shard.as_py())), terms.values.take(found), *lists], ["shard", "term", "places", "tfs"])

        bounded_batches(spark)
        rows = spark.read.parquet(f"{self.path}/postings").select("shard", "bucket", "terms", "counts", "places", "tfs")
        return rows.where(F.col("bucket").isin(sorted(by)) if by else F.lit(False)).mapInArrow(run, "shard long, term string, places array<int>, tfs array<int>")

    def _idf(self, df: dict[str, int], epsilon: float) -> dict[str, float]:
        s = self.statistics
        low = epsilon * s.raw / max(1, s.terms)
        raw = {t: float(np.log(s.documents - n + 0.5) - np.log(n + 0.5)) for t, n in df.items()}
        return {t: x if x >= 0 else low for t, x in raw.items()}


def _asked(queries: DataFrame, block: int) -> Iterator[list[tuple[object, list[str]]]]:
    """Queries with their tokens, in lists of 16 blocks at most whose different terms are few enough for one reading."""
    held, terms = [], set[str]()
    for r in queries.toLocalIterator():
        own = split_tokens(r["query"] or "")
        if held and (len(terms | {*own}) > ASKED_TERMS or len(held) == 16 * block):
            yield held
            held, terms = [], set()
        held.append((r["qid"], own))
        terms |= {*own}
    if held:
        yield held


def _scored(lists: DataFrame, lengths: DataFrame, first: dict[int, int], held: list, idf: dict[str, float], k: int, shape: tuple[float, float, float], digits: int, single: bool, kind: str, block: int) -> DataFrame:
    """qid, ord, score: of each task every query's k best."""
    spark = lists.sparkSession
    (k1, b, average), of = shape, arrow_type(kind)
    by: dict[str, list[tuple[int, float]]] = {}
    for q, (_, ts) in enumerate(held):
        for t, n in Counter(ts).items():
            if t in idf:
                by.setdefault(t, []).append((q, n * idf[t] * (k1 + 1)))
    given = spark.sparkContext.broadcast(([q for q, _ in held], by, first))

    def weight(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf / (tf + k1 * (1 - b + b * length / average))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, by, first = given.value
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(names)
        floor = np.full(len(names), -np.inf)

        def score(shard: int, sizes: np.ndarray, found: list[tuple[str, np.ndarray, np.ndarray]]) -> None:
            # what each query can score here at most; places that aren't listed score 0
            most = np.zeros(len(names))
            rows = [(term, places, weight(tfs, sizes[places])) for term, places, tfs in found]
            asked: list[list[tuple[tuple, float]]] = [[] for _ in names]
            for r in rows:
                bound = float(r[2].max())
                for q, w in by.get(r[0], ()):
                    most[q] += max(0.0, w * bound)
                    asked[q].append((r, w))
            n = first.get(shard, 0)
            size = max([n, *(int(r[1].max()) + 1 for r in rows)])
            # rounded scores are compared: half a unit of the last place may be gained
            for q in np.flatnonzero(most + 10.0**-digits >= floor):
                if not asked[q] and not n:
                    continue
                sums = np.zeros(size)
                listed = np.zeros(size, bool)
                listed[:n] = True
                for (_, places, weights), w in asked[q]:
                    sums[places] += w * weights
                    listed[places] = True
                at = np.flatnonzero(listed)
                s = np.round(sums[at].astype(np.float32).astype(np.float64) if single else sums[at], digits) + 0.0
                ords, s = np.concatenate([best[q][0], at + shard]), np.concatenate([best[q][1], s])
                _, top, s = best_of_batch(s[None, :], ords, k)
                best[q] = top, s
                if len(s) == k:
                    floor[q] = s[-1]

        shard, of_shard, rows = None, None, []
        for b_ in batches:
            columns = [b_.column(c) for c in ("shard", "term", "places", "tfs", "lengths")]
            for r in range(b_.num_rows):
                s, term, places, tfs, lengths = (c[r] for c in columns)
                if shard is not None and s.as_py() != shard:
                    score(shard, of_shard, rows)
                    rows = []
                shard = s.as_py()
                if term.is_valid:
                    rows.append((term.as_py(), places.values.to_numpy(), tfs.values.to_numpy()))
                else:
                    of_shard = lengths.values.to_numpy()
        if shard is not None:
            score(shard, of_shard, rows)
        sizes = [len(s) for _, s in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, n in zip(names, sizes, strict=True) for _ in range(n)], of), pa.array(np.concatenate([o for o, _ in best])), pa.array(np.concatenate([s for _, s in best]))], ["qid", "ord", "score"])

    both = lists.unionByName(lengths, allowMissingColumns=True)
    return both.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, f"qid {kind}, ord long, score double")


def _named(best: DataFrame, documents: DataFrame) -> DataFrame:
    """Ordinals back to doc_ids. Only k rows for each of a stated set of queries are looked up; sent out if they are few."""
    top = best.withColumnRenamed("doc_id", "ord")
    few = top.count() <= 1 << 20
    return documents.join(F.broadcast(top) if few else top, "ord").select("qid", "doc_id", "score", "rank")


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, digits: int = 4, block: int = BLOCK_QUERIES, single: bool = False) -> DataFrame:
    """docs: doc_id (of any kind that has an order), text; queries: qid, query. The k best documents of every query by BM25,
    those that score 0 included: an index is written for this one set; keep an Index for more.

    Okapi: idf = ln(N - df + 0.5) - ln(df + 0.5), negative ones replaced by epsilon times the mean idf of all terms;
    query tokens count as often as they occur; parts of identifiers count in lengths and frequencies. Scores are
    rounded, so that their order doesn't hang on the order of a sum; single: to single precision before that.
    """
    return Index.write(docs, f"{shared_folder(docs.sparkSession)}/bm25-{uuid.uuid4().hex}").top_k(queries, k, k1, b, epsilon, digits, block, single)


_STORED: dict[tuple[str, str, str], Index] = {}


def stored(docs: DataFrame, name: str) -> Index:
    """The index of docs, columns doc_id and text of a table in files: written at the first call of an application, and
    anew once the files have changed. name tells indexes of different columns of the same files apart."""
    spark = docs.sparkSession
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = str(files.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first())
    key = (spark.sparkContext.applicationId, name, state)
    if key not in _STORED:
        _STORED[key] = Index.write(docs.select("doc_id", "text"), f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}")
    return _STORED[key]
