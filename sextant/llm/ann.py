"""Approximate nearest neighbours with learned partitions: a balanced cut of a neighbour graph, and a small classifier
that routes vectors and queries to its parts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm.common import checkpointed, map_batches

#: Links of a vector in the neighbour graph, vectors of a part on average, parts at least (if each has four), vectors of
#: the sample for each part, and vectors that the index is fitted on, at least and at most. The rest is only routed.
NEIGHBOURS, PART, LEAST_PARTS, EACH, LEAST_SAMPLE, SAMPLE = 16, 8192, 32, 32, 8192, 65_536
#: Rows of a block of candidates and of queries; parts of any size are dealt out in such blocks.
CANDIDATES, QUERIES = 8192, 4096


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the k rows with the largest inner product, itself excluded, in no order."""
    out = np.zeros((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + len(s)] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def halve(near: np.ndarray, nodes: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Cuts the graph over nodes into halves: a smooth vector over the links, cut at its median, then swaps that lessen
    the links cut. Sizes differ by one at most."""
    place = np.full(len(near), -1)
    place[nodes] = np.arange(len(nodes))
    to = place[near[nodes]]
    a, b = np.repeat(np.arange(len(nodes)), near.shape[1])[(to >= 0).ravel()], to.ravel()[(to >= 0).ravel()]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(a, minlength=len(nodes)) + 1.0
    v = rng.standard_normal(len(nodes))
    for _ in range(60):
        v = v - (v * degree).sum() / degree.sum()
        v = (v + (np.bincount(a, v[b], len(nodes)) + v) / degree) / 2
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(len(nodes), np.int64)
    side[np.argsort(v, kind="stable")[len(nodes) // 2 :]] = 1
    for _ in range(20):
        same = np.bincount(a, (side[a] == side[b]).astype(float), len(nodes))
        gain = np.bincount(a, minlength=len(nodes)) - 2 * same
        one, two = (np.flatnonzero(side == s) for s in (0, 1))
        one, two = one[np.argsort(-gain[one], kind="stable")], two[np.argsort(-gain[two], kind="stable")]
        n = min(len(one), len(two))
        swap = int(((gain[one[:n]] + gain[two[:n]]) > 0).sum()) // 2
        if not swap:
            break
        side[one[:swap]], side[two[:swap]] = 1, 0
    return nodes[side == 0], nodes[side == 1]


def partition(near: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """The part of each node of a neighbour graph: halved again and again; sizes differ by few."""
    rng, groups = np.random.default_rng(seed), [np.arange(len(near))]
    while len(groups) < parts:
        groups = [h for g in groups for h in halve(near, g, rng)]
    label = np.zeros(len(near), np.int64)
    for k, g in enumerate(groups):
        label[g] = k
    return label


@dataclass
class Router:
    """A classifier with one hidden layer, from vectors to parts; and how many parts a query goes to."""

    centre: np.ndarray
    scale: float
    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    last: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) * self.scale @ self.first + self.bias, 0) @ self.second + self.last


def train(x: np.ndarray, target: np.ndarray, hidden: int = 64, epochs: int = 40, seed: int = 0) -> Router:
    """Fits the classifier to target, the share of each part among a vector and its neighbours."""
    rng = np.random.default_rng(seed)
    centre = x.mean(axis=0)
    scale = 1 / (x.std() + 1e-12)
    z = (x - centre) * scale
    w = [rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, target.shape[1])) * np.sqrt(1 / hidden), np.zeros(target.shape[1])]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(z))
        for k in range(0, len(z), 256):
            b = order[k : k + 256]
            h = np.maximum(z[b] @ w[0] + w[1], 0)
            s = h @ w[2] + w[3]
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - target[b]) / len(b)
            gh = (g @ w[2].T) * (h > 0)
            grads = [z[b].T @ gh + 1e-4 * w[0], gh.sum(axis=0), h.T @ g + 1e-4 * w[2], g.sum(axis=0)]
            step += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                w[i] -= 3e-3 * (1 - epoch / epochs) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(centre, scale, *w, probes=1)


def parts_for(n: int, sample: int = SAMPLE) -> int:
    """Parts for n vectors, a power of two: one for each PART vectors, but LEAST_PARTS at least, of four vectors or more,
    and no more than the largest sample can teach."""
    most = min(max(LEAST_PARTS, n / PART), n / 4, sample / EACH)
    return 1 << max(0, int(np.floor(np.log2(max(1.0, most)))))


def fit(x: np.ndarray, parts: int, k: int = 20, recall: float = 0.95) -> Router:
    """Fits on a sample: graph, balanced parts, classifier, then the least number of probes with which a fifth of the
    sample's vectors find that share of their k nearest, each classified to its own part. In all data neighbours are
    nearer than in the sample, which only helps. One part needs no fit."""
    x = np.ascontiguousarray(x, np.float64)
    if parts == 1:
        return Router(np.zeros(x.shape[1]), 1.0, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = neighbours(x, NEIGHBOURS)
    label = partition(near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), 1)
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1)
    router = train(x, target / target.sum(axis=1, keepdims=True))
    scores = router.scores(x)
    own = scores.argmax(axis=1)
    asked = np.arange(0, len(x), 5)
    best = neighbours(x, k)[asked]
    place = np.argsort(np.argsort(-scores[asked], axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, own[best], axis=1).ravel()
    found = np.cumsum(np.bincount(needed, minlength=parts)) / needed.size
    router.probes = int(np.searchsorted(found, recall)) + 1
    return router


def usable(v: Column) -> Column:
    """Vectors that take part: not null, not zero, no component null or not finite."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _smallest(rows: DataFrame, n: int, most: int) -> DataFrame:
    """Of n rows the `most` with the smallest hashes of vec_id. Only rows below a threshold that a few more than `most` are
    expected to be under are sorted, so tasks don't hand up as many each, however many tasks there are."""
    share = min(1.0, (most + 8 * most**0.5 + 64) / max(1, n))
    some = rows if share == 1 else rows.where(F.xxhash64("vec_id") < int((2 * share - 1) * (1 << 63)))
    return some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most)


def ann_search(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE, parts: int | None = None, recall: float = 0.95, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of vectors (vec_id, embedding; other columns only for is_query)
    where is_query holds, its k nearest of those found, by the largest inner product in double precision of the
    original vectors, ties to the smaller vec_id. The query's own id is no candidate. All candidates, if there are fewer.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without a vec_id or
    vectors of another length than the most frequent one (of several, the longest). Rows that share a vec_id count
    once, with the smallest of their vectors. No usable rows give no rows. A score that is not a number, as of products
    that overflow both ways, ranks last.

    The index is fitted on the driver on at most `sample` vectors, those with the smallest hashes of their ids, into as
    many parts as parts_for says; every vector is then routed once to the part that the classifier holds most probable.
    A query goes to as many parts as the fit found necessary, or more, until these hold k others. Parts of any size are
    dealt out as blocks of candidates by blocks of queries, so no task holds more than one of each, however many vectors
    share a part.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return nothing
    width = widths[0]["width"]
    rows = rows.where(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v"), F.max(F.coalesce("q", F.lit(False))).alias("q"))
    rows = checkpointed(rows)
    n = rows.count()
    parts = parts or parts_for(n, sample)
    picked = _smallest(rows, n, min(sample, max(LEAST_SAMPLE, EACH * parts))).select("v").toArrow()
    router = fit(_matrix(picked.column("v"), width), min(parts, parts_for(len(picked), sample)), k, recall)
    given = spark.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = given.value.scores(_matrix(b.column("v"), width)).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("q"), pa.array(part)], ["vec_id", "v", "q", "part"])

    routed = checkpointed(map_batches(rows, route, "vec_id long, v array<double>, q boolean, part int"))
    sizes = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}  # a number for each part
    held = np.array([sizes.get(p, 0) for p in range(max(sizes) + 1)])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = np.argsort(-given.value.scores(_matrix(b.column("v"), width)), axis=1, kind="stable")
            some = np.where(order < len(held), held[np.minimum(order, len(held) - 1)], 0)
            # a part is asked if it is among the first ones, or those before it hold too few; empty ones never
            asked = (np.cumsum(some > 0, axis=1) <= given.value.probes) | (np.cumsum(some, axis=1) - some <= k)
            to = [o[a].astype(np.int32) for o, a in zip(order, asked & (some > 0), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(to, pa.list_(pa.int32()))], ["vec_id", "v", "parts"])

    probes = checkpointed(map_batches(routed.where("q").select("vec_id", "v"), probe, "vec_id long, v array<double>, parts array<int>"))
    asked = probes.select(F.explode("parts").alias("part")).groupBy("part").count().collect()
    blocks = {p: [-(-n // candidates), 0] for p, n in sizes.items()}
    for r in asked:
        blocks[r["part"]][1] = -(-r["count"] // queries)

    def blocks_of(part: str, side: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for p, n in sorted(blocks.items()) for x in (p, max(1, n[side]))]), F.col(part))

    def dealt(df: DataFrame, part: str, own: int, query: bool) -> DataFrame:
        """Each row in its own block of its side, against all blocks of the other side."""
        mine = F.pmod(F.xxhash64("vec_id"), blocks_of(part, own)).cast("int")
        other = F.explode(F.sequence(F.lit(0), blocks_of(part, 1 - own) - 1))
        df = df.select("vec_id", "v", F.col(part).alias("part"), mine.alias("mine"), other.alias("other"), F.lit(query).alias("q"))
        return df.select("vec_id", "v", "q", F.struct("part", F.col("other" if query else "mine").alias("c"), F.col("mine" if query else "other").alias("q")).alias("key"))

    if not asked:
        return nothing
    both = dealt(routed.where(F.col("part").isin([r["part"] for r in asked])), "part", 0, False).unionByName(dealt(probes.withColumn("to", F.explode("parts")), "to", 1, True))

    def nearest(table: pa.Table) -> pa.Table:
        flag = table.column("q").to_numpy()
        x, ids = _matrix(table.column("v"), width), table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids, flag = x[order], ids[order], flag[order]
        c, cid, q, qid = x[~flag], ids[~flag], x[flag], ids[flag]
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        parts = [out]
        for a in range(0, len(q) if len(c) else 0, 64):  # a block of parts without candidates gives nothing
            # einsum sums each pair in the same order, so equal vectors have equal scores; candidates are in order of id
            s = np.einsum("qd,cd->qc", q[a : a + 64], c)
            own = qid[a : a + 64, None] == cid[None, :]
            top = np.argsort(np.where(own | np.isnan(s), np.inf, -s), axis=1, kind="stable")[:, : k + 1]
            real = ~np.take_along_axis(own, top, axis=1)
            real &= np.cumsum(real, axis=1) <= k
            parts.append([np.broadcast_to(qid[a : a + 64, None], top.shape)[real], cid[top][real], np.take_along_axis(s, top, axis=1)[real]])
        found = [np.concatenate(z) for z in zip(*parts, strict=True)]
        return pa.table({"query_id": pa.array(found[0]), "vec_id": pa.array(found[1]), "score": pa.array(found[2])})

    found = both.groupBy("key").applyInArrow(nearest, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
