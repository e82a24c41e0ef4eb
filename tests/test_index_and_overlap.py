"""The stored BM25 index, overlap and containment against brute force."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from sextant.operators import bm25_index as B
from sextant.operators import overlap as O
from sextant.operators import retrieval
from sextant.session import shared_folder

DOCS = "doc_id string, text string"


def plain_bm25(docs, queries, k, k1=1.5, b=0.75, epsilon=0.25):
    own = {d: Counter(retrieval.split_tokens(t or "")) for d, t in docs}
    n, avg = len(docs), sum(sum(c.values()) for c in own.values()) / len(docs)
    df = Counter(t for c in own.values() for t in c)
    raw = {t: math.log(n - m + 0.5) - math.log(m + 0.5) for t, m in df.items()}
    low = epsilon * sum(raw.values()) / len(raw)
    idf = {t: x if x >= 0 else low for t, x in raw.items()}
    out = {}
    for q, text in queries:
        def score(d, text=text):
            dl = sum(own[d].values())
            return round(sum(idf[t] * (k1 + 1) * own[d][t] / (own[d][t] + k1 * (1 - b + b * dl / avg)) for t in retrieval.split_tokens(text or "") if own[d][t]), 4) + 0.0
        out[q] = sorted(((d, score(d)) for d, _ in docs), key=lambda z: (-z[1], z[0]))[:k]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append((r["doc_id"], r["score"]))
    return out


@pytest.mark.parametrize("shard", [3, 4096])
def test_index_equals_brute_force(spark, tmp_path, shard):
    """Written once, then opened for two query sets; string ids, ties, null texts, documents that score nothing."""
    rng = random.Random(shard)
    words = [f"w{k}" for k in range(40)] + ["a.b/c", "Image:Pull-Back", "the"]
    docs = [(f"doc#{k:03d}", " ".join(rng.choices(words, weights=[1 + (k % 5 == j % 5) * 9 for j in range(43)], k=rng.randint(0, 30))) + " the") for k in range(120)]
    docs += [("null", None), ("empty", ""), ("éa", "w1 w2"), ("éb", "w1 w2")]
    B.Index.write(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as term", "2 as shard").repartition(5), str(tmp_path / "index"), shard, 7)
    first = [("one", "w1 w2 w2"), ("two", "a.b/c pull"), ("rare", "back nothing"), ("none", "unknown words"), ("null", None), ("often", "the the")]
    second = [(k, " ".join(rng.choices(words, k=4))) for k in range(30)]
    for queries, kind in ((first, "string"), (second, "int")):
        index = B.Index.open(spark, str(tmp_path / "index"))
        got = ranked(index.top_k(spark.createDataFrame(queries, f"qid {kind}, query string"), 9, block=4))
        assert got == plain_bm25(docs, queries, 9)


def test_small_and_empty_collections(spark, tmp_path):
    # a term in most documents weighs less than nothing, so those without it come first
    docs = [(f"d{k}", "all" if k < 7 else "all other" if k < 9 else "") for k in range(12)]
    queries = [("q", "all"), ("r", "all other")]
    index = B.Index.write(spark.createDataFrame(docs, DOCS), str(tmp_path / "few"), 2, 3)
    assert ranked(index.top_k(spark.createDataFrame(queries, "qid string, query string"), 5)) == plain_bm25(docs, queries, 5)
    empty = B.bm25_top_k(spark.createDataFrame([], DOCS), spark.createDataFrame(queries, "qid string, query string"), 5)
    assert empty.collect() == [] and empty.columns == ["qid", "doc_id", "score", "rank"]
    assert index.top_k(spark.createDataFrame([], "qid string, query string")).collect() == []


def test_index_keeps_a_row_for_many_terms(spark, tmp_path):
    """A shard leaves a row for each bucket, however many terms it has; no copy of the lists stays among the checkpoints."""
    docs = spark.range(400).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 30), k -> concat('t', id * 30 + k))) || ' all' as text")
    kept = lambda: sum(p.stat().st_size for p in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if p.is_file())
    before = kept()
    index = B.Index.write(docs, str(tmp_path / "index"), 100, 4)
    shards = spark.read.parquet(f"{index.path}/shards").count()
    assert spark.read.parquet(f"{index.path}/postings").count() <= 5 * shards and kept() == before
    assert index.statistics.terms == 400 * 30 + 1
    got = ranked(index.top_k(spark.createDataFrame([("q", "t31 all"), ("r", "t11999 t95")], "qid string, query string"), 3))
    assert [d for d, _ in got["q"]] == [1, 0, 2] and [d for d, _ in got["r"]] == [3, 399, 0]


def test_index_is_made_a_part_of_a_shard_at_a_time(spark, tmp_path, monkeypatch):
    """A task holds a few bytes a token of a full shard, and no batch that it leaves holds the lists of all of it."""

    class Docs:
        sparkSession, schema = spark, spark.createDataFrame([], DOCS).schema
        select = repartitionByRange = sortWithinPartitions = lambda self, *_: self

        def mapInArrow(self, run, kind):  # noqa: ANN001
            self.run = run
            raise InterruptedError

    docs = Docs()
    with pytest.raises(InterruptedError):
        B.Index.write(docs, str(tmp_path / "index"), 4096, 16)
    monkeypatch.setattr(B, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng, words = np.random.default_rng(1), np.array([f"w{k}" for k in range(5000)])
    given = [pa.record_batch({"doc_id": [f"d{k}" for k in range(at, at + 64)], "text": [" ".join(rng.choice(words, 500)) for _ in range(64)]}) for at in range(0, 4096, 64)]
    tracemalloc.start()
    try:
        pairs, largest = 0, 0
        for b in docs.run(iter(given)):
            n = sum(len(x) for x in b.column("places") if x.is_valid)
            pairs, largest = pairs + n, max(largest, n)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pairs == sum(len({*t.split()}) for b in given for t in b.column("text").to_pylist())
    assert largest <= 1 << 18 and peak < 22 * 4096 * 500


def test_stored_index_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([("a", "alpha"), ("b", "beta"), ("c", "gamma")], DOCS).write.parquet(path)
    one = B.stored(spark.read.parquet(path), "t")
    assert B.stored(spark.read.parquet(path), "t") is one
    spark.createDataFrame([("d", "delta")], DOCS).write.mode("append").parquet(path)
    assert B.stored(spark.read.parquet(path), "t").statistics.documents == 4


def test_vectors_rank_ids_of_any_kind(spark):
    docs = spark.createDataFrame([(f"doc#{k:03d}", [float(k % 10), 1.0]) for k in range(40)], "doc_id string, v array<float>").repartition(3)
    queries = spark.createDataFrame([("doc#001", [1.0, 0.0]), ("doc#002", [-1.0, 0.0])], "qid string, q array<double>")
    got = ranked(retrieval.dense(queries, docs, 3))
    assert [d for d, _ in got["doc#001"]] == ["doc#009", "doc#019", "doc#029"] and [d for d, _ in got["doc#002"]] == ["doc#000", "doc#010", "doc#020"]
    ranks = retrieval.dense_ranks(queries, docs, spark.createDataFrame([("doc#001", "doc#008"), ("doc#002", "doc#011")], "qid string, doc_id string"))
    assert {r["qid"]: r["rank"] for r in ranks.collect()} == {"doc#001": 5, "doc#002": 5}
    with_bm25 = retrieval.rrf([retrieval.dense(queries, docs, 3), retrieval.dense(queries, docs, 3)], 2)
    assert {r["doc_id"] for r in with_bm25.where("rank = 1").collect()} == {"doc#009", "doc#000"}


def test_overlap_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(25)] + ["the", "of", "x", "İ", "K", "naïve", "e.g."]
    docs = [(f"d{k}", " ".join(rng.choices(words, k=rng.randint(0, 25)))) for k in range(150)] + [("null", None), ("empty", "")]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(25)] + [docs[k][1][a : a + 30] for k, a in ((0, 1), (5, 3), (9, 0))] + ["", None, "the", "of the", ". .", docs[3][1]]
    queries = list(enumerate(texts))
    content = lambda t: {w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 1 and w not in O._STOP}
    ov = lambda q, d: len(content(q) & content(d)) / len(content(q)) if content(q) else 1.0
    has = lambda q, d: q is not None and d is not None and q in d
    df, asked = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(queries, "qid int, text string")
    found = O.containing(df, asked, sample=20)
    assert sorted(map(tuple, found.collect())) == sorted((q, d) for q, t in queries for d, b in docs if has(t, b))
    got = {r["qid"]: r for r in O.overlap_summary(df, asked, 0.5, block=7).collect()}
    for q, t in queries:
        each = [(ov(t, b), has(t, b)) for _, b in docs]
        r = got[q]
        assert (r["n"], r["over"], r["containing"]) == (len(docs), sum(o > 0.5 for o, _ in each), sum(h for _, h in each)), t
        assert r["most"] == pytest.approx(max(o for o, _ in each)) and r["total"] == pytest.approx(sum(o for o, _ in each)) and r["total_containing"] == pytest.approx(sum(o for o, h in each if h))
    top = ranked(O.overlap_top_k(df, asked, 5, block=7))
    assert top == {q: sorted(((d, round(ov(t, b), 6)) for d, b in docs), key=lambda z: (-z[1], z[0]))[:5] for q, t in queries}


def test_what_is_shuffled_is_bounded(spark):
    """Tasks leave a row a query, or the hits; not a row for every pair."""
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('alpha beta gamma ', id, ' omega') as text").repartition(3)
    asked = spark.createDataFrame([(k, f"beta gamma {k} omega") for k in range(50)], "qid int, text string")
    for df, most in ((O.overlap_summary(docs, asked), 3 * 50), (O.containing(docs, asked), 50), (O.overlap_top_k(docs, asked, 2), 6 * 3 * 2 * 50)):
        df.collect()
        nodes, rows = [df._jdf.queryExecution().executedPlan()], []
        while nodes:
            node = nodes.pop()
            while "AdaptiveSparkPlan" in (name := node.nodeName()) or "QueryStage" in name:
                node = node.plan() if "QueryStage" in name else node.executedPlan()
            if node.nodeName() == "MapInArrow":
                rows.append(node.metrics().apply("pythonNumRowsReceived").value())
            nodes += [node.children().apply(k) for k in range(node.children().size())]
        assert rows and sum(rows) <= most
