"""Operators on literal rows, most of them with results worked out by hand."""

from __future__ import annotations

import math
import random
import re
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sextant.functions import text as T
from sextant.operators import bm25_index, cache, corpus, freeze, generation, incident, labels, markdown, metrics, pairs, queues, retrieval, sampling
from sextant.settings import Chunking, Training, Tree
from sextant.settings import settings as checked


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("set Kubernetes.io/hostname", ["set", "kubernetes", "io", "hostname", "kubernetes.io/hostname"]),
        ("a-b  c_d", ["a", "b", "a-b", "c", "d", "c_d"]),
        ("", []),
        ("...", []),
    ],
)
def test_tokens(spark, text, want):
    assert value(spark, T.tokens(F.lit(text))) == want


def test_overlap(spark):
    q, p = (T.content_words(F.lit(x)) for x in ("The pods RESTART on probe timeout", "Pods restart when the liveness probe times out"))
    assert value(spark, T.overlap(q, p)) == 0.75
    assert value(spark, T.overlap(T.content_words(F.lit("to the")), p)) == 1.0


def test_small_text_functions(spark):
    assert value(spark, T.section_label(F.array(*map(F.lit, ["Debug Pods", "A", "B", "C"])), F.lit("debug pods"))) == "B > C"
    assert value(spark, T.section_label(F.array(F.lit("A")), F.lit("T"))) == "A"
    assert value(spark, T.passage(F.lit("T"), F.lit("S"), F.lit("b"))) == "T > S\n\nb"
    assert value(spark, T.passage(F.lit("T"), F.lit(""), F.lit("b"))) == "T\n\nb"
    assert value(spark, T.doc_id(F.lit("a/b/_index.md"))) == "a/b" and value(spark, T.doc_id(F.lit("a/c.md"))) == "a/c"
    assert value(spark, T.retry_seconds(F.lit("Please retry in 14h7m22.8s"))) == pytest.approx(14 * 3600 + 7 * 60 + 22.8)
    assert value(spark, T.retry_seconds(F.lit("retry in a while"))) is None
    assert value(spark, T.html_to_text(F.lit("<p>a &amp; b  </p><br/><p></p>\n\n<li>c</li>"))) == "a & b\n\nc"
    assert value(spark, T.head_words(F.lit(" a  b c "), 2)) == "a b"
    assert value(spark, T.error_lines(F.lit("ok\nError one\nunable to retrieve it\nTIMEOUT two\npanic three"))) == ["TIMEOUT two", "panic three"]


def test_last_error_lines_of_a_log(spark):
    # lines of one position stand in the order of the ties
    rows = [("a", 1, 2, "panic 2"), ("a", 1, 1, "panic 1\nok\nfailed 1"), ("a", 0, 3, "panic 0"), ("b", 5, 1, "ok\n\nfine"), ("c", 1, 1, None), (None, 1, 1, "Error from server\n\u00a0OOM")]
    found = incident.last_error_lines(spark.createDataFrame(rows, "k string, pos int, tie int, text string"), "k", "pos", "text", ties=["tie"])
    assert {r["k"]: (r["n_lines"], r["lines"]) for r in found.collect()} == {"a": (4, ["failed 1", "panic 2"]), None: (1, ["OOM"])}


def test_item_id_is_of_compact_json(spark):
    import hashlib

    want = hashlib.sha256(b'["a","b c"]').hexdigest()[:16]
    assert value(spark, T.item_id(F.lit("a"), F.lit("b c"))) == want


@pytest.mark.parametrize(("glob", "path", "fits"), [("docs/*.md", "docs/a/b.md", True), ("*.txt", "a.md", False), ("a?c.md", "abc.md", True), ("a.md", "axmd", False)])
def test_globs(spark, glob, path, fits):
    assert value(spark, F.lit(path).rlike(T.glob_pattern(glob))) is fits


def rankings(spark, rows):
    return spark.createDataFrame(rows, "qid string, doc_id string, rank int")


def test_metrics(spark):
    ranked = rankings(spark, [("q", d, k + 1) for k, d in enumerate("abc")] + [("far", f"d{k}", k) for k in range(1, 30)])
    rel = spark.createDataFrame([("q", "c"), ("far", "d20"), ("none", "x")], "qid string, doc_id string")
    got = {r["qid"]: r for r in metrics.query_metrics(ranked, rel).collect()}
    assert (got["q"]["hit_1"], got["q"]["hit_5"], got["q"]["hit_10"]) == (0, 1, 1)
    assert got["q"]["mrr_10"] == pytest.approx(1 / 3) and got["q"]["ndcg_10"] == pytest.approx(1 / math.log2(4))
    for q in ("far", "none"):
        assert all(got[q][m] == 0 for m in metrics.METRICS)
    slices = spark.createDataFrame([("q", ["all", "low"]), ("far", ["all"]), ("none", ["all"])], "qid string, slices array<string>")
    table = {r["slice"]: r for r in metrics.evaluate(ranked, rel, slices).collect()}
    assert table["all"]["n"] == 3 and table["low"]["n"] == 1 and table["low"]["hit_5"] == 1
    assert [(r["qid"], r["rank"]) for r in metrics.worst(ranked, rel, 2).collect()] == [("none", 101), ("far", 20)]


def test_top_k_ties(spark):
    rows = spark.createDataFrame([(1, d, s) for d, s in enumerate([0.1, 0.9, 0.5, 0.9, 0.2])], "qid int, doc_id int, score double")
    assert [r["doc_id"] for r in retrieval.top_k(rows, 3).orderBy("rank").collect()] == [1, 3, 2]
    positives = spark.createDataFrame([(1, 3)], "qid int, doc_id int")
    assert retrieval.rank_of(rows, positives).first()["rank"] == 1


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "pods restart"), (1, "node drain guide"), (2, "ImagePullBackOff when a deploy pulls"), (3, "x y z")], "doc_id long, text string")
    queries = spark.createDataFrame([("a", "ImagePullBackOff on deploy"), ("b", "nothing known")], "qid string, query string")
    got = bm25_index.bm25_top_k(docs, queries, 3).orderBy("qid", "rank").collect()
    assert [r["doc_id"] for r in got if r["qid"] == "a"] == [2, 0, 1]
    assert [(r["doc_id"], r["score"]) for r in got if r["qid"] == "b"] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_dense_blocks_and_fusion(spark):
    docs = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(30)], "doc_id long, v array<float>").repartition(4)
    queries = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "qid long, q array<double>")
    got = retrieval.dense(queries, docs, 3, block=2)
    assert all([r["doc_id"] for r in got.where(f"qid = {q}").orderBy("rank").collect()] == [29, 28, 27] for q in range(5))
    one = got.where("qid = 0")
    assert [r["doc_id"] for r in retrieval.rrf([one, one], 2).orderBy("rank").collect()] == [29, 28]
    known = {"bm25": lambda q: one, "dense": lambda q: got.where("qid = 0")}
    assert retrieval.ranker("hybrid:vectors", known)(queries).count() == 3
    with pytest.raises(ValueError, match="no ranker"):
        retrieval.ranker("other", known)
    assert retrieval.dense(queries.limit(0), docs).collect() == []


def test_duplicates_and_cascade(spark):
    rows = spark.createDataFrame([(0, "a", "c1"), (1, "a", "c1"), (2, "b", "c1"), (3, "b", "c2"), (4, None, "c1")], "pos long, q string, chunk string")
    got = {r["pos"]: r["drop"] for r in pairs.mark_duplicates(rows, "q", "chunk", "pos").collect()}
    assert got == {0: "", 1: "duplicate", 2: "ambiguous", 3: "ambiguous", 4: ""}
    rows = spark.createDataFrame([("", "symptom", 0.7504, 1), ("", "symptom", 0.7506, 1), ("", "error_string", 1.0, 51), ("duplicate", "how_to", 1.0, 99)], "d string, style string, ov double, r int")
    found = rows.select(pairs.first_reason(F.col("d"), F.col("style"), F.col("ov"), F.col("r")).alias("x")).collect()
    assert [r["x"] for r in found] == ["", "overlap", "round_trip", "duplicate"]


def test_greedy_near_duplicates(spark):
    rows = spark.createDataFrame([("c", 0, [1.0, 0.0]), ("c", 1, [0.99, 0.14]), ("c", 2, [0.9, 0.43]), ("d", 3, [1.0, 0.0])], "g string, pos long, v array<float>")
    got = {r["pos"]: r["near_duplicate"] for r in pairs.greedy_near_duplicates(rows, "g", "pos", "v").collect()}
    assert got == {0: False, 1: True, 2: False, 3: False}


    gated = rows.withColumn("ok", F.col("pos") > 0)
    got = {r["pos"]: r["near_duplicate"] for r in pairs.greedy_near_duplicates(gated, "g", "pos", "v", counts="ok").collect()}
    assert got == {0: False, 1: False, 2: True, 3: False}


def test_greedy_rounds_equal_a_fold(spark):
    """Groups of any size, in rounds of few rows; rows without a group or vector; rows that don't count."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, [rng.choice((-1.0, 0.0, 1.0)) for _ in range(3)] if k % 17 else None, rng.random() < 0.8) for k in range(300)]
    kept, want = {}, {}
    for g, k, v, ok in rows:
        want[k] = v is not None and any(sum(x * y for x, y in zip(v, w)) > 1.5 for w in kept.get(g, []))
        if v is not None and ok and not want[k]:
            kept.setdefault(g, []).append(v)
    df = spark.createDataFrame(rows, "g string, pos long, v array<float>, ok boolean").repartition(3)
    for size in (2, 40, 1024):
        got = pairs.greedy_near_duplicates(df, "g", "pos", "v", 1.5, "ok", size=size)
        assert {r["pos"]: r["near_duplicate"] for r in got.collect()} == want and got.columns == [*df.columns, "near_duplicate"]


def test_greedy_takes_a_large_group(spark):
    df = spark.range(100_000).selectExpr("'all' as g", "id as pos", "array(cos(id % 5000), sin(id % 5000)) as v")
    got = pairs.greedy_near_duplicates(df, "g", "pos", "v", 0.9999)
    # what is kept is apart by 0.0141 at least, on a circle
    n = got.where("not near_duplicate").count()
    assert 200 < n < 2 * math.pi / 0.01414 and got.count() == 100_000


def test_filter_chain(spark):
    near, far = [1.0, 0.0], [0.0, 1.0]
    rows = [
        (0, "How to drain nodes?", "how_to", "a#000", "other text", 1, near),
        (1, "how to DRAIN nodes", "how_to", "a#000", "other text", 1, far),
        (2, "pods crash", "symptom", "a#000", "pods crash loop", 1, far),
        (3, "image pull", "error_string", "a#000", "image pull", 60, far),
        (4, "image pulls", "error_string", "a#000", "x", 1, far),
        (5, "node drained", "error_string", "a#000", "x", 70, near),
        (6, "shared words", "how_to", "a#000", "x", 1, far),
        (7, "shared words", "how_to", "b#000", "x", 1, far),
    ]
    df = spark.createDataFrame(rows, "pos long, query string, style string, chunk_id string, passage string, rt_rank int, v array<float>").withColumn("split", F.lit("train"))
    got = pairs.filter_chain(df)
    # 3 fails the round trip, so 4 has no sibling to be near to; 5 is near 0 and fails that first
    assert {r["pos"]: r["drop"] for r in got.collect()} == {0: "", 1: "duplicate", 2: "overlap", 3: "round_trip", 4: "", 5: "near_duplicate", 6: "ambiguous", 7: "ambiguous"}
    s = pairs.filter_stats(got, "split").first()
    assert (s["generated"], s["kept"], s["kept_chunks"]) == (8, 2, 1) and s["kept_by_style"] == {"how_to": 1, "error_string": 1} and s["dropped"]["ambiguous"] == 2


def test_chunk_neighbours(spark):
    rows = spark.createDataFrame([("d#009", "d#010", True), ("d#009", "d#011", False), ("d#1", "e#2", False), ("a#b#3", "a#b#2", True), ("x", "x", True)], "a string, b string, near boolean")
    assert rows.where(pairs.neighbours(F.col("a"), F.col("b")) != F.col("near")).count() == 0
    scores = spark.createDataFrame([("q", f"d#{k:03d}", 1 - k / 100) for k in range(1, 40)], "qid string, doc_id string, score double")
    found = pairs.hard_negatives(scores, spark.createDataFrame([("q", "d#012", 1.0)], "qid string, doc_id string, score double"), "s", keep=50).first()
    assert found["window"] == "main" and not {"d#011", "d#012", "d#013"} & {*found["negatives"]} and "d#014" in found["negatives"]


def test_ranks_of_positives_without_pairs(spark):
    rng = random.Random(2)
    rows = [(k, [round(rng.gauss(0, 1), 1) for _ in range(3)]) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, v array<double>").repartition(5)
    queries = spark.createDataFrame([(k, v) for k, v in rows if k % 9 == 0], "qid long, q array<double>")
    positives = queries.select("qid", (F.col("qid") + 1).alias("doc_id"))
    got = {r["qid"]: r["rank"] for r in retrieval.dense_ranks(queries, docs, positives, block=4).collect()}
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 6)
    assert got == {q: 1 + sum(dot(v, w) > dot(v, rows[q + 1][1]) for d, w in rows if d != q) for q, v in rows if q % 9 == 0 and q + 1 < 80}


def test_single_precision_ranks(spark):
    docs = spark.createDataFrame([(k, "alpha beta " * (k + 1) + "gamma " * 3) for k in range(6)] + [(9, "delta"), (10, "epsilon zeta"), (11, "eta")], "doc_id long, text string")
    queries = spark.createDataFrame([("q", "alpha gamma")], "qid string, query string")
    one, two = ({r["doc_id"]: r["score"] for r in bm25_index.bm25_top_k(docs, queries, 9, digits=12, single=s).collect()} for s in (False, True))
    assert all(abs(one[d] - two[d]) < 1e-6 for d in one) and any(one[d] != two[d] for d in one)


def test_hard_negatives(spark):
    scores = [("q", k, round(1 - 0.9 * k / 39, 6)) for k in range(1, 40)]
    tight = [("t", k, 0.99) for k in range(1, 70)]
    df = spark.createDataFrame(scores + tight, "qid string, doc_id long, score double")
    positives = spark.createDataFrame([("q", 0, 1.0), ("t", 0, 1.0)], "qid string, doc_id long, score double")
    got = {r["qid"]: r for r in pairs.hard_negatives(df, positives, "s").collect()}
    assert got["t"]["window"] == "none" and got["t"]["negatives"] == []
    assert got["q"]["window"] == "main" and len(got["q"]["negatives"]) == 3 and all(10 <= d <= 30 for d in got["q"]["negatives"])


def test_splits(spark):
    docs = spark.createDataFrame([(f"{s}{k}", s) for s, n in (("a", 45), ("b", 8)) for k in range(n)], "id string, source string")
    got = {(r["source"], r["split"]): r["count"] for r in sampling.stratified_split(docs, "id", "source", "x").groupBy("source", "split").count().collect()}
    assert got == {("a", "test"): 4, ("a", "val"): 4, ("a", "train"): 37, ("b", "test"): 3, ("b", "val"): 3, ("b", "train"): 2}
    assert [r["source"] for r in sampling.too_small(docs.union(docs.limit(1).select(F.lit("z"), F.lit("c"))), "source").collect()] == ["c"]


def test_samples(spark):
    rows = spark.createDataFrame([(k, k % 3) for k in range(41)], "id long, style int")
    halves = {r["half"]: r["count"] for r in sampling.halves(rows, "id", "s").groupBy("half").count().collect()}
    assert halves == {"val": 20, "test": 21}
    assert sampling.hash_sample(rows, "id", "s", 7).count() == 7 and sampling.hash_sample(rows, "id", "s", 99).count() == 41
    assert sorted(r["pos"] for r in sampling.ranked(rows, [F.col("id")]).collect()) == list(range(1, 42))
    robin = sampling.round_robin(rows, "style", "id", "s", 10, F.col("id") < 2).collect()
    assert len(robin) == 10 and sum(r["round"] == 0 for r in robin) == 2
    assert sampling.one_each(rows, "style", "id", "s").count() == 3
    sizes = sampling.batches(rows, "style", [F.col("id")], 8).groupBy("style", "batch").count().collect()
    assert max(r["count"] for r in sizes) == 8 and len(sizes) == 6


def test_labels(spark):
    log = spark.createDataFrame([("a", "wrong", 1), ("b", "correct", 2), ("a", "correct", 3)], "id string, verdict string, pos long")
    assert {r["id"]: r["verdict"] for r in labels.latest(log, ["id"], ["pos"]).collect()} == {"a": "correct", "b": "correct"}
    human = spark.createDataFrame([("t1", "correct"), ("t2", "wrong")], "id string, verdict string")
    other = spark.createDataFrame([("t1", "correct", "model"), ("t2", "correct", "model"), ("t3", "wrong", "model")], "id string, verdict string, labeler string")
    r = labels.agreement(human, other).first()
    assert (r["n"], r["agreement"], r["confusion"]) == (2, 0.5, {"correct/correct": 1, "wrong/correct": 1})
    assert [tuple(x) for x in labels.disagreements(human, other.withColumn("labeler", F.lit("alice"))).collect()] == [("t2", "wrong", "correct")]
    empty = labels.agreement(human.limit(0), other).first()
    assert (empty["n"], empty["agreement"], empty["confusion"]) == (0, None, {})
    queue = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, pos long")
    done = spark.createDataFrame([("b", "correct"), ("zz", "wrong")], "id string, verdict string")
    s = labels.summary(queue, done, "verdict").first()
    assert (s["total"], s["labelled"], s["done"], s["counts"]) == (3, 1, False, {"correct": 1})
    nxt = labels.next_unlabelled(queue, done, 2).first()
    assert (nxt["first"], nxt["next"]) == (0, 0)


def test_import_is_idempotent(spark):
    queue = spark.createDataFrame([("a", "test_pairs", ["c1", "c2"]), ("b", "test_pairs", ["c1"]), ("c", "so_questions", ["c1", "c2"]), ("d", "negatives_audit", None), ("e", "train_audit", None), ("f", "test_pairs", ["c1"]), ("g", "so_questions", ["c1"])], "id string, task string, candidates array<string>")
    kind = "id string, verdict string, also_relevant array<string>, relevant array<string>, reason string, labeler string"
    known = spark.createDataFrame([("b", "wrong", [], None, "", "alice"), ("c", None, None, ["c1"], "", "model"), ("e", "wrong", None, None, "", None)], kind)
    rows = [("a", 0, " Correct", "x" * 400, ["b", "A", "B"], None), ("b", 1, "correct", "", [], None), ("x", 2, "correct", "", [], None), ("c", 3, None, "", None, ["A", "B"]), ("d", 4, "correct", "", None, None), ("d", 5, "true_negative", "", None, None), ("e", 6, "correct", "", None, None), ("f", 7, "wrong", "", ["B"], None), ("g", 8, None, "", ["A"], None)]
    answers = spark.createDataFrame(rows, "id string, pos long, verdict string, reason string, also_relevant array<string>, relevant array<string>")
    first = {r["id"]: r for r in labels.imported(answers, queue, known).collect()}
    assert {i: r["status"] for i, r in first.items()} == {"a": "saved", "b": "kept_human", "x": "unknown", "c": "saved", "d": "saved", "e": "kept_human", "f": "invalid", "g": "invalid"}
    assert first["a"]["also_relevant"] == ["c2", "c1"] and len(first["a"]["reason"]) == 300 and first["c"]["relevant"] == ["c1", "c2"]
    assert first["f"]["error"] == "unknown letter: B" and first["g"]["error"] == "no list of letters" and first["d"]["verdict"] == "true_negative"
    saved = [tuple(r[c] for c in ("id", *labels.FIELDS)) for r in first.values() if r["status"] == "saved"]
    after = labels.latest(known.withColumn("pos", F.lit(0)).union(spark.createDataFrame(saved, kind).withColumn("pos", F.lit(1))), ["id"], ["pos"]).drop("pos")
    again = {r["id"]: r["status"] for r in labels.imported(answers, queue, after).collect()}
    assert again == {i: "unchanged" if r["status"] == "saved" else r["status"] for i, r in first.items()}
    assert {r["id"]: r["status"] for r in labels.imported(answers, queue, known, overwrite=True).collect()}["b"] == "saved"


def test_frozen_sets(spark):
    chunks = spark.createDataFrame([("d1", "d1#000", 0), ("d1", "d1#001", 1), ("d2", "d2#000", 2)], "doc_id string, chunk_id string, pos long")
    assert {r["doc_id"]: r["chunks"] for r in freeze.doc_chunks(chunks).collect()} == {"d1": ["d1#000", "d1#001"], "d2": ["d2#000"]}
    queries = spark.createDataFrame([("i2", ["d1", "d2", "d1"])], "qid string, relevant_docs array<string>")
    assert freeze.qrels(queries, chunks).count() == 3
    queue = spark.createDataFrame([("t1", "q one", "d1#000"), ("t2", "q two", "d2#000")], "id string, query string, chunk_id string")
    done = spark.createDataFrame([("t1", "correct", ["d1#001", "d1#000"]), ("t2", "wrong", None)], "id string, verdict string, also_relevant array<string>")
    q, rel = freeze.test_pairs(queue, done)
    assert [r["qid"] for r in q.collect()] == ["gen/t1"] and sorted(r["chunk_id"] for r in rel.collect()) == ["d1#000", "d1#001"]
    assert freeze.problems(q, rel, chunks).collect() == []


def test_sets_are_assembled(spark):
    chunks = spark.createDataFrame([("runbook/a", "a#000"), ("runbook/a", "a#001"), ("runbook/b", "b#000")], "doc_id string, chunk_id string")
    rows = spark.createDataFrame([("i1", "q1", ["runbook/a", "runbook/b"], "train"), ("i2", "q2", ["runbook/b"], "val"), ("i3", "q3", ["runbook/b"], "test")], "qid string, query string, relevant_docs array<string>, runbook_split string")
    q, rel = freeze.incidents(rows, chunks, "test")
    assert {(r["qid"], r["slice"]) for r in q.collect()} == {("i1", "real_incident_seen"), ("i3", "real_incident_heldout")} and rel.count() == 4
    q, rel = freeze.incidents(rows, chunks, "val")
    assert [(r["qid"], r["slice"]) for r in q.collect()] == [("i2", "real_incident_heldout")] and rel.count() == 1
    queue = spark.createDataFrame([(f"s{k}", k, f"q{k}", "me") for k in range(7)], "id string, dataset_row int, query string, author string")
    done = spark.createDataFrame([("s0", ["a#000", "a#000"]), *[(f"s{k}", []) for k in range(1, 6)]], "id string, relevant array<string>")
    q, rel, rest = freeze.questions(queue, done, "x")
    assert [r["qid"] for r in q.collect()] == ["so/0"] and rel.count() == 1
    assert {r["half"]: r["count"] for r in rest.groupBy("half").count().collect()} == {"val": 2, "test": 3} and {r["slice"] for r in rest.collect()} == {"out_of_scope"}
    q, rel = freeze.val_pairs(spark.createDataFrame([(3, "q", "how_to", "docs", "a#000")], "pos long, query string, style string, source string, chunk_id string"))
    assert q.first()["qid"] == "val/00003" == rel.first()["qid"]
    known = spark.createDataFrame([("s0", "correct"), ("s1", "wrong")], "id string, verdict string")
    assert {r["verdict"]: r["n"] for r in freeze.outcomes(queue, known).collect()} == {"correct": 1, "wrong": 1, "unlabeled": 5}
    with pytest.raises(ValueError, match="too few"):
        sampling.stratified_split(queue, "id", "author", "x", least=4, strict=True)


def test_settings():
    good = {"max_tokens": 256, "overlap_tokens": 40, "min_tokens": 20, "exclude_sections": ["x"]}
    assert checked(Chunking, good).exclude_sections == ("x",)
    for change, said in (({"max_tokens": 0}, "max_tokens"), ({"overlap_tokens": 128}, "overlap"), ({"other": 1}, "unknown: other"), ({"min_tokens": "3"}, "not int: min_tokens"), ({"exclude_sections": "x"}, "not tuple")):
        with pytest.raises(ValueError, match=said):
            checked(Chunking, good | change)
    with pytest.raises(ValueError, match="missing: min_tokens"):
        checked(Chunking, {"max_tokens": 9, "overlap_tokens": 1})
    with pytest.raises(ValueError, match="commit"):
        checked(Tree, {"repo": "r", "commit": "abc", "docs_root": "d", "examples_root": "e", "include": ["a"]})
    train = {"base_model": "m", "train_file": "t", "output_dir": "o", "batch_size": 64, "mini_batch_size": 8, "learning_rate": 2e-5, "warmup_ratio": 0.1, "epochs": 3, "weight_decay": 0, "eval_steps": 20}
    assert checked(Training, train).train_fraction == 1.0
    with pytest.raises(ValueError, match="warmup_ratio, train_fraction"):
        checked(Training, train | {"warmup_ratio": 1.0, "train_fraction": 0.0})


def test_answers_and_runbooks(spark):
    files = spark.createDataFrame([("a", 'x\n{"id": "1", "verdict": "ok"},\n'), ("b", '{"id": "2"}\n{bad}\n')], "path string, text string")
    assert [(r["path"], r["id"]) for r in generation.answer_rows(files).collect()] == [("a", "1")]
    assert [tuple(r) for r in generation.answer_errors(files).collect()] == [("b", "not valid JSON: {bad}")]
    rows = spark.createDataFrame([("a", ["b", "c"]), ("b", None)], "id string, related array<string>")
    assert [tuple(r) for r in generation.dangling(rows).collect()] == [("a", "c")]


def test_captures(spark):
    sections = [("pods", "", "NAME READY STATUS RESTARTS AGE\nweb 0/1 Error 4 (12s ago) 5m\nok 1/1 Running 0 5m"), ("events", "", "L T R O M\n1m Warning BackOff pod/web Back-off in shop"), ("logs web", "", "hi\nERROR: cannot open shop\n"), ("get pvc", "", "claim Pending\nfine")]
    rows = spark.createDataFrame([("c1", "ok", "shop", sections), ("c2", "failed", "x", [])], "id string, status string, namespace string, sections array<struct<title:string,command:string,output:string>>")
    got = incident.snapshot_queries(rows).collect()
    assert len(got) == 1
    assert got[0]["full"] == "web 0/1 Error 4 (12s ago) | event: Warning BackOff Back-off in prod | log: ERROR: cannot open prod | claim Pending"
    assert got[0]["brief"] == "web 0/1 Error 4 (12s ago) | Warning BackOff Back-off in prod"
    # a client's complaint isn't a log's, but the output of another command may consist of it
    said = [("logs web", "", "Error from server (NotFound): gone"), ("can-i", "", "Error from server (Forbidden): no access\nok"), ("get nodes", "", "k3d-rr-faults-agent-0 NotReady")]
    rows = spark.createDataFrame([("c3", "ok", "shop", said, "oom")], "id string, status string, namespace string, sections array<struct<title:string,command:string,output:string>>, runbook string")
    assert incident.snapshot_queries(rows).first()["full"] == "Error from server (Forbidden): no access | worker-1 NotReady"
    scenarios = spark.createDataFrame([("c3", "oom", ["disk"]), ("c9", "x", None)], "id string, runbook string, also_relevant array<string>")
    made = incident.incident_rows(rows, scenarios, spark.createDataFrame([("runbook/oom", "train")], "doc_id string, split string")).collect()
    assert sorted(r["qid"] for r in made) == ["incident/c3/brief", "incident/c3/full"]
    assert made[0]["relevant_docs"] == ["runbook/oom", "runbook/disk"] and made[0]["runbook_split"] == "train" and made[0]["doc_id"] == "runbook/oom"


MARKDOWN = """{{< comment >}}hidden{{< /comment >}}# Top
See [the *guide*](http://x/(y)) and ![pic](a.png) <b>bold</b> &amp; more   space {#anchor}

{{% heading "whatsnext" %}}
{{< note >}}careful{{< /note >}}
```sh
# not a heading   <b>kept</b>
```
## Next
text
"""


def test_markdown():
    text = markdown.clean(MARKDOWN)
    assert "hidden" not in text and "See the *guide* and bold & more space" in text and "What's next\nNote: careful" in text
    assert "# not a heading   <b>kept</b>" in text
    found = markdown.sections(text)
    assert [p for p, _ in found] == [("Top",), ("Top", "Next")]
    assert markdown.without_sections(found, ["NEXT"]) == found[:1]
    assert markdown.front_matter("---\ntitle: x\n---\nbody") == ("title: x", "body") and markdown.front_matter("body") == ("", "body")
    assert markdown.blocks("a\nb\n\n```\nc\n\nd\n```\n\ne") == ["a\nb", "```\nc\n\nd\n```", "e"]
    assert markdown.without_shortcodes('{{< code_sample file="x/a.yaml" >}}', lambda _: "k: v\n") == "\n```yaml\nk: v\n```\n"


@given(st.lists(st.lists(st.sampled_from(["word", "Sentence ends.", "Longer-word", "x" * 30]), min_size=1, max_size=60).map(" ".join), min_size=1, max_size=8), st.integers(12, 40))
@settings(max_examples=80, deadline=None)
def test_chunks_fit_and_lose_nothing(paragraphs, most):
    chunker = markdown.Chunker(markdown.word_count, most, most // 4, 3)
    text = "\n\n".join(paragraphs)
    got = chunker.chunks("T", [(("A",), text)])
    assert all(n <= most for _, _, n in got)
    if len(text.split()) >= 3:
        seen, rest = " ".join(b for _, b, _ in got).split(), text.split()
        at = iter(seen)
        assert all(any(w == x for x in at) for w in rest)


def test_short_sections_and_cuts():
    chunker = markdown.Chunker(markdown.word_count, 256, 40, 5)
    found = [(("T", "A"), "one two"), (("T", "B"), "three four five six"), (("T", "C"), "end")]
    assert chunker.merged("T", found) == [(("T", "B"), "A:\none two\n\nthree four five six\n\nC:\nend")]
    assert markdown.Chunker(markdown.word_count, 256, 40, 5).merged("T", [(("T", "A"), "one two three four")]) == [((), "A:\none two three four")]
    assert markdown.Chunker(markdown.word_count, 256, 40, 6).merged("T", [(("T", "A"), "one two three four")]) == []
    assert [*markdown.windows("abcdefg", len, 3, 3)] == ["abc", "def", "g"]
    with pytest.raises(ValueError, match="overlap"):
        markdown.Chunker(markdown.word_count, 20, 10)


def _longest_first(text, size, most, kinds):
    """What fits of a text from its beginning, found by trying every place to cut it from the last on; again with the rest."""
    if not text or size(text) <= most:
        return [text] if text else []
    if not kinds:
        return [text[:1], *_longest_first(text[1:], size, most, kinds)] if len(text) > 1 else [text]
    spots = [m for m in re.finditer(kinds[0], text) if 0 < m.start() and m.end() < len(text)]
    for m in reversed(spots):
        if size(text[: m.start()]) <= most:
            return [text[: m.start()], *_longest_first(text[m.end() :], size, most, kinds)]
    first, rest = (text[: spots[0].start()], text[spots[0].end() :]) if spots else (text, "")
    finer = kinds[1:] if kinds[1:] and (" " in first or kinds[1] != " ") else [r"(?=.)"] if kinds[0] != r"(?=.)" else []
    return [*_longest_first(first, size, most, finer), *_longest_first(rest, size, most, kinds)]


@given(st.lists(st.sampled_from(["a", "bb b", "Ends here. Next", "x" * 9, "\n", "y z. Q"]), min_size=1, max_size=25).map("".join), st.integers(3, 20), st.integers(0, 2))
@settings(max_examples=200, deadline=None)
def test_windows_equal_a_plain_search(text, most, level):
    text = re.sub(r"\n+", "\n", text.strip())
    kinds = [[r"\n", " ", r"(?=.)"], [markdown.SENTENCE.pattern, " ", r"(?=.)"], [" ", r"(?=.)"]][level]
    if level and "\n" in text:
        text = text.replace("\n", "-")
    got = [*markdown.windows(text, len, most, level)] if text else []
    assert got == [p for p in _longest_first(text, len, most, kinds) if p]
    assert all(len(p) <= most for p in got)


FENCED = "intro words here\n\n```sh\n" + "\n".join(f"run --step {k}" for k in range(30)) + "\n```\n\nafter it. " + "A sentence of six words here. " * 12


def test_chunks_of_fences_and_their_overlap():
    got = markdown.Chunker(markdown.word_count, 40, 8, 3).chunks("T", [(("T", "Do"), FENCED.strip())])
    assert all(n <= 40 and name == "Do" for name, _, n in got)
    code = [b for _, b, _ in got if "run --step" in b]
    assert all(b.count("```") == 2 * b.count("```sh") for b in code)
    steps = [line for b in code for line in b.split("\n") if line.startswith("run")]
    assert steps == [f"run --step {k}" for k in range(30)]
    prose = [b for _, b, _ in got if "run --step" not in b]
    # the next chunk begins with the last sentence of the one before, which fits the overlap of eight words
    assert all(b.startswith("A sentence of six words here.") for b in prose[2:]) and len(prose) > 3


def test_cleaning_leaves_fences_alone(spark):
    texts = [MARKDOWN, FENCED, None, "", "```\n&amp; <b>x</b>   y\n```\n&amp; <b>x</b>   y"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["x"] for r in rows.select("k", markdown.clean_markdown(F.col("t")).alias("x")).collect()}
    assert got[2] is None and got[3] == "" and got[4] == "```\n&amp; <b>x</b>   y\n```\n& x y"
    assert got[0] == markdown.clean(MARKDOWN) and "run --step 29\n```" in got[1]
    made = markdown.chunked(spark.createDataFrame([("d", "T", "# Do\n" + FENCED)], "doc_id string, title string, text string"), [], max_tokens=40, overlap_tokens=8, min_tokens=3).collect()
    assert [(r["section"], r["text"], r["n_tokens"]) for r in made] == markdown.Chunker(markdown.word_count, 40, 8, 3).chunks("T", markdown.sections(markdown.clean("# Do\n" + FENCED)))


def test_letters_and_references(spark):
    letters = F.array(*[F.lit(x) for x in (" b", "A", "c", "AB", "")], F.lit(None).cast("string"))
    both = F.array(F.lit("x"), F.lit("y"))
    assert value(spark, T.letter_choices(letters, both)) == ["y", "x"] and value(spark, T.unknown_letters(letters, both)) == ["c", "AB", "", None]
    for raw in ("a &amp; b &lt;p&gt; &hellip;&nbsp;&eacute;&#233;&#xe9;&#x1F600; &unknown; &amp;lt; & &; &#0; &copy", "none", "&", "&&amp;&", "", "&#xD800;"):
        assert value(spark, T.unescaped(F.lit(raw))) == unescape(raw)
    assert value(spark, F.lit("a/b.md").rlike(T.glob_pattern("a/[!a-a]*.md"))) and not value(spark, F.lit("a/b.md").rlike(T.glob_pattern("a/[!ab].md")))


def test_fresh_names():
    text = "pod web-7d9c5bf6b8-x2x4z and web-7d9c5bf6b8 in my-workloads-here"
    new = markdown.fresh_names(text)
    assert new == markdown.fresh_names(text) != text
    parts = new.split(" ")
    assert parts[1].startswith(parts[3] + "-") and new.endswith("in my-workloads-here")


def test_corpus(spark):
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("b", 1, None), ("c", 0, None)], "doc string, piece int, text string")
    kept = corpus.without_duplicates(rows, "text", ["doc", "piece"])
    got = corpus.numbered(kept, "doc", ["piece"])
    assert sorted((r["chunk_id"], r["text"]) for r in got.collect()) == [("a#000", "x"), ("a#001", "y"), ("b#000", None)]
    assert [r["text"] for r in corpus.repeated_keys(rows.where("text is not null"), "text").collect()] == ["x"]


def test_hash_order_does_not_follow_partitions(spark):
    rows = spark.range(200).withColumnRenamed("id", "x")
    order = list(range(200))
    random.Random(1).shuffle(order)
    other = spark.createDataFrame([(k,) for k in order], "x long").repartition(7)
    pick = lambda df: sorted(r["x"] for r in sampling.hash_sample(df, "x", "s", 20).collect())
    assert pick(rows) == pick(other)


def test_references_are_decoded_as_python_does(spark):
    import html

    rng = random.Random(1)
    bits = "&copy 2024|&#150;|&copy;|&notit;|&notin;|&#x80;|&#128|&#xD800;|&#0;|&#11;|&#13;|&#1114112;|&#99999999999;|&amp;amp;|&ampx|&|&&|&unknown;|&#|&#x|&#xg;|&Eacute|&eacutefoo;|&lt|&#65|&quot|a&b;c|&#65534;|&#127;|&#x000041;|&frac12x".split("|")
    rows = [(k, "".join(rng.choice([*bits, "x ", "\n", "é日"]) for _ in range(rng.randint(1, 6)))) for k in range(150)] + [(1000 + k, b) for k, b in enumerate(bits)]
    got = {r["k"]: r["u"] for r in spark.createDataFrame(rows, "k int, t string").select("k", T.unescaped(F.col("t")).alias("u")).collect()}
    assert got == {k: html.unescape(t) for k, t in rows}


def test_canonical_json_is_pythons(spark):
    import json

    kind = StructType.fromDDL("b double, a array<string>, m map<string,bigint>, z struct<y:boolean,x:string>")
    values = [0.0, 1.0, -1.5, 1e7, 12345678.9, 1e15, 1e16, 1.5e300, 1e-3, 1.5e-4, 9.9e-5, 1e-7, float("nan"), float("inf"), 0.1 + 0.2, 1 / 3, None]
    rows = [(v, [None, 'q"\\ \n\té日/'], {"b": 1, "a": None}, (True, None)) for v in values] + [(None, None, None, None), (1.0, [], {}, (None, "x"))]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(T.canonical_json(F.struct("*"), kind)).collect()]
    shown = [{"b": v, "a": a, "m": m, "z": z and {"y": z[0], "x": z[1]}} for v, a, m, z in rows]
    assert got == [json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for x in shown]


def test_cache_makes_nothing_twice(spark, tmp_path):
    path, made = str(tmp_path / "cache"), []
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, text string")

    def make(asked):
        made.extend(r["text"] for r in asked.collect())
        return asked.select("key", F.upper("text").alias("out"))

    for few, new in ((rows.where("id = 1"), ["a"]), (rows, ["b"]), (rows, [])):
        made.clear()
        got = cache.cached(few, path, "m", "text", "out string", make)
        assert {r["id"]: r["out"] for r in got.collect()} == {r["id"]: r["text"] and r["text"].upper() for r in few.collect()} and made == new
    # entries written twice, as after a run that died, come once
    cache.save(rows.where("id = 1").select(cache.key_of("m", F.col("text")).alias("key"), F.lit("A").alias("out")), path)
    assert cache.cached(rows, path, "m", "text", "out string", make).count() == 4
    # another maker's entries are others
    cache.cached(rows, path, "n", "text", "out string", make)
    assert sorted(made) == ["a", "b"]


def test_items_of_a_task(spark):
    chunks = spark.createDataFrame([("c1", "one"), ("c2", "two")], "chunk_id string, passage string")
    asked = spark.createDataFrame([("a", "How?", ["c2", "c1"]), ("b", "Why?", None)], "id string, question string, candidates array<string>")
    got = {r["id"]: r["item"] for r in queues.rendered(asked, chunks, "so_questions").collect()}
    assert got == {"a": '<item id="a">\n<question>\nHow?\n</question>\n<candidate letter="A" id="c2">\ntwo\n</candidate>\n<candidate letter="B" id="c1">\none\n</candidate>\n</item>', "b": '<item id="b">\n<question>\nWhy?\n</question>\n</item>'}
    pairs_ = spark.createDataFrame([("a", "q", "c1")], "id string, query string, chunk_id string")
    assert queues.rendered(pairs_, chunks, "train_audit").first()["item"] == '<item id="a">\n<query>q</query>\n<chunk id="c1">\none\n</chunk>\n</item>'
    with pytest.raises(Exception, match="no such chunk: c2"):
        queues.rendered(pairs_.withColumn("chunk_id", F.lit("c2")), chunks.where("chunk_id = 'c1'"), "train_audit").collect()


def test_shares_and_samples(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(20)], "id int, g string")
    assert sampling.sample_each(rows, "g", "id", "s", 3).groupBy("g").count().where("count <> 3").count() == 0
    assert sampling.seeded_share(rows, "id", "s", 0.25).count() == 5 and sampling.seeded_share(rows.limit(1), "id", "s", 0.1).count() == 1
    with pytest.raises(ValueError, match="no rows"):
        sampling.seeded_share(rows.limit(0), "id", "s", 0.25)


def test_qrels_are_counted_without_a_row_for_each(spark):
    """Queries with many, repeated and unknown documents, chunks of several documents and of none; 20,000 queries of one set
    against 20,000 chunks, which would be 400 million pairs."""
    rng = random.Random(17)
    queries = [(k % 50, [rng.choice(["a", "b", "c", "d", "no", None]) for _ in range(rng.randint(0, 4))]) for k in range(70)] + [(None, ["a"])]
    corpus = [(rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([*range(25), None])) for _ in range(40)]
    q, c = spark.createDataFrame(queries, "qid int, relevant_docs array<string>"), spark.createDataFrame(corpus, "doc_id string, chunk_id int")
    want = freeze.qrels(q, c).groupBy("qid").agg(F.count(F.lit(1)), F.min("chunk_id"), F.max("chunk_id"))
    assert sorted(map(str, map(tuple, freeze.qrel_counts(q, c).collect()))) == sorted(map(str, map(tuple, want.collect())))
    many = spark.range(20_000)
    found = freeze.qrel_counts(many.select(F.col("id").alias("qid"), F.array(F.lit("x"), F.lit("y")).alias("relevant_docs")), many.select(F.lit("x").alias("doc_id"), F.col("id").alias("chunk_id")))
    assert found.groupBy("n", "first", "last").count().collect() == [(20_000, 0, 19_999, 20_000)]


def test_a_task_leaves_each_query_no_more_than_its_best(spark):
    """k rows a query and task, however many batches; ids that are strings, ties to the smaller."""
    rng = random.Random(3)
    rows = [(f"d{k:05}", [float(rng.randint(0, 9)), 1.0]) for k in range(6000)]
    asked = [(f"q{k}", [rng.choice([-1.0, 0.0, 1.0]), 0.0]) for k in range(9)]
    docs, queries = spark.createDataFrame(rows, "doc_id string, v array<double>").coalesce(1), spark.createDataFrame(asked, "qid string, q array<double>")
    blocks = [([q for q, _ in asked], [v for _, v in asked])]
    score = lambda q, batch: np.array(q) @ np.array(batch.column("v").to_pylist()).T
    found = retrieval.ranked_batches(docs, blocks, score, 7, "string")
    want = {q: sorted(rows, key=lambda r: (-r[1][0] * v[0], r[0]))[:7] for q, v in asked}
    assert found.count() == 7 * 9
    assert {q: [r["doc_id"] for r in sorted(found.where(f"qid = '{q}'").collect(), key=lambda r: (-r["score"], r["doc_id"]))] for q, _ in asked} == {q: [d for d, _ in w] for q, w in want.items()}
    assert {(r["qid"], r["doc_id"]) for r in retrieval.dense(queries, docs, 7).collect()} == {(q, d) for q, w in want.items() for d, _ in w}


def test_metrics_of_groups_without_a_row_for_each_member(spark):
    rng = random.Random(5)
    label = {k: rng.choice([0, 1, 2, None]) for k in range(60)} | {60: 9}
    members = spark.createDataFrame([*label.items()], "doc_id long, group int")
    asked = members.where("doc_id % 4 = 0").withColumnRenamed("doc_id", "qid")
    ranks = spark.createDataFrame([(q, d, k + 1) for q in label if q % 4 == 0 and q != 8 for k, d in enumerate(rng.sample([x for x in label if x != q], 14))], "qid long, doc_id long, rank int")
    qrels = asked.join(members, "group").where("qid <> doc_id").select("qid", "doc_id")
    rounded = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    want = rounded(metrics.query_metrics(ranks, qrels))
    assert want and rounded(metrics.group_metrics(ranks, asked, members)) == want


def test_a_filter_chain_moves_no_passages(spark, tmp_path):
    """Once overlaps are there passages aren't read again, unless they are asked for."""
    rows = spark.range(40).selectExpr("id as pos", "id div 4 as chunk_id", "concat('q ', id) as query", "'how_to' as style", "concat('some passage ', id) as passage", "cast(id % 60 as int) as rt_rank", "array(cast(id as double), 1d) as v", "'a' as split")
    rows.write.parquet(str(tmp_path / "rows"))
    got = pairs.filter_chain(spark.read.parquet(str(tmp_path / "rows")))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "passage" in plan(got) and "passage" not in plan(got.select("pos", "overlap", "drop"))
    assert {*rows.columns, "overlap", "drop"} == {*got.columns} and got.count() == 40


def test_workers_hold_few_texts_at_once(spark):
    """Whatever the session's batches, those of Markdown and of an index are bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "t", "some text")], "doc_id long, title string, text string")
    for use in (lambda: docs.select(markdown.clean_markdown(F.col("text"))), lambda: docs.select(markdown.randomized(F.col("text"))), lambda: markdown.chunked(docs, []), lambda: bm25_index.bm25_top_k(docs, docs.selectExpr("doc_id as qid", "text as query"))):
        spark.conf.set(key, "10000")
        use()
        assert int(spark.conf.get(key)) <= 512
