"""The registered queries and the pipeline on the smallest tables, and on rows made to be awkward."""

from __future__ import annotations

import os
import random

import duckdb
import pytest

import corpus_pipeline
from sextant.llm import queries as Q
from sextant.llm.simhash import shingles
from tests.llm.test_matching import _contaminated

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the synthetic tables aren't here")


@needs_data
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    rows = Q.queries()[name](spark, SF)
    got, columns = rows.collect(), rows.columns
    assert got
    if name in Q.oracle_sql():
        db = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings", "pages"):
            db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        found = db.execute(Q.oracle_sql()[name])
        at = [[d[0] for d in found.description].index(c) for c in columns]
        text = lambda r: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
        assert sorted(map(text, got)) == sorted(text([r[k] for k in at]) for r in found.fetchall())


def _folder(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    passage = prose(30)
    rows, labels = [], []
    for k in range(240):
        lines = [prose(rng.randint(12, 40)) for _ in range(rng.randint(1, 4))]
        if k % 6 == 0:
            lines = [" ".join([rng.choice(vocabulary)] * 80)] if k % 12 else [prose(60).upper().replace(" ", "!! ")]
        elif k % 5 == 0:
            lines[0:0] = ["Share this page"]
        elif k % 7 == 0:
            lines.append(passage)
        text = "\n".join(lines)
        rows.append((k, text, "en", f"src{k % 3}", len(text)))
        if k % 3 != 1:
            labels.append((k, int(k % 6 != 0), 0))
    for k in (1, 2, 3):
        words = rows[k][1].split(" ")
        rows.append((1000 + k, rows[k][1], "en", "src1", len(rows[k][1])))
        words[len(words) // 2] = "changed"
        rows.append((2000 + k, " ".join(words), "en", "src1", 1))
    rows += [(3000, None, None, None, None), (3001, "", "en", "s", 0), (1, rows[1][1], "en", "src1", rows[1][4]), (None, prose(30), None, None, None)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, passage), (8, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, passage


def test_stages_against_brute_force(spark, tmp_path):
    path, passage = _folder(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]

    good = stage["quality classifier"](spark, docs, path).cache()
    kept = {r["doc_id"] for r in good.collect()}
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    assert all(i in kept for i, q in known.items() if q == 1) and sum(i in kept for i, q in known.items() if q == 0) <= 2
    assert not kept & {3000, 3001}

    lined = stage["line dedup"](spark, good, path).cache()
    before = {(r["doc_id"], r["text"]) for r in good.collect()}
    count: dict[str, int] = {}
    for r in good.collect():
        for x in {y.strip().lower() for y in r["text"].split("\n")}:
            count[x] = count.get(x, 0) + 1
    want = {(i, "\n".join(x for x in t.split("\n") if not x.strip() or count[x.strip().lower()] < 10)) for i, t in before}
    assert {(r["doc_id"], r["text"]) for r in lined.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in lined.collect())
    assert not any("Share this page" in t for _, t in want)

    rows = sorted({(r["doc_id"], r["text"]) for r in lined.where("doc_id is not null").collect()})
    sets = {i: set(shingles(t, 5)) for i, t in rows}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if group[a] < group[b] and (sets[a] == sets[b] or both >= 0.8 * (len(sets[a] | sets[b]))):
                    group[b], changed = group[a], True
    single = stage["SimHash near-dedup"](spark, lined, path).cache()
    assert sorted(r["doc_id"] for r in single.where("doc_id is not null").collect()) == sorted({*group.values()})
    assert single.where("doc_id is null").count() == lined.where("doc_id is null").distinct().count()

    clean = stage["benchmark decontamination"](spark, single, path).cache()
    found = _contaminated([(r["doc_id"], r["text"]) for r in single.collect()], [(7, passage)], 13)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _, _, _, bad in found if not bad}

    last = stage["BPE encoding and decoding"](spark, clean, path)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in clean.collect()}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stage[name](spark, docs.limit(0), path).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    run = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"]: r["ids_sha256"] for r in run} == {r["doc_id"]: r["ids_sha256"] for r in last.collect()}


def test_stages_on_awkward_rows(spark, tmp_path):
    """Very long texts, clashing names, nulls in all columns, ids that repeat: every stage takes what is left of them."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(6))
    long = "\n".join(" ".join(word() for _ in range(200)) for _ in range(300))
    rows = [(1, long, "en", "s", len(long)), (2, long, None, None, None), (3, None, None, None, None), (None, None, None, None, None), (None, word() * 3, "xx", "s", -1), (4, "x" * 300_000, "en", "s", 1), (5, "a b\nc", "en", "s", 5), (5, "d e\nf", "en", "s", 5), (6, " \n ", "en", "s", 3)]
    names = "doc_id long, text string, lang string, source string, n_chars long, row int, id string, KEEP int, kept_text string, hits int, fp string, score double"
    docs = spark.createDataFrame([(*r, 1, "i", 2, "k", 3, "f", 0.5) for r in rows], names)
    path = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "some words that are asked"), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        left.append(docs.count())
    # null and blank texts go with the classifier, the copy of the long text in near-dedup
    assert left == [6, 6, 5, 5, 5]
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "4", "5", "5", "None"]


def test_stages_on_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []
