"""Readers, writers and the label stream on temporary folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sextant.sources import readers, sinks
from sextant.streaming.labels import current, keep_latest, label_stream

LABEL = "id string, verdict string, pos long"


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2}\n\n  \n{"id": "2"}\n')
    got = readers.jsonl(spark, str(tmp_path), "id string, n int").collect()
    assert sorted((r["id"], r["n"]) for r in got) == [("1", 2), ("2", None)] and got[0]["path"].endswith("a.jsonl")
    for bad in ("[1]\n", "{x}\n"):
        (tmp_path / "b.jsonl").write_text(bad)
        with pytest.raises(Exception, match=r"b\.jsonl"):
            readers.jsonl(spark, str(tmp_path), "id string").collect()
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n\n' * 3 + "oops\n" + '{"id": "2"}\n[1]\n')
    found = {(r["path"][-7:], r["line"], r["value"]) for r in readers.jsonl_problems(spark, str(tmp_path)).collect()}
    assert found == {("b.jsonl", 7, "oops"), ("b.jsonl", 9, "[1]")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "11")
    try:
        with pytest.raises(ValueError, match=r"b\.jsonl:7: oops; .*b\.jsonl:9: \[1\]"):
            readers.jsonl(spark, str(tmp_path), "id string", check=True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert readers.optional_jsonl(spark, str(tmp_path / "none"), "id string").collect() == []


def test_corpus_keys(spark, tmp_path):
    row = {"chunk_id": "a#000", "doc_id": "a", "text": "t"}
    (tmp_path / "c.jsonl").write_text(json.dumps(row) + "\n")
    assert readers.corpus(spark, str(tmp_path)).first()["doc_id"] == "a"
    (tmp_path / "d.jsonl").write_text(json.dumps(row) + "\n")
    with pytest.raises(ValueError, match="a#000"):
        readers.corpus(spark, str(tmp_path))


def test_markdown_tree(spark, tmp_path):
    for name in ("a/b.md", "a/_index.md", "a-b/a.md", "draft/x.md", "a/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# " + name)
    got = readers.markdown_tree(spark, str(tmp_path), exclude=["draft/*"]).orderBy("pos").collect()
    assert [(r["path"], r["doc_id"]) for r in got] == [("a/_index.md", "a"), ("a/b.md", "a/b"), ("a-b/a.md", "a-b/a")]
    (tmp_path / "a/b.md").write_text("---\ntitle: 'Drain a node'\nweight: 3\n---\nbody\n")
    got = {r["path"]: (r["title"], r["text"]) for r in readers.markdown_tree(spark, str(tmp_path), include=["a/*"]).collect()}
    assert got == {"a/_index.md": (None, "# a/_index.md"), "a/b.md": ("Drain a node", "body\n")}
    with pytest.raises(FileNotFoundError, match="gone"):
        readers.markdown_tree(spark, str(tmp_path), include=["a/*", "gone/*"])


def test_captures_csv_and_fingerprints(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"id": "c", "status": "ok", "sections": [{"title": "pods", "command": "c", "output": "o"}]}, indent=1))
    assert readers.captures(spark, str(tmp_path / "x.json")).first()["sections"][0]["title"] == "pods"
    (tmp_path / "r.csv").write_text("slice,n\nall,3\nown,1\n")
    assert [r["n"] for r in readers.csv_results(spark, str(tmp_path / "r.csv"), "slice string, n int", "all").collect()] == [3]
    import hashlib

    assert readers.fingerprints(spark, str(tmp_path / "r.csv")).first()["sha256"] == hashlib.sha256((tmp_path / "r.csv").read_bytes()).hexdigest()


def test_scenarios(spark):
    texts = {"a.yaml": '{"id": "a", "expect": ["x"]}', "_base.yaml": "not: read"}
    assert [r["id"] for r in readers.scenarios(spark, texts, "id string, expect array<string>").collect()] == ["a"]
    with pytest.raises(ValueError, match="more than once"):
        readers.scenarios(spark, {"a": '{"id": "a"}', "b": '{"id": "a"}'}, "id string")


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", "correct", 1), ("b", "wrong", 2)], LABEL)
    assert sinks.write_jsonl(rows, str(tmp_path / "j")) == 2 and sinks.write_jsonl(rows.limit(1), str(tmp_path / "j")) == 1
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    sinks.append_labels(rows.select("id", "verdict"), str(tmp_path / "log"))
    sinks.append_labels(rows.select("id", "verdict"), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and log.where(~F.col("labeled_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$")).count() == 0
    with pytest.raises(ValueError, match="columns"):
        sinks.append(rows, str(tmp_path / "log"))


def test_metric_table(spark, tmp_path):
    rows = spark.createDataFrame([("zeta", 1, *[0.5] * 5), ("all", 3, *[1 / 3] * 5)], "slice string, n long, hit_1 double, hit_5 double, hit_10 double, mrr_10 double, ndcg_10 double")
    sinks.write_metrics(rows, str(tmp_path / "m"), "test", "bm25")
    (name,) = (tmp_path / "m").glob("*.csv")
    lines = name.read_text().splitlines()
    assert lines[0].startswith("split,ranker,slice,n,hit_1") and lines[1] == "test,bm25,all,3," + ",".join(["0.3333"] * 5) and lines[2].startswith("test,bm25,zeta")
    assert "| all | 3 |" in sinks.report(rows.select("slice", "n"), "Results")


def test_slices_have_their_order(spark):
    kind = "slice string, n long, hit_1 double, hit_5 double, hit_10 double, mrr_10 double, ndcg_10 double"
    names = ["other", "stackoverflow", "how_to", "real_incident_seen", "symptom", "all", "low_overlap"]
    got = sinks.metric_table(spark.createDataFrame([(s, 1, *[0.0] * 5) for s in names], kind), "val", "bm25").collect()
    assert [r["slice"] for r in got] == ["all", "symptom", "how_to", "low_overlap", "real_incident_seen", "stackoverflow", "other"]


def test_text_is_replaced(spark, tmp_path):
    for text in ("one", "two\né"):
        sinks.write_text(spark, str(tmp_path / "r" / "report.md"), text)
        assert (tmp_path / "r" / "report.md").read_text() == text
    assert [p.name for p in (tmp_path / "r").iterdir() if not p.name.endswith(".crc")] == ["report.md"]


def test_frozen(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = spark.createDataFrame([("a", "correct", 1), ("b", None, 2)], LABEL)
    assert {r["name"]: r["rows"] for r in sinks.freeze({"labels": rows, "none": rows.limit(0)}, path).collect()} == {"labels": 2, "none": 0}
    assert sinks.verify(spark, path) == []
    with pytest.raises(FileExistsError):
        sinks.freeze({"labels": rows}, path)
    rows.limit(1).write.mode("overwrite").parquet(f"{sinks.frozen_folder(spark, path)}/labels")
    spark.catalog.clearCache()
    assert sinks.verify(spark, path) == ["labels"]


def test_frozen_set_is_all_or_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "f")
    rows = spark.createDataFrame([("a", "how_to"), ("b", "how_to"), ("c", None)], "qid string, slice string")
    done = {r["name"]: r["slices"] for r in sinks.freeze({"queries": rows, "rel": rows.select("qid")}, path).collect()}
    assert done == {"queries": {"how_to": 2, "": 1}, "rel": None}
    broken = rows.select(F.when(F.col("qid") == "c", F.raise_error(F.lit("killed"))).otherwise(F.col("qid")).cast("string").alias("qid"))
    with pytest.raises(Exception, match="killed"):
        sinks.freeze({"queries": rows.limit(1), "rel": broken}, path, force=True)
    monkeypatch.setattr(sinks, "write_text", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        sinks.freeze({"queries": rows.limit(1)}, path, force=True)
    monkeypatch.undo()
    assert sinks.frozen(spark, path, "queries").count() == 3 and sinks.frozen(spark, path, "rel").count() == 3 and sinks.verify(spark, path) == []
    sinks.freeze({"queries": rows.limit(1)}, path, force=True)
    assert sinks.frozen(spark, path, "queries").count() == 1 and [r["name"] for r in sinks.manifest(spark, path).collect()] == ["queries"]


def test_runbooks_tell_all_errors_at_once(spark, tmp_path):
    good = "---\ntitle: Out of memory\nrelated: [node-down]\n---\n## Symptoms\n" + "word " * 10 + "\n## Fix\nraise it"
    (tmp_path / "oom-killed.md").write_text(good)
    (tmp_path / "node-down.md").write_text(good.replace("[node-down]", "oom-killed, 'node-down'").replace("Out of", "'Out of'"))
    got = {r["id"]: (r["title"], r["related"]) for r in readers.runbooks(spark, str(tmp_path), ["Symptoms", "Fix"], 8).collect()}
    assert got == {"oom-killed": ("Out of memory", ["node-down"]), "node-down": ("'Out of' memory", ["oom-killed", "node-down"])}
    (tmp_path / "Bad_Name.md").write_text("# Title\n## Fix\nshort")
    (tmp_path / "_index.md").write_text(good.replace("node-down", "gone"))
    with pytest.raises(ValueError) as e:
        readers.runbooks(spark, str(tmp_path), ["Symptoms", "Fix"], 8)
    said = str(e.value).splitlines()
    assert [x.strip() for x in said[1:]] == ["Bad_Name: name", "Bad_Name: no title", "Bad_Name: sections", "Bad_Name: title", "Bad_Name: words", "_index: name", "_index: related runbook 'gone' does not exist"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no runbooks"):
        readers.runbooks(spark, str(tmp_path / "none"), ["Fix"])


def test_tracked(spark, tmp_path):
    path = str(tmp_path / "runs")
    with sinks.tracked(spark, path, "one", {"b": 1}, "3", 42) as metrics:
        metrics["hit"] = 0.5
        metrics["notes"] = "fine"
    with pytest.raises(KeyError), sinks.tracked(spark, path, "two", {}):
        raise KeyError("x")
    got = {r["name"]: r for r in spark.read.parquet(path).collect()}
    assert got["one"]["status"] == "ok" and json.loads(got["one"]["metrics"]) == {"hit": 0.5} and got["two"]["status"] == "failed:KeyError"
    assert (got["one"]["phase"], got["one"]["seed"], got["one"]["notes"], got["two"]["seed"]) == ("3", 42, "fine", None)
    assert got["one"]["driver_mb"] > 10 and got["one"]["run_id"] != got["two"]["run_id"] and (got["one"]["commit"] is None or len(got["one"]["commit"]) == 40)


def test_label_stream_equals_batch(spark, tmp_path):
    log, table, seen = (str(tmp_path / x) for x in ("log", "table", "seen"))
    rows = [("a", "wrong", 1), ("b", "correct", 2), ("a", "correct", 3), ("c", "wrong", 4), ("b", "wrong", 5)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], LABEL).coalesce(1).write.mode("append").json(log)
        if k in (1, 4):
            keep_latest(label_stream(spark, log, LABEL, 1), table, seen, ["id"], ["pos"]).awaitTermination()
    got = {r["id"]: r["verdict"] for r in current(spark, table).collect()}
    assert got == {"a": "correct", "b": "wrong", "c": "wrong"}


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    """A batch of one label writes one bucket; the same batch again, as after a failure, gives the same table."""
    log, table, seen = (str(tmp_path / x) for x in ("log", "table", "seen"))
    spark.createDataFrame([(f"i{k}", "wrong", k) for k in range(200)], LABEL).coalesce(1).write.mode("append").json(log)
    keep_latest(label_stream(spark, log, LABEL, 1), table, seen, ["id"], ["pos"], 8).awaitTermination()
    assert len(list((tmp_path / "table" / "version=0").glob("bucket=*"))) == 8
    spark.createDataFrame([("i7", "correct", 500)], LABEL).coalesce(1).write.mode("append").json(log)
    keep_latest(label_stream(spark, log, LABEL, 1), table, seen, ["id"], ["pos"], 8).awaitTermination()
    assert len(list((tmp_path / "table" / "version=1").glob("bucket=*"))) == 1
    first = sorted(map(tuple, current(spark, table).collect()))
    assert len(first) == 200 and ("i7", "correct", 500) in first
    # the second batch is committed no more, and half of what it wrote is there without the mark of a whole one
    for name in ("1", ".1.crc"):
        (tmp_path / "seen" / "commits" / name).unlink(missing_ok=True)
    (tmp_path / "table" / "version=1" / "_SUCCESS").unlink()
    assert ("i7", "wrong", 7) in [tuple(r) for r in current(spark, table).collect()]
    keep_latest(label_stream(spark, log, LABEL, 1), table, seen, ["id"], ["pos"], 8).awaitTermination()
    assert sorted(map(tuple, current(spark, table).collect())) == first
