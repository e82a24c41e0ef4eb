"""Every registered query of the library on the smallest tables, against DuckDB where there is SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from sextant.plans import derived, labels, markdown, queues, retrieval, stores, text

SF = "/root/testdata/sf0.001"
MODULES = (text, retrieval, labels, queues, derived, stores, markdown)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the synthetic tables aren't here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return f"{x:.6g}"
    return str([plain(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.R.queries])
def test_query(spark, db, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = df.collect()
    if (sql := __spark_entry__.oracle_sql().get(name)) is None:
        assert got
        return
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert sorted([plain(x) for x in r] for r in got) == sorted([plain(r[k]) for k in at] for r in found.fetchall())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns[0] == "slice" and {r["slice"] for r in rows.collect()} >= {"all"}


def agrees(spark, name, folder, made):
    """Whether a query equals its SQL over these tables, by name in SQL over the smallest ones."""
    c = duckdb.connect()
    for t, sql in made.items():
        c.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = c.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted([plain(x) for x in r] for r in found.fetchall())
    assert want and sorted([plain(x) for x in r] for r in __spark_entry__.queries()[name](spark, str(folder)).select(*names).collect()) == want


def test_only_common_references_are_decoded(spark, tmp_path):
    html = "<p>a &amp; b &amp c &am &ampd &amp;lt; &amp;amp; &lt;x&gt; &quot;q&#39; &copy; &middot; &nbsp; &eacute; &#38; &COPY;</p>end  "
    agrees(spark, "q_html_to_text", tmp_path, {"pages": f"select page_id, html || '{html.replace(chr(39), chr(39) * 2)}' as html from '{SF}/pages.parquet'"})


def test_more_batches_than_two_digits(spark, tmp_path):
    docs = f"select cast(d.doc_id + 1000 * n.range as bigint) as doc_id, 'en' as lang, source, n_chars from '{SF}/documents.parquet' d, range(60) n"
    agrees(spark, "q_missing_labels", tmp_path, {"documents": docs, "labels": f"select * from '{SF}/labels.parquet'"})


def test_logs_are_split_at_every_line_break(spark, tmp_path):
    kinds = ["click", "a\npanic b", "x\n\u00a0failed\u2003\n ", "e\nError from server: error\nok", "p\nbac\u212aoff\npermi\u017f\u017fion\r", "q\n\ttimed out\n\n", "\nunable to retrieve"]
    # a log of each kind, and logs of all kinds, some of whose events are no errors, one of them nobody's
    rows = [(k, k, kind, 20) for k, kind in enumerate(kinds)]
    rows += [(10 * u + k, u if u < 12 else "null", kind, 15 + (k + u) % 3) for u in (10, 11, 12) for k, kind in enumerate([*kinds, None])]
    rows = ", ".join(f"({i}, {u}, " + ("null" if kind is None else f"'{kind}'") + f", {v})" for i, u, kind, v in rows)
    agrees(spark, "q_error_lines", tmp_path, {"events": f"select event_id::bigint as event_id, user_id::bigint as user_id, event_type, value::double as value from (values {rows}) t(event_id, user_id, event_type, value)"})
    got = {r["user_id"]: (r["n_lines"], r["last"]) for r in __spark_entry__.queries()["q_error_lines"](spark, str(tmp_path)).collect()}
    assert got[1] == (2, "error: a\npanic b 1") and got[2] == (2, "error: x\nfailed") and got[3] == (1, "error: e") and got[4] == (3, "bacKoff\npermiſſion\r 4")
    assert got[5] == (2, "error: q\n\ttimed out") and got[6] == (1, "error:")
