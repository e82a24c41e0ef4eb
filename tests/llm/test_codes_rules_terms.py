"""Vector codes, URL rules and source divergence against brute force, on awkward rows and against SQL."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sextant.llm import divergence
from sextant.llm import url_filter as U
from sextant.llm import vector_codes as V
from sextant.llm.divergence import source_divergence
from sextant.llm.queries import ORACLES, URL_RULES

VEC = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts, entries, rounds):
    """Every part against every entry, in whole numbers of Python."""
    kept = sorted(((i, v, l) for i, v, l in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[tuple(int(np.floor(256 * float(np.float32(x)))) for x in v[p * w : p * w + w]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (dist(x, book[e]), e))
    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for c in cut:
            for p in range(parts):
                held[p][nearest(c[p], books[p])].append(c[p])
        books = [[tuple(sum(z) // len(z) for z in zip(*h, strict=True)) if h else e for h, e in zip(hs, b, strict=True)] for hs, b in zip(held, books, strict=True)]
    codes = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(dist(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes, strict=True)]
    by = Counter()
    for (_, _, l), e in zip(kept, errors, strict=True):
        by[l] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(str((i, "".join(f"{k:02x}" for k in c), e, by[l], digest)) for (i, _, l), c, e in zip(kept, codes, errors, strict=True))


def test_vector_codes_brute_force(spark):
    rng = np.random.default_rng(3)
    # few different values, so that ties and equal entries abound; some rows repeat, some lack an id or a label
    rows = [(k, (rng.integers(-3, 4, 8) / 7).tolist(), int(k % 3)) for k in range(90)]
    rows += [(5, rows[5][1], 1), (5, rows[6][1], None), (None, rows[7][1], 2), (200, None, 1), (201, [0.1] * 7 + [None], 1), (202, [float("nan")] * 8, 2), (203, [float("inf")] + [0.0] * 7, 2), (204, [0.25] * 4, 2), (205, [], 0), (-7, rows[8][1], None)]
    whole = [r for r in rows if r[1] is None or len(r[1]) == 8]
    for entries in (8, 200):
        got = V.vector_codes(spark.createDataFrame(rows, VEC).selectExpr("*", "1 as x", "2 as v", "3 as u", "4 as CODE", "5 as error"), 4, entries, 2)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(str(tuple(r)) for r in got.collect()) == plain_codes(whole, 4, entries, 2)
    few = V.vector_codes(spark.createDataFrame(whole[:1], VEC), 4, 64, 2).collect()
    assert [tuple(r)[:4] for r in few] == [(0, "00000000", 0, 0)]
    none = V.vector_codes(spark.createDataFrame([(1, None, 2)], VEC))
    assert none.count() == 0 and none.columns == got.columns
    with pytest.raises(ValueError):
        V.vector_codes(spark.createDataFrame(whole, VEC), 3)
    with pytest.raises(Exception, match="too large"):
        V.vector_codes(spark.createDataFrame([(1, [1e30] * 4, 1)], VEC), 4)


def test_bounds_spare_scans_and_keep_ties():
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, (16, 4, 4))
    x = (centres[rng.integers(0, 16, 3000)] + rng.integers(-20, 21, (3000, 4, 4))).astype(np.int64)
    x[:200] = np.rint((centres[rng.integers(0, 16, 200)] + centres[rng.integers(0, 16, 200)]) / 2)  # about halfway
    books = V.Books.of(np.ascontiguousarray(x[300:316].transpose(1, 0, 2)))
    a, u, l = V.first_assigned(x, books)
    for k in range(4):
        entries = books.entries.copy()
        for p in range(4):
            for j in range(16):
                if (a[:, p] == j).any():
                    entries[p, j] = x[a[:, p] == j, p].sum(axis=0) // (a[:, p] == j).sum()
        books = V.Books.of(entries, books.entries)
        a, u, l, scans = V.reassigned(x, a, u, l, books)
        want, upper, lower = V.first_assigned(x, books)
        assert (a == want).all() and (u >= upper / V.UP).all() and (l <= lower / V.DOWN).all()
        assert 0 < scans < a.size / (2 if k else 1)


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h.count("."), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


PAGES = "page_id long, url string"


@pytest.mark.parametrize("most", [1 << 20, 150])
def test_url_filter_brute_force(spark, most):
    """Several hundred rules over many urls, so that all levels of the cascade are met; in one cascade and in shards."""
    rng = random.Random(5)
    names = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "y", "zz", "é")]
    host = lambda n: ".".join(rng.choice(names) for _ in range(n))
    path = lambda: "".join("/" + rng.choice("pqr") for _ in range(rng.randint(0, 3)))
    rules = {(host(rng.randint(1, 2)), p, rng.choice(("block", "allow"))) for p in [path() for _ in range(500)]}
    urls = [f"{rng.choice(('http', 'HTTPS'))}://{host(rng.randint(1, 4)).upper() if k % 5 == 0 else host(rng.randint(1, 4))}{path()}{rng.choice(('', '?a=/p://x', '#/q', '/', '?'))}" for k in range(1500)]
    urls += [None, "", "://", "no scheme/ax", "mailto:a@ax", "http://", "http:///p", "http://ax", "http://ax:80/p", "x://ax.?", "http://.ax/p", "HTTP://AX/P", urls[0]]
    rows = spark.createDataFrame(list(enumerate(urls)), PAGES).repartition(5)
    out = U.url_filter(rows.selectExpr("page_id", "url", "1 as KEY", "2 as best", "3 as row", "4 as Host"), spark.createDataFrame([*rules, (None, "/", "block"), ("ax", None, "block"), ("ax", "p", "block"), ("a/x", "", "block"), ("ax", "/p", "other")], "host string, path string, action string"), most=most)
    assert out.columns == ["page_id", "url", "KEY", "best", "row", "host", "path", "rule", "verdict"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {k: judged(u, rules) for k, u in enumerate(urls)}
    assert sum(v[2] is not None for v in got.values()) > 300


def test_cascade_is_exact_and_small(spark):
    keys = spark.range(60_000).selectExpr("concat('k', id) as key").repartition(4)
    listed = keys.where("key like '%7'").unionByName(keys.where("key = 'k7'"))
    levels = U.cascade(listed, keys, 60_000)
    assert keys.where(U.member(levels, keys["key"]) != keys["key"].like("%7")).count() == 0
    assert len(levels) > 2 and 64 * sum(len(x.words) for x in levels) < 20 * 6000
    assert U.cascade(listed.limit(0), keys, 60_000) == []


def test_url_filter_without_rows_or_rules(spark):
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, action string")
    assert U.url_filter(spark.createDataFrame([], PAGES), rules).count() == 0
    out = U.url_filter(spark.createDataFrame([(1, "http://a.net/x"), (None, None)], PAGES), rules.limit(0), otherwise="unknown")
    assert sorted(tuple(r)[2:] for r in out.collect()) == [("", "", None, "unknown"), ("a.net", "/x", None, "unknown")]


def plain_divergence(rows, min_docs, top, scale):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        ws = [w.translate(fold) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        counts[lang, source].update(ws)
        df[lang].update(set(ws))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        share = lambda c: {t: 1 + scale * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        ps = {s: share(counts[lang, s]) for s in sources}
        all_ = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept), o) for o in sources if o != s]
            term = [((ps[s][t] - all_[t]) ** 2 // all_[t], t) for t in kept if counts[lang, s][t] and ps[s][t] > all_[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda z: (-z[0], z[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(out)


DOCS = "text string, lang string, source string"


@pytest.mark.parametrize("width", [32, 2])
def test_divergence_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(divergence, "WIDTH", width)
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "abcdeÉéß日" for b in ("x", "Y", "zz", "\U0001f600")] + ["it's", "a1b", "", "_", "\x00", "x y"]
    rows = [(" ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(0, 30))), rng.choice(("en", "de", "", None)), rng.choice(("a", "b", "b", "b", "é", "", None))) for _ in range(150)]
    rows += [(None, "en", "only null"), ("", "xx", "one"), ("rare", "xx", "two"), ("rare", "yy", "alone"), rows[0], ("w " * 50_000, "en", "long"), ("w", "en", "b"), ("w", "en", "a")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as term", "2 as n", "3 as p", "4 as g", "5 as item").repartition(3)
    got = source_divergence(df, 3, 4, 1000)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows, 3, 4, 1000)
    assert source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_divergence_in_pieces(spark, monkeypatch):
    """Few cells and sums at a time give the same; a task leaves a term's row for few of its cells, and a row a pair."""
    rng = random.Random(5)
    rows = [(" ".join(f"w{rng.randint(0, 9)}{c}" for c in rng.choices("abcdefghijkl", k=30)).translate(str.maketrans("0123456789", "ABCDEFGHIJ")), "en", f"s{k % 7}") for k in range(300)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for width, cells, sums in ((2, 40, 1), (32, 1 << 20, 1 << 22)):
        for name, value in (("WIDTH", width), ("CELLS", cells), ("SUMS", sums)):
            monkeypatch.setattr(divergence, name, value)
        assert sorted(tuple(r) for r in source_divergence(df, 3, 4, 1_000_000_000).collect()) == plain_divergence(rows, 3, 4, 1_000_000_000)
    cells = [(k, [(i, 1 + (k * i) % 97) for i in range(7)]) for k in range(2000)]
    dense = spark.createDataFrame([("en", f"t{k}", c, [100_000] * 7, 700_000, 2000) for k, c in cells], "lang string, term string, cells array<struct<i: int, n: long>>, totals array<long>, all long, v long").coalesce(2)
    found = divergence._contributions(dense, 4, 1_000_000_000)
    parts = dense.rdd.getNumPartitions()
    assert found.where("term is null").count() <= parts * 49 and found.where("j is null").count() <= 200 * parts
    count = np.array([10**11, 3])
    assert divergence._share(count, np.int64(10**11), 5, 10**9).tolist() == [1 + 10**9 * (n + 1) // (10**11 + 5) for n in count.tolist()]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_url_filter", "op13_source_divergence"])
def test_queries_equal_sql(spark, name, tmp_path):
    """Over small tables with nulls and repeated rows."""
    from sextant.llm.queries import queries

    rng = random.Random(8)
    hosts = ["a.net", "example.net", "w.example.com", "example.com", "b.org", "org", "x.info"]
    tables = {
        "embeddings": (VEC, [(k % 130 if k % 50 else None, [rng.gauss(0, 0.3) for _ in range(32)], rng.choice((1, 2, None))) for k in range(150)] + [(7, None, 1), (8, [None] * 32, 1), (9, [float("nan")] * 32, 1)]),
        "pages": (PAGES, [(k % 40, f"https://{rng.choice(hosts)}{rng.choice(('/en/', '/de/x', '/fr/?q', '', '/', '#/en/'))}") for k in range(80)] + [(None, None), (1, "nothing")]),
        "documents": (DOCS, [(" ".join(rng.choice("ab cd éf Gh ij9k".split()) for _ in range(rng.randint(0, 9))) if k % 9 else None, rng.choice(("en", None)), rng.choice(("s1", "s2", None))) for k in range(60)]),
    }
    db = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
        db.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = queries()[name](spark, str(tmp_path))
    found = db.execute(ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in df.columns]
    got = sorted(str(tuple(r)) for r in df.collect())
    assert got
    assert got == sorted(str(tuple(r[k] for k in at)) for r in found.fetchall())
