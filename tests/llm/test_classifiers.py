"""Extraction, licenses, quality, languages and neighbours: literal cases, brute force, held-out accuracy."""

from __future__ import annotations

import random
import re
import time
from html import unescape
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sextant.llm import ann, langid, licenses, quality
from sextant.llm.html_extract import extract, extract_text, smoothed, threshold

DOC = "doc_id long, text string"

PAGES = {
    "<body><header><h1>Site</h1></header><main><article><header><h1>Title &amp; co</h1><p>by me</p></header><p>Text&nbsp;one<br>two   three</p><aside>x</aside><section class='comments'><p>hello</p></section></article></main><div class='cookie-notice'>We use cookies</div></body>": "Title & co\nText one two three",
    "<div class='sidebar'><p>menu</p></div><div id=content><p>Long paragraph of text here that goes on and on with many words.</p><p>Short.</p><ul><li>item one of list</li></ul></div><div class='comments'><p>A very long comment which should not be there at all, no, not at all.</p></div><footer>f</footer>": "Long paragraph of text here that goes on and on with many words.\nShort.\nitem one of list",
    "<nav><ul><li><a href=/>home</a></ul></nav><div class=ad>Buy<article><h1>T</h1><p><b>First.<br><p>Second &lt;3</p><script>var x='</p>'</script><form><p>mail</p></form></article>": "T\nFirst.\nSecond <3",
    "just text, no tags &eacute;": "just text, no tags é",
    "<article><p>Cut off te": "Cut off te",
    "<div class='site-header'>Site</div><article><div class='post-header'><h2>Head</h2></div><p>One <span class='comment'>two</span></p><div id='replyBox'>x</div></article>": "Head\nOne two",
    "<p>a<p>b</p": "a\nb",
    "": "",
    "<style>p{}</style><script>x": "",
}


def test_pages():
    for html, want in PAGES.items():
        assert "\n".join(extract(html)) == want


def test_extract_query(spark):
    rows = [(k, None if k % 2 else f"u{k}", h, "x") for k, h in enumerate(PAGES)] + [(90, "u", None, "x"), (0, "again", "<p>" + "word " * 50_000, "x")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got} == {(i, u, t := "" if h is None else "\n".join(extract(h)), len(t)) for i, u, h, _ in rows}
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_smoothing_and_threshold():
    assert np.allclose(smoothed(np.ones(7)), 1) and np.allclose(smoothed(np.array([3.0])), 3)
    assert 2 < threshold(np.array([1.0, 1, 2, 19, 20])) < 19
    assert threshold(np.array([9.0, 10, 12])) == -1 and threshold(np.array([5.0])) == -1 and threshold(np.zeros(3)) == -1


def _everything(values):
    return -1.0


MENU = "<div><a href=1>Home</a> <a href=2>News</a></div>"
LONG, SHORT = "Some words of a paragraph that goes on for a while. " * 8, "Short."


def test_clusters_decide():
    """With one cluster for all lines other regions are selected, with an article and without one."""
    no_article = f"<body>{MENU}<div>Imprint of the house</div><h1>Title</h1><div><p>{LONG}</p><p>{SHORT}</p></div><div><p>{SHORT}</p></div><div><p>{LONG}</p></div><div>All rights reserved</div></body>"
    assert extract(no_article) == ["Title", LONG.strip(), SHORT, SHORT, LONG.strip()]
    assert len(extract(no_article, _everything)) == 7
    article = f"<body><article><p>{LONG}</p><div class='share-buttons'>Tell all your friends</div><p>{SHORT}</p></article><article><p>Teaser</p></article></body>"
    assert extract(article) == [LONG.strip(), SHORT]
    assert len(extract(article, _everything)) == 4


def test_classes_are_a_feature_only():
    for name in ("related-work", "notice-of-results", "replies-model", "ad-hoc methods", "commentary"):
        page = f"<body>{MENU}<article><h1>T</h1><p>{LONG}</p><section class='{name}' id='{name}'><h2>Part</h2><p>{LONG}</p><p>{SHORT}</p></section></article></body>"
        assert extract(page) == ["T", LONG.strip(), "Part", LONG.strip(), SHORT], name
    for name in ("ad", "comments", "comment-list", "relatedPosts", "newsletter-signup box"):
        page = f"<body><article><p>{LONG}</p><div class='{name}'><p>{LONG}</p><p>{SHORT}</p></div><p>{SHORT}</p></article></body>"
        assert extract(page) == [LONG.strip(), SHORT], name
    # the only text of a page is its text, whatever the class
    assert extract(f"<div class=widget><p>{LONG}</p></div>") == [LONG.strip()]


def test_deep_and_long_pages_take_linear_time():
    deep = "<div><b><p>" * 20_000 + LONG + "</i></section>" * 20_000
    many = "".join(f"<div><p>{LONG}{k}</p></div>" for k in range(5000))
    began = time.perf_counter()
    assert extract(deep) == [LONG.strip()] and len(extract(many)) == 5000
    assert time.perf_counter() - began < 10


class _Tree(HTMLParser):
    """A slow and simple reading of well-formed pages: a tree, from which everything is looked up anew."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.nodes, self.stack, self.text, self.tags, self.found = [("", "", None)], [0], [], 0, []
        self.feed(html)
        self.close()
        self.cut()

    def chain(self, n):
        return [] if n is None else [n, *self.chain(self.nodes[n][2])]

    def cut(self):
        words = " ".join("".join(t for t, _ in self.text).split())
        if words:
            linked = sum(len(t) for t, n in self.text if any(self.nodes[x][0] == "a" for x in self.chain(n)))
            self.found.append((words, self.tags, linked, self.stack[-1]))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in ("a", "b", "br"):
            self.cut()
        if tag == "br":
            self.text.append((" ", self.stack[-1]))
        else:
            self.nodes.append((tag, dict(attrs).get("class", ""), self.stack[-1]))
            self.stack.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in ("a", "b"):
            self.cut()
        self.stack.pop()

    def handle_data(self, data):
        if not any(self.nodes[n][0] in ("nav", "footer", "script", "title", "form", "aside", "head") for n in self.chain(self.stack[-1])):
            self.text.append((data, self.stack[-1]))

    def main_text(self):
        against = lambda n: max((x for x in self.chain(n) if self.nodes[x][1] in ("ad", "comments")), default=None)
        article = lambda n: min((x for x in self.chain(n) if self.nodes[x][0] == "article"), default=None)
        lines = [(t, (len(t) - linked) / max(1, tags) * (0.02 if against(n) else 4 if article(n) else 1), n) for t, tags, linked, n in self.found]
        smooth = []
        for k, (_, _, n) in enumerate(lines):
            flow = [j for j, x in enumerate(lines) if (against(x[2]) or article(x[2])) == (against(n) or article(n))]
            at = flow.index(k)
            near = [(np.exp(-((at - i) ** 2) / 2), lines[j][1]) for i, j in enumerate(flow) if abs(at - i) <= 2]
            smooth.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        cut = threshold(np.array(smooth)) if lines else 0
        strong = {against(n) for (_, _, n), v in zip(lines, smooth) if v > cut}
        roots = {article(n) for (_, _, n), v in zip(lines, smooth) if v > cut and (not against(n) or against(n) in strong)} - {None}
        return [t for t, _, n in lines if article(n) in roots and (not against(n) or against(n) in strong)]


def test_extraction_equals_a_slow_tree():
    rng = random.Random(11)
    words = lambda n: " ".join(rng.choice(["word", "text", "&amp;", "né"]) for _ in range(rng.randint(1, n)))
    some = 0
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 4)):
            inner = "".join(
                rng.choice(["<p>{}</p>", "<p><b>{}</b><br>x</p>", "<div class='ad'>{}</div>", "<div class='comments'><p>{}</p></div>", "<section><h2>{}</h2></section>", "<aside>{}</aside>", "<ul><li><a href='x'>{}</a></li></ul>", "<script>{}</script>"]).format(words(rng.choice([3, 60])))
                for _ in range(rng.randint(0, 6))
            )
            parts.append(rng.choice(["<article>{}</article>", "<article>{}</article>", "<nav>{}</nav>", "<footer>{}</footer>"]).format(inner))
        page = "<html><head><title>t</title></head><body>" + "".join(parts) + f"<article><p>{LONG}</p></article></body></html>"
        want = _Tree(page).main_text()
        assert extract(page) == want
        some += len(want) > 2
    assert some > 50


def test_given_pages_lose_nothing():
    """Of the given pages: every block of the article, and nothing else."""
    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        body = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1]
        blocks = [re.sub(r"<br>", " ", re.sub(r"</?b>", "", b)) for b in re.split(r"</?(?:h1|p)>", body)]
        assert extract(r["html"]) == [" ".join(unescape(b).split()) for b in blocks if b.strip()]


def test_license_scan_equals_exact_containment(spark):
    rng, rows = random.Random(1), []
    words = [w for _, t in licenses.TEMPLATES for w in t.split()] + ["a", "the", "é", "of"]
    for k in range(80):
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(licenses.TEMPLATES)[1].split()
            if len(t) > 12 and rng.random() < 0.5:
                t[rng.randrange(len(t))] = "CHANGED"
            at = rng.randint(0, len(text))
            text[at:at] = t
        rows.append((k, rng.choice([" ", "\n", " - "]).join(text)))
    rows += [(200, None), (201, ""), (202, "mit"), (3, rows[3][1]), (203, "x " * 5000 + licenses.TEMPLATES[0][1])]
    rows += [(None, licenses.TEMPLATES[0][1]), (None, "so " + licenses.TEMPLATES[0][1]), (None, licenses.TEMPLATES[2][1])]
    # ties: the same notice twice in a text; a body under another title; many copies
    rows += [(210, f"{licenses.TEMPLATES[3][1]} and {licenses.TEMPLATES[3][1]}"), (211, "My own license\n\n" + dict(licenses.TEMPLATES)["mit-text"].replace("AUTHORS", "MAKERS"))] + [(212, licenses.TEMPLATES[0][1])] * 3
    got = licenses.license_scan(spark.createDataFrame([(*r, 1) for r in rows], DOC + ", template int")).collect()
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    want = db.execute(licenses.oracle()).fetchall()
    assert sorted((str(r["doc_id"]), r["template"], round(r["containment"], 9), r["word"]) for r in got) == sorted((str(a), b, round(c, 9), d) for a, b, c, d in want) and len(want) > 40
    assert {r["template"] for r in got if r["doc_id"] == 211} >= {"mit-text", "mit-permission"} and sum(r["doc_id"] is None for r in got) == 3
    assert licenses.license_scan(spark.createDataFrame([], DOC)).collect() == []
    assert licenses.collision_probability(0.4) > 0.9999999
    with pytest.raises(ValueError, match="words"):
        licenses.license_scan(spark.createDataFrame([], DOC), (("short", "four words are few"),))


SYLLABLES = {"xa": "ka ri to mu sen pal".split(), "xb": "sch ung ver ein lich ach".split(), "xc": "eau oux ille ment ais que".split()}


def _languages(rng, n):
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40))]
        rows.append((k, " ".join(words), lang))
    return rows


def test_language_id(spark):
    rows = _languages(random.Random(2), 300)
    held = F.col("doc_id") % 3 == 0
    extra = [(900, None, "xa"), (901, "", "xb"), (902, "12 !", None), (903, "Kari Tomu", None), (904, "x", "xc")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + extra], DOC + ", lang string, score double")
    got = {r["doc_id"]: r for r in langid.language_id(df, ~held).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang in rows if i % 3 == 0]
    assert np.mean(right) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and got[903]["lang_pred"] == "xa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # labels of rows held out change nothing
    other = df.withColumn("lang", F.when(held, "xa").otherwise(F.col("lang")))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.language_id(other, ~held).collect()} == {i: r["lang_pred"] for i, r in got.items()}
    nothing = langid.language_id(df, F.lit(False)).select("lang_pred").distinct().collect()
    assert [r["lang_pred"] for r in nothing] == ["und"]
    assert langid.language_id(spark.createDataFrame([], DOC + ", lang string"), ~held).collect() == []


def _bundle(text, dimensions, seed):
    """Letter by letter: the sum over all places of the product of rotated letter vectors."""
    letters, out = re.sub(r"[\W\d_]+", " ", text.lower()).strip(), np.zeros(dimensions)
    space = langid.Space(dimensions, seed)
    padded = f" {letters} "
    for k in range(len(padded) - 2):
        v = np.ones(dimensions)
        for back in range(3):
            letter = space.letter(ord(padded[k + 2 - back])).astype(float)
            v *= np.concatenate([letter[dimensions - back :], letter[: dimensions - back]])
        out += v
    return out


def test_language_id_equals_brute_force(spark):
    """Prototypes and cosines against sums over all letters of all texts, one after another; ties go to the first name."""
    rows = _languages(random.Random(9), 90) + [(500, "Ébène, l'été", "xc"), (501, "twin", "ya"), (502, "twin", "yb"), (503, "twin", "xa"), (504, "a " * 3000, "xb")]
    train = [r for r in rows if r[0] % 3]
    names = sorted({r[2] for r in train})
    unit = {n: (v := sum(_bundle(t, 96, 4) for _, t, g in train if g == n)) / np.linalg.norm(v) for n in names}
    common = sum(unit.values()) / (2 * len(unit))
    df = spark.createDataFrame(rows, DOC + ", lang string").repartition(3)
    got = {r["doc_id"]: r for r in langid.language_id(df, F.col("doc_id") % 3 > 0, 96, 4).collect()}
    for i, text, _ in rows:
        v = _bundle(text, 96, 4)
        cos = [float(v @ (p := unit[n] - common)) / np.linalg.norm(p) / np.linalg.norm(v) for n in names]
        best = max(cos)
        assert abs(got[i]["score"] - max(0.0, best)) < 1e-6
        assert got[i]["lang_pred"] in [n for n, c in zip(names, cos) if c > best - 1e-6]
    twins = spark.createDataFrame([(1, "same words here", "zb"), (2, "same words here", "za"), (3, "same words", None)], DOC + ", lang string")
    assert {r["lang_pred"] for r in langid.language_id(twins, F.lit(True), 96, 4).collect()} == {"za"}


def test_grams_do_not_depend_on_batches():
    one, two = langid.Space(64), langid.Space(64)
    codes, counts = langid.grams("Été, hiver; l'été!")
    two.bundle(*langid.grams("anything else before"))
    assert np.array_equal(one.bundle(codes, counts), two.bundle(codes, counts))


def _quality_rows(rng, n):
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        bad = k % 4 == 0
        text = [" ".join(words[:1] * 60), " ".join(w.upper() + "!!" for w in words), " ".join(w + "###" for w in words)][k % 3] if bad else ". ".join(" ".join(words[i : i + 8]).capitalize() for i in range(0, len(words), 8))
        rows.append((k, text, "en", f"s{k % 5}", len(text), "kept"))
        if k % 2 == 0:
            labels.append((k, 0 if bad else 1, 0))
    return rows, labels


def test_quality(spark):
    rows, labels = _quality_rows(random.Random(3), 600)
    rows += [(9000, None, None, None, None, None), (9001, " \n", "en", "s1", 2, "b"), (9002, "word", None, None, -5, "c"), (1, rows[1][1], "en", "s1", 9, "again")]
    rows = [(*r, 1, 2) for r in rows]
    schema = DOC + ", lang string, source string, n_chars long, keep string, row int, SCORE int"
    table = spark.createDataFrame(labels + [(None, 1, 0), (2, 0, 0), (2, 1, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, schema)
    found = quality.quality_scores(df, table)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "score", "content_score", "meta_score", "keep"]
    got = found.collect()
    assert len(got) == len(rows)
    unseen = [(r["keep"], r["doc_id"] % 4 != 0) for r in got if r["doc_id"] < 9000 and r["doc_id"] % 2]
    assert np.mean([a == b for a, b in unseen]) > 0.97
    bad = [r["keep"] for r in got if r["doc_id"] < 9000 and r["doc_id"] % 4 == 0]
    assert np.mean(bad) < 0.05
    assert all(r["score"] == 0 and not r["keep"] for r in got if r["doc_id"] in (9000, 9001))
    nothing = quality.quality_scores(df, table.where("quality = 1")).where("doc_id < 9000")
    assert nothing.where("score <> 1").count() == 0
    assert quality.quality_scores(df.limit(0), table).collect() == []


def test_pseudo_labels_help():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 1200)
    x = tuple(np.c_[y + rng.normal(0, s, 1200), rng.normal(0, 1, (1200, 4))].astype(np.float32) for s in (0.35, 0.35))
    given, rest = tuple(m[:60] for m in x), tuple(m[60:] for m in x)
    model = quality.co_train(given, y[:60], lambda views: quality.guesses(views, rest, 0.9))
    alone = quality.co_train(given, y[:60], lambda views: {})
    score, one, _ = model.scores(*rest)
    right = lambda p: np.mean((p > 0.5) == y[60:])
    assert right(score) > right(one) > 0.85 and right(score) >= right(alone.scores(*rest)[0])


def test_sums_of_parts_are_sums_of_all():
    rng = np.random.default_rng(7)
    x = tuple(rng.normal(0, 1, (500, 6)).astype(np.float32) for _ in range(2))
    views = tuple(quality.View(np.zeros(6), np.ones(6), rng.normal(0, 3, 7)) for _ in range(2))
    whole, parts = quality.guesses(views, x, 0.8), {}
    for k in range(0, 500, 37):
        quality.added(parts, quality.guesses(views, tuple(m[k : k + 37] for m in x), 0.8))
    assert whole.keys() == parts.keys() and len(whole) > 20
    assert all(whole[k][0] == parts[k][0] and np.allclose(whole[k][1], parts[k][1]) for k in whole)
    # every document that a view is sure of counts, once
    for taught in (0, 1):
        p = 1 / (1 + np.exp(-views[1 - taught].raw(x[1 - taught])))
        assert sum(n for k, (n, _) in whole.items() if k[0] == taught) == ((p >= 0.8) | (p <= 0.2)).sum()


def test_quality_equals_one_machine(spark):
    """The distributed fit and scores against all features in one matrix, and pseudo-labels found document by document."""
    rows, labels = _quality_rows(random.Random(5), 500)
    rows += [(7000 + k, *rows[k][1:]) for k in range(0, 200, 3)]
    labels = labels[:120]
    y_of = {i: q for i, q, _ in labels}
    x = quality.features([r[1:5] for r in rows])
    at = [k for k, r in enumerate(rows) if r[0] in y_of]
    rest = [k for k in range(len(rows)) if rows[k][0] not in y_of]

    def ask(views):
        out = {}
        for k in rest:
            quality.added(out, quality.guesses(views, tuple(m[k : k + 1] for m in x), 0.9))
        return out

    model = quality.co_train(tuple(m[at] for m in x), np.array([y_of[rows[k][0]] for k in at]), ask)
    want = {r[0]: s for r, s in zip(rows, model.scores(*x)[0], strict=True)}
    df = spark.createDataFrame(rows, DOC + ", lang string, source string, n_chars long, keep string").repartition(5)
    got = quality.quality_scores(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sure=0.9).collect()
    assert len(got) == len(rows) and max(abs(r["score"] - want[r["doc_id"]]) for r in got) < 1e-4
    assert quality.guesses((model.content, model.meta), x, 0.9)


def test_balanced_parts():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((640, 8)) + 4 * rng.integers(0, 2, (640, 1))
    near = ann.neighbours(x, 8)
    label = ann.partition(near, 8)
    assert np.bincount(label).max() - np.bincount(label).min() <= 2
    cut = (label[near] != label[:, None]).mean()
    assert cut < 0.75  # of random parts, seven eighths of the links are cut


def _vectors(rng, n, width=16):
    return [(k, (rng.standard_normal(width) + 2 * np.eye(width)[k % width]).astype(np.float32).tolist()) for k in range(n)]


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = _vectors(rng, 900)
    rows += [(1000 + k, rows[20][1]) for k in range(60)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 15 + [None]), (2080, [float("inf")] * 16), (2100, [1.0, 2.0]), (None, rows[0][1]), (20, rows[20][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, rank int")
    got = ann.ann_search(df, F.col("vec_id") % 20 == 0, k=20, sample=400, parts=8, recall=0.97, candidates=100, queries=7).collect()
    x, ids = np.array([v for _, v in rows], np.float64), np.array([i for i, _ in rows])
    hits, n = 0, 0
    for q in ids[ids % 20 == 0]:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        s = np.einsum("d,cd->c", x[ids == q][0], x)
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(abs(v - s[ids == i][0]) < 1e-12 for _, i, v in mine)
        hits += len({i for _, i, _ in mine} & set(ids[order].tolist()))
        n += 20
    assert hits / n >= 0.9
    # sixty copies tie: the smaller ids come first
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 20), key=lambda r: r["rank"])] == list(range(1000, 1020))
    assert {r["query_id"] for r in got} == set(ids[ids % 20 == 0].tolist())


def test_clustered_vectors_need_few_probes(spark):
    """Each query is compared with a small share of all vectors, and finds its neighbours by brute force."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((64, 24)) * 3
    x = centres[rng.integers(0, 64, 6000)] + rng.standard_normal((6000, 24)) * 0.6
    x /= np.linalg.norm(x, axis=1)[:, None]
    made = []
    fit = ann.fit
    ann.fit = lambda *a: made.append(fit(*a)) or made[-1]
    try:
        got = ann.ann_search(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20, sample=3000).collect()
    finally:
        ann.fit = fit
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    s = x[::20] @ x.T
    s[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(found[20 * k] & set(b.tolist())) / 20 for k, b in enumerate(best)]) >= 0.9
    assert len(made[0].last) == 32 and made[0].probes <= 8


def test_parts_grow_with_the_vectors():
    assert [ann.parts_for(n) for n in (0, 1, 7, 8, 100, 200, 10_000, 262_144, 10**6, 10**7, 10**9)] == [1, 1, 1, 2, 16, 32, 32, 32, 64, 1024, 2048]


@pytest.mark.parametrize("n", [1, 2, 9, 21, 22, 60, 130])
def test_small_tables_lose_no_candidate(spark, n):
    """There are always min(k, n - 1) found, whatever the parts hold."""
    rows = _vectors(np.random.default_rng(n), n)
    got = ann.ann_search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=20).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == ({q: min(20, n - 1) for q in range(0, n, 20)} if n > 1 else {})


def test_products_that_overflow(spark):
    rows = [(0, [1e200, 1e200]), (1, [-1e200, -1e200]), (2, [1e200, -1e200]), (3, [1.0, 0.0]), (4, [-1e200, 1e200])]
    got = ann.ann_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got][:1] == [3] and {r["vec_id"] for r in got} == {1, 2, 3, 4} and got[0]["score"] == 1e200


def test_few_neighbours(spark):
    kind = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.5])], kind)
    got = sorted(tuple(r) for r in ann.ann_search(few, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, -1.0)]
    assert ann.ann_search(spark.createDataFrame([], kind), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.ann_search(spark.createDataFrame([(0, [1.0])], kind), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("block", ["<div>{}</div>", "<section><p>{}</p></section>", "<table><tr><td>{}</td></tr></table>"])
def test_blocks_without_an_article_all_stay(block):
    texts = ["long words " * 60, "fewer words " * 34, "short", "last words " * 50]
    page = "<body><div><a href=x>Home</a> <a href=y>Contact</a></div><div class=content>" + "".join(map(block.format, texts))
    page += "<p>All of it</p><p><a href=z>A paragraph that is a link</a></p></div><footer>Imprint</footer></body>"
    assert extract(page) == [*(t.strip() for t in texts), "All of it", "A paragraph that is a link"]
    two = ["x" * 600, "y" * 400]
    assert extract("<body><div class=content>" + "".join(f"<div><p>{t}</p></div>" for t in two) + "</div></body>") == two


def test_forms_around_the_page_lose_controls_only():
    inner = f"<div class=content><h1>T</h1><p>{LONG}</p><label>Your name</label><input><select><option>one</option></select><p>{SHORT}</p><button>Send</button></div>"
    assert extract(f"<body><form id=aspnetForm>{MENU}{inner}<div class=ad>Buy now</div></form></body>") == ["T", LONG.strip(), SHORT]
    article = f"<article><h1>T</h1><p>{LONG}</p><form><p>Get our letter</p><input></form></article>"
    assert extract(f"<body><form>{article}<div>Buy now</div></form></body>") == ["T", LONG.strip(), "Get our letter"]
    assert extract(f"<body>{article}</body>") == ["T", LONG.strip()]


def test_articles_and_the_text_around_them_stay():
    two = f"<main><p>Before.</p><article><h2>A</h2><p>{LONG}</p></article><p>Between the two.</p><article><p>{SHORT}</p></article><p>After.</p></main>"
    assert extract(f"<body>{MENU}{two}<div class=ad>{SHORT}</div></body>") == ["Before.", "A", LONG.strip(), "Between the two.", SHORT, "After."]


def test_references_between_paragraphs_stay():
    refs = "<ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul>"
    page = f"<body><div>{MENU}</div><div><h1>T</h1><p>{LONG}</p>{refs}<p>{LONG}</p></div>{MENU}</body>"
    assert extract(page) == ["T", LONG.strip(), "First source", "Second source", LONG.strip()]


def test_clusters_decide_on_given_pages():
    """Of every given page that has an advert the clusters, and nothing else, leave it out; and regions with a mark inside an
    article, but for those that read like it."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    ads = [" ".join(unescape(re.search(r'<div class="ad">(.*?)</div>', r["html"], re.DOTALL)[1]).split()) for r in pages]
    assert all((a in extract(r["html"], _everything)) == bool(a) and extract(r["html"], _everything) != extract(r["html"]) for a, r in zip(ads, pages, strict=True) if a)
    for r in pages[:50]:
        noisy = r["html"].replace("</article>", "<div class='share-bar'>Tell your friends</div><div class='comments'><p>I like this.</p></div></article>")
        assert extract(noisy) == extract(r["html"]) != extract(noisy, _everything)


def test_samples_are_the_smallest_hashes(spark):
    rows = spark.range(20_000).selectExpr("id as vec_id")
    want = [r["vec_id"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(500).collect()]
    drawn = ann._smallest(rows, 20_000, 500)
    assert [r["vec_id"] for r in drawn.collect()] == want
    assert [r["vec_id"] for r in ann._smallest(rows.limit(3), 3, 500).orderBy("vec_id").collect()] == [0, 1, 2]
