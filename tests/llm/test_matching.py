"""Line dedup, SimHash, components and decontamination against brute force and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sextant.llm import decontaminate as D
from sextant.llm import simhash as S
from sextant.llm.components import connected_components
from sextant.llm.line_dedup import line_dedup
from sextant.llm.queries import ORACLES

DOC = "doc_id long, text string"


def test_line_dedup_brute_force(spark):
    rng = random.Random(1)
    lines = ["Same Line", " same line\t", "", " ", "Éa", "éa", "other", "x\ty", "the end "] + [f"line {k}" for k in range(30)]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for k in range(80)] + [(80, None), (81, ""), (82, "\n"), (3, "Same Line")]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.translate(fold).strip(" \t\n\x0b\x0c\r")
    often: dict[str, int] = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            often[k] = often.get(k, 0) + 1
    want = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (key(x) and often[key(x)] >= 10)]
        want.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    df = spark.createDataFrame([(*r, 7) for r in rows], DOC + ", KEY int").withColumnRenamed("KEY", "a")
    got = [tuple(r) for r in line_dedup(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()]
    assert sorted(got) == sorted(want)
    assert line_dedup(df).columns == ["doc_id", "text", "a", "kept_text", "n_lines", "n_dropped"]


def test_line_dedup_counts_documents(spark):
    """Query and SQL agree where rows share a doc_id or have none, and where columns have the names of what is made."""
    rows = [(k % 5, f"five\nof {k}") for k in range(10)] + [(None, "without\nid")] * 11 + [(100 + k, "TEN\nx") for k in range(9)] + [(100, "ten \ny"), (109, "\tten"), (None, "x")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], DOC + ", N_LINES int, row int, ka int, `drop` int, `a.b` int")
    out = line_dedup(df)
    assert out.columns == ["doc_id", "text", "row", "ka", "drop", "a.b", "kept_text", "n_lines", "n_dropped"]
    got = [tuple(r) for r in out.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(kept_text, 256)").collect()]
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    want = db.execute(ORACLES["op10_line_dedup"]).fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r["kept_text"] for r in out.where("doc_id < 5").collect()} == {f"five\nof {k}" for k in range(10)}
    assert {r["kept_text"] for r in out.where("doc_id is null").collect()} == {""} and out.where("doc_id = 109").first()["kept_text"] == ""


def test_line_dedup_without_rows_or_ids(spark):
    assert line_dedup(spark.createDataFrame([], DOC)).collect() == []
    hot = spark.createDataFrame([("a\nb",)] * 12 + [("c",)], "text string")
    assert sorted(r["kept_text"] for r in line_dedup(hot).collect()) == [""] * 12 + ["c"]


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(0, 3)), max_size=80))
@settings(max_examples=60, deadline=None)
def test_spanning_keeps_components_at_every_distance(links):
    i, j, d = (np.array(x, np.int64) for x in (zip(*links, strict=True) if links else ([], [], [])))
    kept = S.spanning(41, i, j, d)
    for most in range(4):
        assert _labels(41, i, j, d <= most) == _labels(41, i[kept], j[kept], d[kept] <= most)


def _labels(n, i, j, keep):
    up = list(range(n))
    for a, b in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    out = []
    for x in range(n):
        while up[x] != x:
            x = up[x]
        out.append(x)
    return out


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(30)]
    links += [(7, 7), *[(500, k) for k in range(501, 520)]]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 3)], "u long, v long")).collect()}
    a, b = np.array(links).T
    want = _labels(600, a, b, np.ones(len(a), bool))
    nodes = {x for u, v in links if u != v for x in (u, v)}
    assert got == {n: want[n] for n in nodes}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


WORDS = [f"w{k}" for k in range(400)]


def _corpus(rng):
    rows = []
    for k in range(60):
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 120))]
        rows.append((k, " ".join(words)))
        if k % 3 == 0:
            some = words[:]
            for _ in range(rng.randint(0, 2)):
                some[rng.randrange(len(some))] = rng.choice(WORDS)
            rows.append((100 + k, " ".join(some).upper() if k % 2 else "  ".join(some)))
    return rows + [(900, None), (901, ""), (902, " \n"), (5, dict(rows)[5]), (903, "one"), (904, "one two")]


@pytest.mark.parametrize("tile", [7, S.TILE])
def test_simhash_brute_force(spark, tile):
    import xxhash

    rows = _corpus(random.Random(3))

    def plain(text):
        words = (text or "").encode().lower().split()
        parts = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: plain(t) for i, t in rows}
    ids = sorted(prints)
    a, b = np.array([(x, y) for x in ids for y in ids if x < y and (prints[x] ^ prints[y]).bit_count() <= 4]).T
    want = _labels(1000, a, b, np.ones(len(a), bool))
    df = spark.createDataFrame([(*r, 1) for r in rows], DOC + ", fp int")
    got = S.simhash_components(df, tile=tile).collect()
    assert sorted((r["doc_id"], r["fp"].hex(), r["component_id"]) for r in got) == sorted((i, f"{prints[i]:016x}", want[i]) for i, _ in rows)
    assert S.simhash_components(spark.createDataFrame([], DOC)).collect() == []


def test_prints_without_an_id_are_bridges(spark):
    prints = [(9, 0b0), (None, 0b1111), (5, 0b11111111), (None, 0b1111 << 40), (None, 0b1111 << 41), (7, 0xFFFF << 48), (7, 0xFFFF << 48)]
    rows = spark.createDataFrame([(i, p.to_bytes(8, "big")) for i, p in prints], "doc_id long, fp binary")
    made = S.fingerprints
    S.fingerprints = lambda *_: rows
    try:
        got = S.simhash_components(rows).collect()
    finally:
        S.fingerprints = made
    assert sorted((r["fp"].hex()[-4:], str(r["component_id"])) for r in got if int(r["fp"].hex(), 16) < 1 << 16) == [("0000", "5"), ("000f", "5"), ("00ff", "5")]
    assert [r["component_id"] for r in got if 1 << 39 < int(r["fp"].hex(), 16) < 1 << 50] == [5, 5]
    assert [r["component_id"] for r in got if r["doc_id"] == 7] == [7, 7]
    alone = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (1, "a b c d e")], DOC)
    assert {(r["doc_id"], r["component_id"]) for r in S.simhash_components(alone).collect()} == {(None, None), (1, 1)}


def _near(found):
    rows = found.collect()
    assert len(rows) == len({r["id"] for r in rows})
    return {r["id"]["doc_id"]: r["component"]["doc_id"] for r in rows}


def test_one_row_of_each_group(spark):
    """Rows that share a doc_id, have none or repeat; columns of any name."""
    rng = random.Random(14)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (1, b), (1, a), (2, b + " more"), (3, c), (None, c), (None, d), (None, d + " more"), (None, "short"), (5, "short"), (6, None), (None, "")]
    df = spark.createDataFrame([(*r, k, "x", 1) for k, r in enumerate(rows)], DOC + ", id int, row string, FP int")
    out = S.one_of_each(df)
    assert out.columns == ["doc_id", "text", "id", "row", "FP"]
    got = sorted((str(r["doc_id"]), str(r["text"])[:8]) for r in out.collect())
    # of the two that have no id and are near to each other one stays
    assert len(got) == 6 and got[:2] == sorted([("1", a[:8]), ("1", b[:8])]) and got[2:5] == [("3", c[:8]), ("5", "short"), ("6", "None")] and got[5] == ("None", d[:8])
    assert S.one_of_each(spark.createDataFrame([], DOC)).collect() == []


def test_near_duplicates_are_verified(spark):
    rng = random.Random(4)
    rows, clean = [], []
    for k in range(40):
        words = [rng.choice(WORDS) for _ in range(150)]
        rows.append((k, " ".join(words)))
        clean.append(k)
        for n in range(2):
            some = words[:]
            some[rng.randrange(150)] = f"new{k}{n}"
            rows.append((1000 + 10 * k + n, " ".join(some)))
        half = words[:75] + [rng.choice(WORDS) for _ in range(75)]
        rows.append((5000 + k, " ".join(half)))
        clean.append(5000 + k)
    rows += [(9000, None), (9001, ""), (9001, "")]
    got = _near(S.near_duplicates(spark.createDataFrame(rows, DOC)))
    assert {d for d, c in got.items() if d == c} == {*clean, 9000}
    assert got[1000] == 0 and got[1390 + 1] == 39 and got[9001] == 9000


def _groups(rows, size=5, least=0.8):
    """The components of all pairs of that similarity, by comparing all sets."""
    sets = {i: frozenset(S.shingles(t, size)) for i, t in rows}
    ids = sorted(sets)
    a, b = np.array([(x, y) for x in ids for y in ids if x < y and (sets[x] == sets[y] or len(sets[x] & sets[y]) >= least * len(sets[x] | sets[y]))] or np.zeros((0, 2), int)).T
    of = _labels(max(ids) + 1, a, b, np.ones(len(a), bool))
    return {i: of[i] for i in ids}


@pytest.mark.parametrize("sizes", [{}, {"tile": 50, "set_tile": 3000}])
def test_near_duplicates_of_a_family_about_the_limit(spark, sizes):
    rng = random.Random(11)
    rows = []
    for family in range(2):
        words = [rng.choice(WORDS) for _ in range(100)]
        for k in range(250):
            some = words[:]
            for at in rng.sample(range(100), 2 if k % 10 else 3):
                some[at] = f"v{rng.randrange(10**6)}"
            rows.append((1000 * family + k, " ".join(some)))
    got = _near(S.near_duplicates(spark.createDataFrame(rows, DOC).repartition(4), **sizes))
    want = _groups(rows)
    assert got == want
    assert 20 < len({*want.values()}) < 480


def test_near_duplicates_with_a_passage_repeated_inside(spark):
    rng = random.Random(12)
    rows = []
    for k, times in enumerate((2, 5, 10, 50)):
        text = " ".join(rng.choice(WORDS) for _ in range(120))
        rows += [(k, text), (100 + k, text + f" {text[-40:]}" * times)]
    got = _near(S.near_duplicates(spark.createDataFrame(rows, DOC)))
    want = _groups(rows)
    assert all(want[100 + k] == k for k in range(4))
    assert got == want


def test_equal_prints_of_different_texts_are_verified(spark):
    rng = random.Random(13)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(60)) + " again" * 200) for k in range(6)]
    rows += [(10, rows[3][1].upper()), (11, rows[4][1].replace(" ", "  ") + " again")]
    got = _near(S.near_duplicates(spark.createDataFrame(rows, DOC)))
    assert got == _groups(rows) == {**{k: k for k in range(6)}, 10: 3, 11: 4}
    # and prints that are equal though each shingle counts once
    prints = spark.createDataFrame([(7, b"\1" * 32, b"a"), (3, b"\1" * 32, b"b"), (5, b"\1" * 32, b"b")], "id long, fp binary, digest binary")
    reps = S.representatives(prints)
    name = {r["node"]: r["rep"] for r in reps.collect()}
    assert sorted(name.values()) == [3, 7]
    assert [sorted(map(name.get, r[:2])) + [r[2]] for r in S.simhash_links(reps, 256, 72).collect()] == [[3, 7, 0]]


def test_large_group_of_near_copies_gives_few_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
    m = np.repeat(base[None, :], 3000, axis=0)
    m[np.arange(3000), 0] ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    i, j, d = S.compare(np.unique(m, axis=0), None, 4)
    assert len(i) == len(np.unique(m, axis=0)) - 1 and d.max() <= 4


def test_opposite_prints_do_not_link_and_loose_links_stay():
    m = np.zeros((2, 4), np.uint64)
    m[1] = ~m[1]
    assert len(S.compare(m, None, 72)[0]) == 0 and len(S.compare(m[:1], m[1:], 72)[0]) == 0
    # a triangle: the forest has two sides, with more = (1, 2) the longest one, as 0's nearest loose link, stays too
    m = np.array([[0], [0b11], [0b11111]], np.uint64)
    assert len(S.compare(m, None, 8)[0]) == 2
    assert sorted(zip(*(x.tolist() for x in S.compare(m, None, 8, (1, 2))), strict=True)) == [(0, 1, 2), (0, 2, 5), (1, 2, 3)]


def _contaminated(rows, bench, window):
    import re

    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    windows: dict[tuple, set] = {}
    for i, t in bench:
        w = split(t)
        for k in range(max(0, len(w) - window) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).update(set() if i is None else {str(i)})
    out = []
    for d, t in rows:
        w, hit, items = split(t), set(), set()
        for key, names in windows.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit |= set(range(k, k + len(key)))
                    items |= names
        out.append((d, len(w), len(hit), sorted(items), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("size", [{}, {"shard_words": 40}, {"block_bytes": 60}, {"block_bytes": 8, "shard_words": 300}])
def test_contamination_brute_force(spark, size):
    rng = random.Random(6)
    small = ["a", "B", "c", "é", "7"]
    bench = [(k, " ".join(rng.choice(small) for _ in range(rng.randint(1, 9)))) for k in range(12)] + [(3, "a, b"), (20, None), (21, " ?!"), (None, "c c c c c"), (22, "zz top"), (10, "zz")]
    rows = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choice([*small, "zz", "unknown"]) for _ in range(rng.randint(0, 60)))) for k in range(40)] + [(40, None), (41, ""), (0, "a b c"), (42, "!" * 9)]
    want = _contaminated(rows, bench, 4)
    df = spark.createDataFrame([(*r, True, 1, 2, 3, 4) for r in rows], DOC + ", items boolean, HITS int, row int, more int, _a int").coalesce(2)
    got = D.contamination(df, spark.createDataFrame(bench, "item_id long, text string"), window=4, **size)
    assert got.columns == ["doc_id", "text", "row", "more", "_a", "n_words", "n_hit", "items", "contaminated", "hits", "longest"]
    assert got.where("(longest is null) <> (n_hit = 0) or longest.n_words > n_words or (row, more, _a) <> (2, 3, 4)").count() == 0
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()) == sorted(want)


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = D.contamination(spark.createDataFrame([(1, "a b")], DOC), none).collect()
    assert [tuple(r) for r in got] == [(1, "a b", 2, 0, [], False, [], None)]
    assert D.contamination(spark.createDataFrame([], DOC), none).collect() == []
    assert D.items_digest(["10", "9"]) == hashlib.sha256(b"10,9").hexdigest()


def test_longest_match_of_a_document(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdef")
    bench = [(f"i{k}", [word() for _ in range(rng.randint(3, 14))]) for k in range(25)]
    rows = [(k, [word() for _ in range(rng.randint(0, 60))]) for k in range(60)]
    same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = {d: max((same(w[p:], v[q:]) for p in range(len(w)) for _, v in bench for q in range(len(v))), default=0) for d, w in rows}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], DOC).coalesce(1)
    got = D.contamination(df, spark.createDataFrame([(i, " ".join(v)) for i, v in bench], "item_id string, text string"), window=3, shard_words=500).collect()
    for r in got:
        m = r["longest"]
        assert (m["n_words"] if m else 0) == (want[r["doc_id"]] if want[r["doc_id"]] >= 3 else 0)
        if m:
            w, v = dict(rows)[r["doc_id"]], dict(bench)[m["item"]]
            assert w[m["doc_word"] :][: m["n_words"]] == v[m["item_word"] :][: m["n_words"]]


def test_windows_come_from_the_longest_matches():
    """Without the search of every suffix no window is found."""
    tests = D.Tests.of([("i", D.words("a b c d e"))], 3)
    shard = D.Shard.of(tests, [D.words("x a b c d y")])
    assert sorted(shard.windows()[1].tolist()) == [1, 2]
    shard.longest = lambda: (tests.suffixes, np.zeros(5, np.int64), np.full(5, -1))
    assert shard.windows()[1].tolist() == []


def test_shared_windows_are_searched_once():
    tests = D.Tests.of([(str(k), D.words("the same opening words and then item number " + str(k))) for k in range(3000)], 5)
    assert len(tests.starts) == 4 + 3000 * 1 and len(tests.items_of(np.array([tests.window[0]]))) == 3000


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "b c"), (3, None)], DOC)
    bench = spark.createDataFrame([("i", "a b c d e"), ("j", "b")], "item_id string, text string")
    got = {(r["item"], r["item_word"]): (r["n_words"], r["doc_id"], r["doc_word"]) for r in D.matches(docs.coalesce(1), bench, window=3).collect()}
    assert got[("i", 0)] == (4, 1, 1) and got[("i", 1)] == (3, 1, 2) and got[("i", 3)] == (1, 1, 4) and ("i", 4) not in got


@given(st.lists(st.integers(-1, 3), max_size=40))
@settings(max_examples=100, deadline=None)
def test_suffix_array_is_sorted(numbers):
    text = np.array([*numbers, -1], np.int64)
    begin = np.flatnonzero(text >= 0)
    order = D.suffix_array(text, begin, 64)
    suffix = lambda k: numbers[k:][: ([*numbers[k:], -1]).index(-1)]
    assert [suffix(k) for k in order.tolist()] == sorted(suffix(k) for k in begin.tolist())


def test_small_sets_are_matched_without_fingerprints(spark):
    """Of texts of few shingles a shorter one that is similar enough is found whatever the fingerprints say."""
    rng = random.Random(6)
    texts = []
    for k in range(60):
        words = [f"w{k}x{j}" for j in range(rng.randint(4, 14))]
        texts += [" ".join(words), " ".join(words[: rng.randint(3, len(words))]), " ".join(words[rng.randint(0, 2) :])]
    sets = [set(S.shingles(t, 5)) for t in texts]
    assert max(map(len, sets)) <= S.SMALL
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(3)
    got = {r["id"]["doc_id"]: r["component"]["doc_id"] for r in S.near_duplicates(df, radius=0).collect()}
    # pairs of which neither is a part of the other are left to fingerprints: here there are none that aren't joined anyway
    assert got == dict(enumerate(root)) and len(set(root)) < len(texts) - 40


def test_long_copied_items_take_no_square(spark):
    """An item of 16,000 words copied in full: every suffix's longest match, and all words hit."""
    rng = random.Random(3)
    item = [b"w%d" % rng.randrange(500) for _ in range(16_000)]
    began = time.perf_counter()
    shard = D.Shard.of(D.Tests.of([("a", item)], 13), [item, [b"x"] * 50 + item[:8000] + [b"y"], item[::-1]])
    _, best, _ = shard.longest()
    _, at = shard.windows()
    most, _ = shard.verbatim(np.unique(at))
    assert best.max() == most.max() == 16_000 and len(at) == 16_000 - 12 + 8000 - 12
    assert time.perf_counter() - began < 10
    docs = spark.createDataFrame([(1, b" ".join(item).decode()), (2, "nothing of it")], DOC)
    got = D.contamination(docs, spark.createDataFrame([(7, b" ".join(item).decode())], "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in got] == [(16_000, 16_000, True), (3, 0, False)] and got[0]["longest"]["n_words"] == 16_000


def test_blocks_of_a_benchmark_are_chained(spark):
    """Many blocks, several in one reading: the same as one block."""
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    items = spark.createDataFrame([(k, words(20)) for k in range(30)], "item_id long, text string")
    texts = [r["text"] for r in items.collect()]
    docs = spark.createDataFrame([(k, words(30) + " " + texts[k % 30][: 10 + 3 * k] + " " + words(5)) for k in range(40)], DOC).repartition(2)
    one, many = (sorted(map(str, D.contamination(docs, items, window=5, block_bytes=size).drop("longest").collect())) for size in (1 << 20, 300))
    assert one == many and sum("contaminated=True" in r for r in one) > 20


def test_documents_of_many_common_lines(spark):
    lines = "\n".join(f"line {k}" for k in range(30_000))
    df = spark.createDataFrame([(k, f"own {k}\n{lines}\nlast {k}") for k in range(10)], DOC)
    began = time.perf_counter()
    got = line_dedup(df).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got)) == [(k, f"own {k}\nlast {k}", 30_002, 30_000) for k in range(10)]
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("most", [S.LIST, 3])
def test_only_sets_that_share_a_first_shingle_are_compared(spark, most, monkeypatch):
    """Tiles, in which each is compared with each, hold only sets of keys that more than `most` sets have; groups are those of
    all pairs, in lists and in tiles."""
    rng = random.Random(21)
    text = lambda n: [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)]
    rows, common = [], text(12)
    for k in range(60):
        words = text(rng.randint(1, 90))
        if k % 3 == 0:
            words = common + words
        for copy in range(rng.randint(1, 7)):
            changed = [w if rng.random() > 0.01 * copy else "changed" for w in words]
            rows.append((len(rows), " ".join(changed[: len(changed) - rng.randint(0, 2)])))
    tiled, made = [], S.simhash_links
    monkeypatch.setattr(S, "simhash_links", lambda reps, *more: (tiled.append(reps.count()), made(reps, *more))[1])
    assert _near(S.near_duplicates(spark.createDataFrame(rows, DOC).repartition(3), most=most)) == _groups(rows)
    assert len(set(_groups(rows).values())) < 0.7 * len(rows)
    assert tiled == [0] if most == S.LIST else 0 < tiled[0] < len(rows)


def test_lists_of_a_key_over_many_batches(spark):
    """Keys of one node, of few, of up to `most` and of more, in batches that cut them; repeated rows count once."""
    sizes = {1: 1, 2: 2, 3: 700, 4: 1, 5: 701, 6: 2500, 7: 3, 8: 1}
    rows = [(k, n) for k, m in sizes.items() for n in range(m)] * 2
    keyed = spark.createDataFrame(rows, "key long, node long").coalesce(1)
    got = S._lists(keyed, 700).collect()
    assert sorted(r["members"] for r in got if not r["long"]) == sorted([*range(m)] for m in sizes.values() if 2 <= m <= 700)
    assert {n for r in got if r["long"] for n in r["members"]} == {*range(2500)} and max(len(r["members"]) for r in got) < 1300
