"""Quality classifier by co-training: a view of the text's content and a view of its metadata teach each other, over all
documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import map_batches, unwrapped, wrapped

#: Labelled documents that the classifier is fitted on, at most; rounds, each of which reads all documents; how sure a
#: pseudo-label must be.
LABELLED, ROUNDS, SURE = 6000, 2, 0.97
#: Pseudo-labelled documents are summed up in so many cells by the score of the view that they teach.
CELLS, WIDEST = 32, 8.0
#: Classes of bytes: lower case, upper case, digits, spaces, ends of lines, marks of sentences, other marks, the rest.
_CLASSES = np.full(256, 7, np.int64)
_CLASSES[:128] = 6
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\x0b\x0c", b"\n\r", b".,;:'\"-?()")):
    _CLASSES[list(_bytes)] = _k
CONTENT, META = 8 + 64 + 512 + 10, 1 + 16 + 64 + 18


def content_features(text: str) -> np.ndarray:
    """What the whole text is made of: shares of byte classes in ones, twos and threes, and how words repeat."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(CONTENT, np.float32)
    c = _CLASSES[np.frombuffer(raw, np.uint8)]
    at = 0
    for n, size in ((1, 8), (2, 64), (3, 512)):
        if len(c) >= n:
            code = c[: len(c) - n + 1]
            for k in range(1, n):
                code = code * 8 + c[k : len(c) - n + 1 + k]
            out[at : at + size] = np.sqrt(np.bincount(code, minlength=size) / len(code))
        at += size
    words = raw.split()
    if words:
        n, counts = len(words), Counter(words)
        lines = raw.split(b"\n")
        lengths = np.fromiter(map(len, words), np.int64, n)
        again = sum(map(eq, words, words[1:])) / n
        out[at:] = (
            again,
            again > 0.2,
            again > 0.6,
            len(counts) / n,
            len(counts) / n**0.75,
            max(counts.values()) / n,
            len(set(zip(words, words[1:], strict=False))) / n,
            min(lengths.mean(), 40) / 10,
            min(lengths.max(), 200) / 50,
            len(set(lines)) / len(lines),
        )
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """What is known about the page without its text: language, source and stated length; nulls are values of their own."""
    out = np.zeros(META, np.float32)
    out[0] = 1
    out[1 + zlib.crc32((lang or "").encode()) % 16] = 1
    out[17 + zlib.crc32((source or "").encode()) % 64] = 1
    out[81 + min(17, int(max(n_chars or 0, 0)).bit_length())] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights, the last one the intercept: Newton steps on the penalised likelihood of weighted rows; the intercept is
    free."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    n = np.ones(len(x)) if weight is None else weight
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + ridge * w
        hess = (x * (n * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hess, grad)
        w -= move / max(1.0, np.abs(move).max() / 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


@dataclass
class View:
    """A linear classifier over one view, and the line that makes its scores calibrated log odds."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) * self.scale @ self.weights[:-1] + self.weights[-1]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -20, 20)


@dataclass
class Classifier:
    """Two calibrated views. Their log odds are added, less what both know beforehand: the share of good documents."""

    content: View
    meta: View
    prior: float

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content.odds(content), self.meta.odds(meta)
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a + b - self.prior, a, b))


#: (view taught, label, cell) -> number of documents, sum of their features.
Sums = dict[tuple[int, int, int], tuple[float, np.ndarray]]


def guesses(views: tuple[View, View], x: tuple[np.ndarray, np.ndarray], sure: float = SURE) -> Sums:
    """What each view is sure of among these documents, as sums of the other view's features for each label and cell."""
    raw = [v.raw(m) for v, m in zip(views, x, strict=True)]
    out: Sums = {}
    for taught in (0, 1):
        p = 1 / (1 + np.exp(-np.clip(raw[1 - taught], -30, 30)))
        cell = np.clip((raw[taught] + WIDEST) * (CELLS / (2 * WIDEST)), 0, CELLS - 1).astype(np.int64)
        for label, q in ((1, p), (0, 1 - p)):
            some = np.flatnonzero(q >= sure)
            for c in np.unique(cell[some]).tolist():
                at = some[cell[some] == c]
                out[taught, label, c] = (float(len(at)), x[taught][at].sum(axis=0, dtype=np.float64))
    return out


def added(one: Sums, other: Sums) -> Sums:
    for k, (n, v) in other.items():
        m, u = one.get(k, (0.0, 0.0))
        one[k] = (m + n, u + v)
    return one


def co_train(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, ask: Callable[[tuple[View, View]], Sums], rounds: int = ROUNDS) -> Classifier:
    """x: two feature matrices over the labelled documents; y: 1 good, 0 bad. ask: see guesses, over all other documents.

    A fifth of the labelled documents, drawn at random, is kept for calibration; both views are fitted to the rest. In each
    round each view labels all other documents that it is sure of, however many, and the other view is fitted anew to
    the labelled ones and to these. They weigh as much as the labelled ones, in the same proportion of good and bad; they
    come as means over cells of documents that the view taught scores alike, so what a round gathers doesn't grow.
    """
    drawn = np.random.default_rng(0).permutation(len(y))
    held, taught = np.sort(drawn[: len(drawn) // 5]), np.sort(drawn[len(drawn) // 5 :])
    if len({*y[taught].tolist()}) < 2 or len({*y[held].tolist()}) < 2:
        held = taught = np.arange(len(y))
    share = float(y.mean())
    made = []
    for m in x:
        spread = m[taught].std(axis=0)
        made.append(View(m[taught].mean(axis=0), 1 / (spread + 0.1 * spread.mean() + 1e-6)))

    def fit(k: int, sums: Sums) -> None:
        v, rows, labels, weights = made[k], [x[k][taught]], [y[taught]], [np.ones(len(taught))]
        for label, part in ((1, share), (0, 1 - share)):
            cells = [sums[c] for c in sorted(sums) if c[:2] == (k, label)]
            if cells:
                n = np.array([c[0] for c in cells])
                rows.append(np.stack([c[1] / c[0] for c in cells]))
                labels.append(np.full(len(cells), label))
                weights.append(n * (part * len(taught) / n.sum()))
        v.weights = logistic((np.concatenate(rows) - v.centre) * v.scale, np.concatenate(labels), np.concatenate(weights), penalty=5.0)

    for k in (0, 1):
        fit(k, {})
    for _ in range(rounds):
        sums = ask((made[0], made[1]))
        if not sums:
            break
        for k in (0, 1):
            fit(k, sums)
    for v, m in zip(made, x, strict=True):
        # targets a little inside 0 and 1, as usual for this calibration
        good = y[held].sum()
        t = np.where(y[held] == 1, (good + 1) / (good + 2), 1 / (len(held) - good + 2))
        z = v.raw(m[held])
        w = logistic(z[:, None] / (z.std() + 1e-9), t, penalty=1e-3)
        v.slope, v.shift = max(0.0, float(w[0] / (z.std() + 1e-9))), float(w[1])
    return Classifier(*made, prior=float(np.log((share + 1e-6) / (1 - share + 1e-6))))


def features(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows of text, lang, source, n_chars."""
    content, meta = np.zeros((len(rows), CONTENT), np.float32), np.zeros((len(rows), META), np.float32)
    for k, (text, lang, source, n) in enumerate(rows):
        content[k], meta[k] = content_features(text or ""), meta_features(lang, source, n)
    return content, meta


def _rows(b: pa.RecordBatch | pa.StructArray) -> Iterator[list[tuple]]:
    """text, lang, source, n_chars of a batch, some rows at a time: features take more room than short texts."""
    get = b.column if isinstance(b, pa.RecordBatch) else b.field
    columns = [get(c).cast(t) for c, t in (("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()))]
    for k in range(0, len(b), 512):
        yield [*zip(*(c.slice(k, 512).to_pylist() for c in columns), strict=True)]


_PLAIN = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[docs[c].cast(t).alias(c) for c, t in _PLAIN.items()])


def _asked(docs: DataFrame, views: tuple[View, View], but: frozenset[int], sure: float) -> Sums:
    """guesses over all rows of docs that have text, but for those doc_ids. Each task leaves a row for each cell at most;
    these are added up in two steps, so no task adds more than a share of them, and 4 * CELLS rows reach the driver."""
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast((views, but))
    kind = "taught int, label int, cell int, n double, v array<double>"
    names = [x.split()[0] for x in kind.split(", ")]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (views, but), total = given.value, {}
        for b in batches:
            fresh = b.filter(pa.array([i is None or i not in but for i in b.column("doc_id").to_pylist()], pa.bool_()))
            for rows in _rows(fresh):
                added(total, guesses(views, features(rows), sure))
        keys = [*total]
        columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([total[k][0] for k in keys], pa.float64()), pa.array([total[k][1] for k in keys], pa.list_(pa.float64()))], names)

    def summed(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(t), -1).sum(axis=0)
        first = [t.column(c).slice(0, 1) for c in names[:3]]
        return pa.table([*first, pa.array([sum(t.column("n").to_pylist())]), pa.array([v], pa.list_(pa.float64()))], names)

    part = map_batches(_plain(docs).where("text is not null"), sums, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    part = part.groupBy(*names[:3], "salt").applyInArrow(lambda t: summed(t.select(names)), kind)
    found = part.groupBy(*names[:3]).applyInArrow(summed, kind).collect()
    return {(r["taught"], r["label"], r["cell"]): (r["n"], np.array(r["v"])) for r in found}


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE) -> Classifier | None:
    """Fits on at most `labelled` labelled documents, those with the smallest hashes of their ids, and on what the views
    are sure of among all others, in each round.

    labels: doc_id, quality (1 good, 0 bad; other values and ids with as many of both are left out). A labelled doc_id with
    several texts counts with the smallest. None without labels of both classes: then nothing can be learned.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.avg("quality").alias("q")).where("q <> 0.5").select("doc_id", F.round("q").cast("long").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()
    if len({r["y"] for r in known}) < 2:
        return None
    chosen = spark.createDataFrame([(r["doc_id"], r["y"]) for r in known], "doc_id long, y long")
    rows = _plain(docs).where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars", "y")).alias("row")).select("doc_id", "row.*")

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float32())
        for b in batches:
            content, meta = (np.concatenate(m) for m in zip(*map(features, _rows(b)), strict=True)) if b.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(content), kind), pa.array(list(meta), kind)], ["doc_id", "y", "content", "meta"])

    table = map_batches(rows, views, "doc_id long, y long, content array<float>, meta array<float>").orderBy("doc_id").toArrow()
    y = table.column("y").to_numpy()
    if len({*y.tolist()}) < 2:
        return None
    x = tuple(table.column(c).combine_chunks().flatten().to_numpy().reshape(len(y), -1) for c in ("content", "meta"))
    but = frozenset(table.column("doc_id").to_pylist())
    return co_train(x, y, lambda views: _asked(docs, views, but, sure), rounds)


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.5, labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """Adds to docs (doc_id, text, lang, source, n_chars; all columns stay): score (0 to 1, that it is good), content_score,
    meta_score (each view's own) and keep (score >= least). Columns of docs with those names, in any case, are replaced;
    any other names do no harm.

    Fitted on a bounded sample of labelled documents and on all others (see fit); all documents are scored, whole texts
    each. A text that is null or blank has nothing to judge: all scores 0, not kept. Without labels of both classes
    nothing can be learned: all other documents have the score 1. Nulls in lang, source and n_chars are values of their
    own. Repeated rows come back as often, with equal scores; conflicting labels of a document count as their majority.
    A very long text costs memory for its words alone.
    """
    made = ("score", "content_score", "meta_score", "keep")
    given = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, labelled, rounds, sure))
    rows = wrapped(docs, made)
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        for b in batches:
            found = [[np.zeros(0)] * 3]
            for some in _rows(b.column("row")):
                scores = model.scores(*features(some)) if model else [np.ones(len(some))] * 3
                blank = np.array([not (r[0] or "").strip() for r in some], bool)
                found.append([np.where(blank, 0.0, z) for z in scores])
            score, content, meta = (np.concatenate(z) for z in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(score), pa.array(content), pa.array(meta), pa.array(score >= least)], ["row", *made])

    return unwrapped(map_batches(rows, run, f"row {kind}, score double, content_score double, meta_score double, keep boolean"), docs, made)
