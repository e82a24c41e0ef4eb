"""Vector code compression: product codes whose codebooks are fitted by Lloyd's rounds in whole numbers, with Hamerly's bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import checkpointed, map_batches, small

#: Bounds are lengths in double precision; these make them a little wider than any rounding can be.
UP, DOWN = 1 + 1e-12, 1 - 1e-12
#: How a row's state is written between rounds: whole components, and for each part its entry, the upper and the lower bound.
STATE = "vec_id {vec_id}, label {label}, x array<bigint>, a array<int>, u array<double>, l array<double>"


def finite(v: Column) -> Column:
    """Vectors without a null, an infinite component or one that is no number."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(v: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) of a matrix of vectors. Components so large that a sum of squared distances might exceed 64 bits
    are an error."""
    x = np.floor(v * factor)
    if x.size and np.abs(x).max() > isqrt((1 << 62) // (4 * max(1, v.shape[1]))):
        raise ValueError(f"a component of {np.abs(v).max()} is too large for codes of {v.shape[1]} components")
    return x.astype(np.int64)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of every row of x, ties to the lower index, its squared distance and the second smallest one (which
    equals it in a tie; of one entry, the largest number)."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)
    a = d.argmin(axis=1)
    row = np.arange(len(x))
    best = d[row, a]
    d[row, a] = np.iinfo(np.int64).max
    return a, best, d.min(axis=1)


@dataclass
class Books:
    """Codebooks, entries by part: part, entry, component. moved: how far each entry went in the last round, at most; others:
    the same for the farthest of a part's other entries; half: half the distance to the nearest other entry, at least."""

    entries: np.ndarray
    moved: np.ndarray
    others: np.ndarray
    half: np.ndarray

    @staticmethod
    def of(entries: np.ndarray, before: np.ndarray | None = None) -> Books:
        parts, k = entries.shape[:2]
        moved = np.zeros((parts, k)) if before is None else np.sqrt(((entries - before) ** 2).sum(axis=2).astype(np.float64)) * UP
        others, half = np.zeros((parts, k)), np.full((parts, k), np.inf)
        for p in range(parts):
            for j in range(k):
                rest = np.arange(k) != j
                if rest.any():
                    others[p, j] = moved[p, rest].max()
                    half[p, j] = np.sqrt(float(((entries[p, rest] - entries[p, j]) ** 2).sum(axis=1).min())) / 2 * DOWN
        return Books(entries, moved, others, half)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def first_assigned(x: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, upper and lower bound of every row and part, by full scans. x: row, part, component."""
    out = [scan(x[:, p], books.entries[p]) for p in range(x.shape[1])]
    a, best, second = (np.stack(z, axis=1) for z in zip(*out, strict=True))
    return a, np.sqrt(best.astype(np.float64)) * UP, np.sqrt(second.astype(np.float64)) * DOWN


def reassigned(x: np.ndarray, a: np.ndarray, u: np.ndarray, l: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:  # noqa: E741
    """The same after the entries moved, and how many full scans that took. A part keeps its entry without a scan only
    where its upper bound is strictly below what any other entry can be at, so ties are always scanned."""
    a, u, l, scans = a.copy(), u.copy(), l.copy(), 0  # noqa: E741
    for p in range(x.shape[1]):
        u[:, p] = (u[:, p] + books.moved[p, a[:, p]]) * UP
        l[:, p] = l[:, p] * DOWN - books.others[p, a[:, p]] * UP
        other = np.maximum(l[:, p], books.half[p, a[:, p]])
        at = np.flatnonzero(~(u[:, p] < other))
        # the exact distance first, then the scan
        u[at, p] = np.sqrt(((x[at, p] - books.entries[p, a[at, p]]) ** 2).sum(axis=1).astype(np.float64)) * UP
        at = at[~(u[at, p] < other[at])]
        if len(at):
            scans += len(at)
            a[at, p], best, second = scan(x[at, p], books.entries[p])
            u[at, p], l[at, p] = np.sqrt(best.astype(np.float64)) * UP, np.sqrt(second.astype(np.float64)) * DOWN
    return a, u, l, scans


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), kind))


def _assigned(rows: DataFrame, books: Books, parts: int, width: int, factor: int, first: bool, kind: str) -> DataFrame:
    """One round's pass over all rows: vectors (first) or states in, states out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if first:
                x = whole(_matrix(b.column("v"), width), factor)
                a, u, l = first_assigned(x.reshape(len(x), parts, -1), books)  # noqa: E741
            else:
                x, (a, u, l) = _matrix(b.column("x"), width), (_matrix(b.column(c), parts) for c in "aul")  # noqa: E741
                a, u, l, _ = reassigned(x.reshape(len(x), parts, -1), a, u, l, books)  # noqa: E741
            made = [_lists(x, pa.int64()), _lists(a, pa.int32()), _lists(u, pa.float64()), _lists(l, pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), *made], ["vec_id", "label", "x", "a", "u", "l"])

    return checkpointed(map_batches(rows, run, kind))


def _moved(state: DataFrame, books: Books) -> Books:
    """Entries replaced by the floor of their parts' means, unused ones as they were. A task sums its rows, Spark the tasks'
    sums, exactly; the driver gets a number for each component of the codebooks."""
    parts, k, w = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * k, w + 1), np.int64), np.arange(parts) * k
        for b in batches:
            x, a = _matrix(b.column("x"), parts * w).reshape(-1, w), _matrix(b.column("a"), parts)
            np.add.at(sums, (a + counts).ravel(), np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1))
        cell, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(at), pa.array(sums[cell, at])], ["cell", "at", "s"])

    found = map_batches(state.select("x", "a"), run, "cell long, at long, s long").groupBy("cell", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums: dict[int, list[int]] = {}
    for r in found:
        sums.setdefault(r["cell"], [0] * (w + 1))[r["at"]] = int(r["s"])
    fresh = books.entries.reshape(parts * k, w).copy()
    for cell, s in sums.items():
        fresh[cell] = [v // s[w] for v in s[:w]]
    return Books.of(fresh.reshape(books.entries.shape), books.entries)


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, factor: int = 256) -> DataFrame:
    """vec_id, code (two hex digits a part), error (long), label_error (long), codebooks_sha256 for every row of vectors
    (vec_id, embedding, label; others ignored, whatever their names) that has a usable vector.

    Rows whose vector is null or holds null or non-finite components are dropped, and vectors of another length than the
    most frequent one (of several, the longest). Components become floor(factor * x); a vector is cut into `parts` equal
    parts, a length that doesn't allow that is an error, as is a component beyond 2^27 after that at 64 components, since
    error would exceed 64 bits. Codebooks begin as the parts of the rows with the smallest vec_ids, as many as `entries`
    (256 at most) or as there are; rows that share a vec_id count each, ordered by vector; rows without one come last.
    label_error sums error over equal labels, nulls together. No usable rows give no rows.

    Each round is a pass over all rows. What a round knows of a row is written down with it: the entry of each part, an
    upper bound of the distance to it, and a lower bound of that to any other. Entries move, so bounds widen by how far
    they moved; a part is compared with all entries only if its upper bound is no longer strictly below the lower one.
    Only codebooks, sums of them and the lists of smallest ids reach the driver.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors["vec_id"].alias("vec_id"), vectors["label"].alias("label"), vectors["embedding"].cast("array<double>").alias("v")).where(finite(F.col("v")))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not widths:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    width = widths[0]["width"]
    if width % parts or not 0 < entries <= 256:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} parts with {entries} entries")
    rows = rows.where(F.size("v") == width)
    # ids first, so that no more than a few vectors of each task ever meet in one
    ids = rows.select("vec_id").orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()
    few = rows if ids[-1]["vec_id"] is None else rows.where(F.col("vec_id") <= F.lit(ids[-1]["vec_id"]))
    start = few.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    first = whole(np.array([r["v"] for r in start], np.float64).reshape(len(start), width), factor)
    books = Books.of(np.ascontiguousarray(first.reshape(len(start), parts, -1).transpose(1, 0, 2)))
    kind, state = STATE.format(**kinds), rows
    for k in range(rounds):
        state = _assigned(state, books, parts, width, factor, k == 0, kind)
        books = _moved(state, books)
    state = _assigned(state, books, parts, width, factor, rounds == 0, kind)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, a = _matrix(b.column("x"), width).reshape(b.num_rows, parts, -1), _matrix(b.column("a"), parts)
            error = ((x - books.entries[np.arange(parts), a]) ** 2).sum(axis=(1, 2))
            codes = [c.tobytes().hex() for c in a.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    found = checkpointed(map_batches(state.select("vec_id", "label", "x", "a"), coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    sums = small(checkpointed(found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))))
    return found.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
