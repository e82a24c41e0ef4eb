"""Source divergence audit: how far the words of each source of a language are from those of the others, and which words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm.common import checkpointed, map_batches, small

#: Letters and the bytes, in UTF-8, of whatever isn't ASCII.
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Different terms of all groups that a task holds before it passes their counts on, and those of a batch.
HELD = 200_000
#: Sources whose contributions are summed side by side.
WIDTH = 32
#: Counts of terms by source that a task works on at once, and sums of pairs that it holds before it passes them on.
CELLS, SUMS = 1 << 20, 1 << 22
#: Parts that a group's terms are ranked in before their best meet.
SALTS = 64


def _share(count: np.ndarray, total: np.ndarray, terms: int, scale: int) -> np.ndarray:
    """1 + floor(scale * (count + 1) / (total + terms)), of numbers of any size."""
    if count.size and (int(count.max()) + 1) * scale >= 1 << 63:
        count = count.astype(object)
    return (1 + (count + 1) * scale // (total + terms)).astype(np.int64)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); unsigned division is faster, and nothing here is negative."""
    d = p - q
    d *= d
    return (d.view(np.uint64) // q.view(np.uint64)).view(np.int64)


def _contributions(dense: DataFrame, top: int, scale: int) -> DataFrame:
    """lang, i, j, term, value of dense (lang, term, cells: place of a source and count, totals by place, all, v): values of
    pairs of places i and j, to be summed, without a term; and, without j, such of terms that may be among the top of i."""
    width, cells, sums_held = WIDTH, CELLS, SUMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        floor: dict[tuple[str, int], int] = {}

        def rows(lang: str, i: np.ndarray, j: np.ndarray | None, term: pa.Array | None, value: np.ndarray) -> pa.RecordBatch:
            n = len(value)
            columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int32))), pa.array(i.astype(np.int32))]
            columns += [pa.nulls(n, pa.int32()) if j is None else pa.array(j.astype(np.int32)), pa.nulls(n, pa.string()) if term is None else term, pa.array(value)]
            return pa.RecordBatch.from_arrays(columns, ["lang", "i", "j", "term", "value"])

        def summed() -> Iterator[pa.RecordBatch]:
            for (lang, a, b), f in sums.items():
                i, j = np.indices(f.shape)
                yield rows(lang, a + i.ravel(), b + j.ravel(), None, f.ravel())
            sums.clear()

        def work(t: pa.RecordBatch, lang: str) -> Iterator[pa.RecordBatch]:
            totals, of, terms = t.column("totals")[0].values.to_numpy(), t.column("cells"), t.column("term")
            all_, v = t.column("all")[0].as_py(), t.column("v")[0].as_py()
            flat = of.flatten()
            n = np.zeros((len(totals), t.num_rows), np.int64)
            n[flat.field("i").to_numpy(), np.repeat(np.arange(t.num_rows), pc.list_value_length(of).to_numpy())] = flat.field("n").to_numpy()
            p, q = _share(n, totals[:, None], v, scale), _share(n.sum(axis=0), np.int64(all_), v, scale)
            for b in range(0, len(p), width):
                for i in range(len(p)):
                    key = (lang, i - i % width, b)
                    if key not in sums:
                        sums[key] = np.zeros((min(width, len(p) - key[1]), min(width, len(p) - b)), np.int64)
                    sums[key][i % width] += _distance(p[i], p[b : b + width]).sum(axis=1)
                if len(sums) * width * width > sums_held:
                    yield from summed()
            for i in range(len(p)):
                at = np.flatnonzero((n[i] > 0) & (p[i] > q))
                value = _distance(p[i][at], q[at])
                least = floor.get((lang, i), 0)
                if len(value) > top:  # all that are worth as much as the last, in case of ties
                    least = floor[lang, i] = max(least, int(np.partition(value, len(value) - top)[len(value) - top]))
                at, value = at[value >= least], value[value >= least]
                yield rows(lang, np.full(len(at), i), None, terms.take(pa.array(at)), value)

        def worked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            for lang in pc.unique(t.column("lang")).to_pylist():
                own = t.filter(pc.equal(t.column("lang"), lang)).combine_chunks()
                most = max(1, cells // len(own.column("totals")[0]))
                for b in own.to_batches(most):
                    yield from work(b, lang)

        held, size = list[pa.RecordBatch](), 0
        for b in batches:
            held.append(b)
            size += b.num_rows + len(b.column("totals").values)
            if size > cells:
                yield from worked(held)
                held, size = [], 0
        if held:
            yield from worked(held)
        yield from summed()

    return map_batches(dense.select("lang", "term", "cells", "totals", "all", "v"), run, "lang string, i int, j int, term string, value long")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents) of docs (lang, source, text, none of them null). A task counts its
    texts group by group, as many as fit, and Spark adds up the tasks' counts, in part before the shuffle."""

    def counted(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in found.items():
            of = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*of, pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
                # bytes.lower() is about A-Z alone
                terms = _TERM.findall(text.as_py().lower())
                n, df = found.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(terms)
                df.update(set(terms))
                size += len(n)
            if size > HELD:
                yield from counted(found)
                found, size = {}, 0
        yield from counted(found)

    rows = map_batches(docs.select("lang", "source", F.col("text").cast("binary").alias("text")), run, "lang string, source string, term string, n long, df long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200, scale: int = 1_000_000_000) -> DataFrame:
    """lang, source, part, item, value (long), rank (int) of docs (text, lang, source; others ignored, whatever their names).

    Terms are letters A-Z, lower-cased, and characters beyond ASCII; each lang keeps those that at least min_docs of its
    documents hold, V terms. A group (lang, source), and a lang as a whole, gives each kept term, found there or not,
    p = 1 + floor(scale * (count + 1) / (N + V)), N its occurrences of all kept terms. f(p, q) = floor((p - q)^2 / q).

    Part `pair`: item is each other source of the lang, value f summed over all kept terms, p the group's and q the
    item's; 0 if V = 0; all ranks. Part `term`: item is each kept term with occurrences in the group and p > q, q the
    lang's, value f; the first `top`. Ranks from 1 by value, largest first, ties by item in UTF-8 order.

    Null text, lang and source are empty strings; rows are documents, also such that repeat. Groups without terms have
    their pairs; a lang of one source without kept terms has no rows; no documents no rows. A very long text is a row
    of one task, with its terms in memory.

    A kept term is one row with its counts by source, whose place among the lang's tells it; a task makes shares of many
    terms at once and from these the contributions to pairs, which are summed before they are shuffled, and leaves terms
    that can't be among the best of what it has seen. The array of a lang's sources is sent out if small, else joined.
    """
    if scale > 3_000_000_000:
        raise ValueError("the square of a share must fit 64 bits: scale can't be beyond 3,000,000,000")
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    places = rows.select("lang", "source").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("g"))
    named = checkpointed(places.select("lang", F.posexplode("g").alias("i", "source")))
    counts = term_counts(rows).join(small(named), ["lang", "source"])
    wide = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("i", "n")).alias("cells"))
    wide = checkpointed(wide.where(F.col("df") >= min_docs).select("lang", "term", "cells"))
    found = wide.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.i").agg(F.sum("c.n").alias("total"))
    totals = named.join(found, ["lang", "i"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("total", F.lit(0)).alias("total")))).alias("t"))
    totals = totals.select("lang", F.col("t.total").alias("totals"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x["total"]).alias("all"))
    langs = checkpointed(totals.join(wide.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang"))
    values = checkpointed(_contributions(wide.join(small(langs), "lang"), top, scale))

    # every pair once with its names, whether it has terms or not
    pairs = named.select("lang", "i", "source").join(named.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), "lang").where("i <> j")
    pairs = pairs.select("lang", "i", "j", F.lit(0).cast("long").alias("value"), "source", "item").unionByName(values.where("term is null and i <> j").select("lang", "i", "j", "value"), allowMissingColumns=True)
    pairs = pairs.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.max("source").alias("source"), F.max("item").alias("item"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))

    found = values.where("j is null").join(small(named), ["lang", "i"]).select("lang", "source", F.col("term").alias("item"), "value")
    # a hot group's terms are ranked in parts first, so no task holds more than the best of each
    salted = Window.partitionBy("lang", "source", "salt").orderBy(F.desc("value"), "item")
    found = found.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS))).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top).drop("rank", "salt")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.unionByName(found.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
