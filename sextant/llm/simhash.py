"""SimHash near-dedup: fingerprints in executors, then tiled exact comparison with exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import bounded_batches, checkpointed, map_batches, released, texts, unwrapped
from sextant.llm.components import connected_components

#: Fingerprints in a tile, at least and at most: a 32nd of all, so what is sent around grows with the input, not with its
#: square, up to 32 times the most. Pairs of tiles are compared in blocks of at most BLOCK pairs of fingerprints.
TILE, LARGEST_TILE, BLOCK = 16_384, 1 << 18, 1 << 20
#: Shingles of a set whose parts are looked up by themselves.
SMALL = 10
#: Shingles in a tile of texts whose sets are compared, on average.
SET_TILE = 1 << 20
#: One of so many texts tells which shingles are frequent, so many of them at most: they decide how much is compared, never
#: what is found.
TOLD_BY, TOLD = 64, 1 << 18
#: Sets of a list that share a shingle and are compared by one task, at most; those of longer lists go into tiles.
LIST = 4096
_DIGEST = {64: xxhash.xxh64_digest, 128: xxhash.xxh3_128_digest, 256: lambda x, seed: xxhash.xxh3_128_digest(x, seed) + xxhash.xxh3_128_digest(x, seed + 1)}


def shingles(text: str, size: int) -> list[bytes]:
    """The word shingles of a text with A-Z lower-cased, repeats included; of fewer words the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - size].tolist()]
    return [joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: str, size: int = 4, bits: int = 64, seed: int = 42) -> bytes:
    """Bits set in over half the hashes of the shingles, most significant first; no words: zero."""
    return _majority(shingles(text, size), bits, seed)[0]


def _majority(items: list[bytes], bits: int, seed: int) -> tuple[bytes, list[bytes]]:
    """Bits set in over half the hashes of the items, and these hashes in parts."""
    digest, counts, parts = _DIGEST[bits], np.zeros(bits, np.int64), []
    for k in range(0, len(items), 4096):
        raw = b"".join([digest(x, seed) for x in items[k : k + 4096]])
        parts.append(raw)
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, bits // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(items)).tobytes(), parts


Often = tuple[np.ndarray, np.ndarray]


def set_print(text: str, size: int, bits: int = 256, seed: int = 42, least: float = 0.8, often: Often | None = None) -> tuple[bytes, bytes, list[bytes], np.ndarray]:
    """The fingerprint of the different shingles, each counted once; 128 bits that tell sets of shingles apart; of a set of
    SMALL shingles at most these bits of each part of it that is similar enough: of sets so small that their fingerprints
    say little, the smaller of two similar ones is a part of the other, but for fingerprints that agree well; and the
    set's first shingles, see first_shingles."""
    fp, parts = _majority([*set(shingles(text, size))], bits, seed)
    raw = np.frombuffer(b"".join(parts), ">u8").reshape(-1, bits // 64)
    raw = raw[np.lexsort(raw.T)]
    keep = [k for k in range(ceil(least * len(raw)), len(raw))] if len(raw) <= SMALL else []
    some = [xxhash.xxh3_128_digest(raw[list(at)].tobytes(), seed) for k in keep for at in combinations(range(len(raw)), k)]
    return fp, xxhash.xxh3_128_digest(raw.tobytes(), seed), some, first_shingles(raw[:, 0].astype(np.uint64).view(np.int64), least, often)


def first_shingles(items: np.ndarray, least: float, often: Often | None = None) -> np.ndarray:
    """Of a set's different shingles (int64 hashes) the first, rare ones before frequent ones: as many that any set of
    similarity `least` or more has one of them among its own first. Of n shingles such a set has `least` times n at
    least, so the first that both have comes before the last of these. often: hashes in order, and their counts; all
    others are rare. Any order that all sets share would do."""
    if not len(items):
        return items
    keep = len(items) - ceil(least * len(items) - 1e-9) + 1
    if often is None or not len(often[0]):
        return np.sort(items)[:keep]
    at = np.minimum(np.searchsorted(often[0], items), len(often[0]) - 1)
    return items[np.lexsort((items, np.where(often[0][at] == items, often[1][at], 0)))[:keep]]


def _often(docs: DataFrame, size: int, bits: int, seed: int = 42) -> Often:
    """Shingles that stand in several of every TOLD_BY-th text of docs (id, text), and in how many; TOLD at most."""
    digest = _DIGEST[bits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts(b.column("text")):
                raw = np.frombuffer(b"".join([digest(x, seed) for x in set(shingles(t, size))]), ">u8").reshape(-1, bits // 64)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(raw[:, 0].astype(np.uint64).view(np.int64)))], ["item"])

    some = map_batches(docs.where(F.pmod(F.xxhash64("text"), F.lit(TOLD_BY)) == 0).select("text").distinct(), run, "item long")
    found = some.groupBy("item").count().where("count > 1").orderBy(F.desc("count"), "item").limit(TOLD).toArrow().sort_by("item")
    return found.column("item").to_numpy(), found.column("count").to_numpy()


def fingerprints(docs: DataFrame, size: int = 4, bits: int = 64, seed: int = 42) -> DataFrame:
    """doc_id (long), fp (binary of bits / 8 bytes) for every row of docs (doc_id, text); a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t, size, bits, seed) for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "fp"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, fp binary")


def row_id(doc_id: Column, text: Column) -> Column:
    """What tells rows apart: doc_id and 128 bits of both. In its order those without a doc_id come last."""
    return F.struct(F.isnull(doc_id).alias("unnamed"), doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(11), doc_id, text).alias("b"))


def _set_prints(docs: DataFrame, size: int, bits: int, least: float) -> DataFrame:
    """id, fp, digest, parts, firsts (see set_print) for each row of docs (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()
    given = docs.sparkSession.sparkContext.broadcast(_often(docs, size, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [set_print(t, size, bits, least=least, often=given.value) for t in texts(b.column("text"))]
            kinds = (pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([x[k] for x in found], kinds[k]) for k in range(4))], ["id", "fp", "digest", "parts", "firsts"])

    return map_batches(docs, run, f"id {kind}, fp binary, digest binary, parts array<binary>, firsts array<long>")


def spanning(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indices of the links of a minimum spanning forest of n nodes: nearest links first, none that closes a circle."""
    root, kept = np.arange(n), []
    for level in np.unique(d):
        left = np.flatnonzero(d == level)
        while left.size:
            a, b = root[i[left]], root[j[left]]
            apart = a != b
            left, a, b = left[apart], a[apart], b[apart]
            if not left.size:
                break
            upper, first = np.unique(np.maximum(a, b), return_index=True)
            root[upper] = np.minimum(a, b)[first]
            kept.append(left[first])
            while not np.array_equal(root, up := root[root]):
                root = up
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def nearest(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Indices of the links that are among the k nearest of either end."""
    node, at, far = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2), np.concatenate([d, d])
    order = np.lexsort((at, far, node))
    first = np.searchsorted(node[order], node[order])
    return np.unique(at[order][np.arange(len(order)) - first < k])


def compare(a: np.ndarray, b: np.ndarray | None, radius: int, more: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (i, j, distance) of a spanning forest over the rows of a, then b (None: a with itself) within the radius.

    a, b: uint64 matrices, a fingerprint in each row. All pairs are compared, block by block; only links that join
    what was apart are kept, so a group of g near copies gives g - 1 links, not g squared. more = (k, least): besides,
    of the links of more than `least` bits the k nearest of each fingerprint.
    """
    other, n = a if b is None else b, len(a) + (0 if b is None else len(b))
    shift = 0 if b is None else len(a)
    step = max(1, BLOCK // max(1, len(other)))
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)]
    cols = [np.ascontiguousarray(other[:, w]) for w in range(other.shape[1])]

    def forest(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        i, j, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = spanning(n, i, j, d)
        if more[0]:
            loose = np.flatnonzero(d > more[1])
            keep = np.union1d(keep, loose[nearest(i[loose], j[loose], d[loose], more[0])])
        return [i[keep], j[keep], d[keep]]

    waiting, size = [found], 0
    for k in range(0, len(a), step):
        rows, low = a[k : k + step], k if b is None else 0
        far = np.bitwise_count(rows[:, :1] ^ cols[0][None, low:])
        far = far if len(cols) < 4 else far.astype(np.uint16)  # 256 differing bits are one more than a byte holds
        for w in range(1, len(cols)):
            far = far + np.bitwise_count(rows[:, w : w + 1] ^ cols[w][None, low:])
        near = far <= radius
        if b is None:
            near &= np.arange(low, len(other))[None, :] > np.arange(k, k + len(rows))[:, None]
        hit = np.flatnonzero(near)
        if hit.size:
            x, y = np.divmod(hit, near.shape[1])
            waiting.append([x + k, y + low + shift, far.ravel()[hit]])
            size += hit.size
            if size > BLOCK:
                waiting, size = [forest(waiting)], 0
    i, j, d = forest(waiting)
    return i, j, d


def representatives(prints: DataFrame) -> DataFrame:
    """prints: id (of any kind that has an order), fp and any columns that tell texts of equal fingerprints apart. Each
    different fingerprint, with these columns, once: rep, its smallest id, and node, a number of its own, written down so
    that it stays. Partial minima come before the shuffle, so no fingerprint is a hot key."""
    key = [c for c in prints.columns if c != "id"]
    return checkpointed(prints.groupBy(*key).agg(F.min("id").alias("rep")).withColumn("node", F.monotonically_increasing_id()))


def smallest_of(found: DataFrame, reps: DataFrame) -> DataFrame:
    """node, least for each node of a component (found: node, component): the smallest rep in it."""
    named = found.join(reps.select("node", "rep"), "node")
    # cut off, so that both sides of the join are plain shuffles and a large component's rows can be split over tasks
    least = checkpointed(named.groupBy("component").agg(F.min("rep").alias("least")))
    return found.join(least, "component").select("node", "least")


def simhash_links(reps: DataFrame, bits: int, radius: int, tile: int | None = None, more: tuple[int, int] = (0, 0)) -> DataFrame:
    """Links u, v (nodes), distance between different nodes at radius differing bits or fewer. reps: see representatives.

    Equal fingerprints of different texts link at distance 0. Within each pair of tiles links are a minimum spanning
    forest of all links, so components at every distance are those of all links; for `more` see compare.

    Fingerprints are dealt into tiles by population count; pairs of tiles whose counts differ by more than the radius can
    hold no link and are skipped. A tile is bounded, as tiles of a frequent count are split by hash. Counts by
    population reach the driver, no more than bits + 1 numbers, and tile numbers; fingerprints don't.
    """
    spark = reps.sparkSession
    bounded_batches(spark)
    words = [F.conv(F.hex(F.substring("fp", 8 * w + 1, 8)), 16, -10).cast("long") for w in range(bits // 64)]
    count = sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0]))
    width = max(1, (radius + 1) // 4)
    dealt = reps.withColumn("bucket", F.floor(count / width).cast("int"))
    counts = {r["bucket"]: r["count"] for r in dealt.groupBy("bucket").count().collect()}
    tile = tile or min(LARGEST_TILE, max(TILE, sum(counts.values()) // 32))
    sizes = {k: ceil(n / tile) for k, n in counts.items()}
    schema = "u long, v long, distance int"
    if not sizes:
        return spark.createDataFrame([], schema)
    split = F.create_map(*[F.lit(int(x)) for kv in sorted(sizes.items()) for x in kv])
    number = F.col("bucket").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("node"), F.element_at(split, F.col("bucket")))
    tiles = checkpointed(dealt.withColumn("tile", number).groupBy("tile").agg(F.collect_list(F.struct("fp", "node")).alias("items")))
    known = spark.createDataFrame([(b, b << 32 | k) for b, n in sorted(sizes.items()) for k in range(n)], "bucket int, tile long")
    # buckets reach as far as counts can differ: (c - b - 1) * width + 1 <= radius
    reach = (radius - 1) // width + 1 if radius else 0
    pairs = known.select(F.col("tile").alias("a"), F.explode(F.sequence("bucket", F.col("bucket") + reach)).alias("bucket"))
    pairs = pairs.join(known.withColumnRenamed("tile", "b"), "bucket").where("b >= a").select("a", "b")
    left = tiles.select(F.col("tile").alias("a"), F.col("items").alias("x"))
    right = tiles.select(F.col("tile").alias("b"), F.col("items").alias("y"))
    work = pairs.join(left, "a").join(right, "b")

    def matrix(items: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(items.values.field("fp").to_pylist())
        return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, bits // 64), items.values.field("node").to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x, y in zip(*(batch.column(c) for c in ("a", "b", "x", "y")), strict=True):
                m, ids = matrix(x)
                other = None
                if a.as_py() != b.as_py():
                    other, theirs = matrix(y)
                    ids = np.concatenate([ids, theirs])
                i, j, d = compare(m, other, radius, more)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(ids[j], pa.int64()), pa.array(d.astype(np.int32))], ["u", "v", "distance"])

    return work.mapInArrow(run, schema)


def simhash_components(docs: DataFrame, size: int = 4, bits: int = 64, radius: int = 4, seed: int = 42, tile: int | None = None) -> DataFrame:
    """doc_id, fp (binary), component_id, for every row of docs (doc_id, text; other columns are ignored).

    Documents link at radius differing bits or fewer; component_id is the smallest doc_id that can be reached, the
    document's own included. Null and empty texts have no words: their fingerprint is zero and links like any other.
    Rows that repeat come back as often. Rows without a doc_id link like others, so what they are near to is joined through
    them; a component_id is null only if no doc_id can be reached. A very long text costs memory for its shingles alone.
    """
    prints = checkpointed(fingerprints(docs, size, bits, seed))
    # rows without a doc_id come last in order
    reps = representatives(prints.select("fp", F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id").alias("id")))
    found = connected_components(simhash_links(reps, bits, radius, tile).select("u", "v"))
    of = reps.join(smallest_of(found, reps), "node", "left").select("fp", F.coalesce("least", "rep")["doc_id"].alias("component_id"))
    return prints.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def _lists(keyed: DataFrame, most: int) -> DataFrame:
    """members, long: the nodes of keyed (key, node) that share a key, in order, of keys that several have; those of a key
    that more than `most` have come in pieces, marked as long. A task holds no more than `most` nodes of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, long = np.zeros(0, np.int64), None, False  # the nodes of the last key, which may go on

        def rows(values: np.ndarray, sizes: np.ndarray, long: bool) -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array([long] * len(sizes), pa.bool_())], ["members", "long"])

        for b in batches:
            key, node = (b.column(c).to_numpy() for c in ("key", "node"))
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[new], node[new]
            goes_on = now is not None and key[0] == now
            if goes_on and len(held) and held[-1] == node[0]:
                key, node = key[1:], node[1:]
            if not len(key):
                continue
            if not goes_on:
                if len(held) > 1 or long and len(held):
                    yield rows(held, np.array([len(held)]), long)
                held, long = np.zeros(0, np.int64), False
            key, node = np.concatenate([np.full(len(held), key[0]), key]), np.concatenate([held, node])
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            was = long
            long = was and len(starts) == 1 or int(sizes[-1]) > most
            marked = sizes > most
            marked[0] |= was
            marked[-1] = long
            whole = np.flatnonzero((sizes > 1) & ~marked)
            whole = whole[whole < len(sizes) - 1]
            if whole.size:
                yield rows(node[np.repeat(np.isin(np.arange(len(sizes)), whole), sizes)], sizes[whole], False)
            for k in np.flatnonzero(marked).tolist():
                if k < len(sizes) - 1 or sizes[k] > 1:
                    yield rows(node[starts[k] : starts[k] + sizes[k]], sizes[k : k + 1], True)
            now = int(key[-1])
            held = node[-1:] if long else node[starts[-1] :]
        if len(held) > 1 or long and len(held):
            yield rows(held, np.array([len(held)]), long)

    return map_batches(keyed.repartition("key").sortWithinPartitions("key", "node"), run, "members array<long>, long boolean")


def set_links(prints: DataFrame, reps: DataFrame, bits: int, radius: int, tile: int | None, more: tuple[int, int], most: int = LIST) -> DataFrame:
    """u, v: links between sets that share one of their first shingles and whose fingerprints are within the radius, so that all
    similar ones are joined. prints: id, firsts; reps: see representatives.

    Sets are looked up by their first shingles, as no similar set has none of these, and compared with those they share one with:
    a spanning forest of each list. Lists that repeat, as those of a text and its copy do for each shingle, are compared once. Of
    keys that more than `most` sets have, which are copies or all but copies, all sets are compared once with each
    other instead, in tiles, see simhash_links.
    """
    keyed = prints.select("id", "firsts").join(reps.select(F.col("rep").alias("id"), "node"), "id").select(F.explode("firsts").alias("key"), "node")
    lists = checkpointed(_lists(keyed, most).distinct().withColumn("list", F.monotonically_increasing_id()))
    long = reps.join(lists.where("long").select(F.explode("members").alias("node")).distinct(), "node", "left_semi")
    rows = lists.where("not long").select("list", F.explode("members").alias("node")).join(reps.select("node", "fp"), "node")

    def linked(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        m = np.frombuffer(b"".join(t.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, bits // 64)
        ids, at = t.column("node").to_numpy(), t.column("list").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
        two = cuts[:-1][np.diff(cuts) == 2]
        near = np.bitwise_count(m[two] ^ m[two + 1]).sum(axis=1, dtype=np.int64) <= radius
        u, v = [ids[two[near]]], [ids[two[near] + 1]]
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if y - x > 2:
                i, j, _ = compare(m[x:y], None, radius, more)
                u.append(ids[x:y][i])
                v.append(ids[x:y][j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for b in batches:
            at = b.column("list").to_numpy()
            if not len(at):
                continue
            # all lists but the last are whole
            cut = int(np.searchsorted(at, at[-1]))
            if parts and (cut or at[-1] != parts[-1].column("list")[-1].as_py()):
                yield linked([*parts, b.slice(0, cut)])
                parts = []
            elif cut:
                yield linked([b.slice(0, cut)])
            parts.append(b.slice(cut))
        if parts:
            yield linked(parts)

    found = map_batches(rows.repartition("list").sortWithinPartitions("list", "node"), run, "u long, v long")
    return found.unionByName(simhash_links(checkpointed(long), bits, radius, tile, more).select("u", "v")).distinct()


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """node, shingles (array of the different shingles' hashes) for each row of docs (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list({int.from_bytes(xxhash.xxh64_digest(x, 42), "big", signed=True) for x in shingles(t, size)}) for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    return map_batches(docs, run, "node long, shingles array<long>")


def true_links(m: np.ndarray, sizes: np.ndarray, items: np.ndarray, labels: np.ndarray, first: int, radius: int, least: float) -> list[tuple[int, int]]:
    """Links (i, j) of similarity `least` or more that join all labels which such links between candidates join.

    m: uint64 matrix of fingerprints; sizes: the texts' numbers of different shingles; items: these, one text after the
    other; labels: what is joined already. Candidates are the pairs within the radius of the first `first` rows and the
    others (first = 0: of all rows). Each is verified unless links found before have joined its ends.
    """
    items = np.unique(items, return_inverse=True)[1]
    ends, root, flag = np.cumsum(sizes), labels.copy(), np.zeros(len(items), bool)
    starts, links = ends - sizes, []
    step = max(1, BLOCK // max(1, len(m)))
    for k in range(0, first or len(m), step):
        rows, low = m[k : min(k + step, first or len(m))], first or k + 1
        some = slice(k, k + len(rows))
        far = np.zeros((len(rows), len(m) - low), np.uint16)
        for w in range(m.shape[1]):
            far += np.bitwise_count(rows[:, w : w + 1] ^ m[None, low:, w])
        near = (far <= radius) & (root[some, None] != root[None, low:])
        near &= np.minimum(sizes[some, None], sizes[None, low:]) >= least * np.maximum(sizes[some, None], sizes[None, low:])
        for i in (np.flatnonzero(near.any(axis=1)) + k).tolist():
            j = np.flatnonzero(near[i - k]) + low
            j = j[(root[j] != root[i]) & (j > i)]
            if not j.size:
                continue
            mine, n = items[starts[i] : ends[i]], sizes[j]
            flag[mine] = True
            offset = np.cumsum(n) - n
            common = np.add.reduceat(flag[items[np.arange(n.sum()) + np.repeat(starts[j] - offset, n)]].astype(np.int64), offset)
            flag[mine] = False
            j = j[common >= least * (sizes[i] + n - common)]
            if j.size:
                joined, at = np.unique(root[j], return_index=True)
                links += [(i, x) for x in j[at].tolist()]
                root[np.isin(root, joined)] = root[i]
    return links


def _remaining(nodes: DataFrame, bits: int, radius: int, least: float, set_tile: int) -> DataFrame:
    """u, v: true links that join what candidates within a group can join. nodes: group, label, fp, node, shingles.

    Groups are dealt into tiles of about set_tile shingles by hash; every pair of a group's tiles is compared by one
    task at a time, so memory is bounded at any size of a group, and texts of a group that fits one tile are sent once.
    """
    total = nodes.groupBy("group").agg(F.ceil(F.sum(F.size("shingles").cast("long") + 32) / set_tile).cast("long").alias("tiles"))
    dealt = nodes.join(total, "group").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    key = ["group", "low", "high"]
    dealt = dealt.select("group", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "label", "fp", "node", "shingles")
    # a pair of tiles is a run of rows, the lower tile's first
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "tile")

    def verify(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        col = {c: t.column(c).combine_chunks() for c in t.column_names}
        m = np.frombuffer(b"".join(col["fp"].to_pylist()), ">u8").astype(np.uint64).reshape(-1, bits // 64)
        tile, ids, labels = (col[c].to_numpy(zero_copy_only=False) for c in ("tile", "node", "label"))
        sizes = np.diff(col["shingles"].offsets.to_numpy()).astype(np.int64)
        pair = col["low"][0].as_py() != col["high"][0].as_py()
        first = int(np.searchsorted(tile, col["high"][0].as_py())) if pair else 0
        links = true_links(m, sizes, col["shingles"].flatten().to_numpy(), labels, first, radius, least) if not pair or 0 < first < len(m) else []
        u, v = np.array(links, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(ids[u], pa.int64()), pa.array(ids[v], pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in key], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
            for x, y in zip(cuts, cuts[1:]):
                if parts and tuple(keys[x]) != now:
                    yield verify(parts)
                    parts = []
                now = tuple(keys[x])
                parts.append(b.slice(x, y - x))
        if parts:
            yield verify(parts)

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8, bits: int = 256, radius: int = 84, tile: int | None = None, set_tile: int = SET_TILE, most: int = LIST) -> DataFrame:
    """id, component for every different pair of doc_id and text in docs (doc_id, text; others are ignored): near-duplicate
    groups. id is row_id of the pair, component the smallest id in the group, so the rows whose id is their component
    are one of each group.

    Documents link if the Jaccard similarity of their sets of word shingles is `least` or more. Equal sets, told by a
    digest, are grouped first; equal fingerprints of different sets are candidates like any others.
    Candidates are sets that share one of their first shingles, as all similar ones do, and whose fingerprints are near, see
    set_links. Fingerprints are of that many bits over the different shingles, so passages that a text repeats count
    once there too: at a similarity of 0.8, 256 bits differ in 39 places on average
    with a deviation of 6, so that more than 84 differ in fewer than one of 10^14 such pairs, while texts that share
    nothing come that near once in 10^7. Sets of few shingles, where it may be 48 places, don't rely on that: of two
    similar sets of which one has SMALL shingles at most, unless both have nine or more, the smaller is a part of the
    other, and such parts are looked up by their digests. Of the candidates a spanning forest, nearest first, and each
    text's three nearest beyond 28 bits, below which links hardly ever fail, are verified on exact shingle sets first.
    Where links fail and leave apart what candidates join, all candidates between the parts are verified as well, so
    groups are those of all true candidates. Texts without words are equal. Rows that share a doc_id but not the text are
    different, rows without a doc_id take part like others, equal rows are one. A very long text costs memory for its
    shingles alone.
    """
    doc_id, text = docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit(""))
    docs = docs.select(row_id(doc_id, text).alias("id"), text.alias("text"))
    prints = checkpointed(_set_prints(docs, size, bits, least))
    reps = representatives(prints.drop("parts", "firsts"))
    # each different set with its similar parts, as many as a small set has, and those of them that are sets of texts
    parts = prints.where(F.size("parts") > 0).select("digest", F.explode("parts").alias("part")).distinct()
    parts = parts.join(reps.select("digest", F.col("node").alias("v")), "digest").join(reps.select(F.col("digest").alias("part"), F.col("node").alias("u")), "part")
    parts = checkpointed(parts.select("u", "v"))
    links = checkpointed(set_links(prints, reps, bits, radius, tile, (3, int(0.11 * bits)), most))
    released(docs.sparkSession)
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(reps.select("node", F.col("rep").alias("id")), "node")
    sets = _sets(docs.join(ends, "id").select("node", "text"), size).groupBy("node").agg(F.max("shingles").alias("shingles"))
    sets = checkpointed(sets)
    both = links.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    true = both.withColumn("common", common).select("u", "v", (F.col("common") >= least * (F.size("a") + F.size("b") - F.col("common"))).alias("same"))
    true = checkpointed(true)
    ends = both = None
    released(docs.sparkSession)
    found = connected_components(true.where("same").select("u", "v").unionByName(parts))
    # failed links between different components join them to groups, and no candidate lies outside of one
    label = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_label"))
    failed = true.where("not same").join(label("u"), "u", "left").join(label("v"), "v", "left")
    failed = failed.select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v")).where("u <> v")
    groups = connected_components(failed).select(F.col("node").alias("label"), F.col("component").alias("group"))
    nodes = reps.select("node", "fp").join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).join(groups, "label")
    nodes = nodes.join(sets, "node").select("group", "label", "fp", "node", "shingles")
    rest = checkpointed(_remaining(nodes, bits, radius, least, set_tile))
    failed = groups = nodes = None
    released(docs.sparkSession)
    if not rest.isEmpty():
        found = connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(rest))
    of = reps.join(smallest_of(found, reps), "node", "left").select("fp", "digest", F.coalesce("least", "rep").alias("component"))
    # partial groups before the shuffle: equal rows are one, however many
    return prints.join(of, ["fp", "digest"], "left").groupBy("id").agg(F.min("component").alias("component"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each near-duplicate group of docs one row: of the smallest doc_id and, where it has several texts or rows, always
    the same one. Rows without a doc_id stay only if nothing in their group has one. All columns stay."""
    made = near_duplicates(docs).where("id = component").select("id")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(row_id(docs["doc_id"].cast("long"), text).alias("id"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    first = rows.join(made, "id", "left_semi").groupBy("id").agg(F.min("row").alias("row"))
    return unwrapped(first, docs, ())
