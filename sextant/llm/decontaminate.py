"""Benchmark decontamination with suffix arrays over shards of the training documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import checkpointed, map_batches, unwrapped, wrapped

#: A word's characters: all but these ASCII ones; A-Z are lower-cased before.
_SPACES = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(_SPACES + bytes(range(0x41, 0x5B)), b" " * len(_SPACES) + bytes(range(0x61, 0x7B)))
#: Words of a shard, at least one document; bytes of benchmark words held at once: the index of a block takes about 25
#: times as many, so 100 MB, on the driver and in each worker.
SHARD_WORDS, BLOCK_BYTES = 1 << 19, 4 << 20
#: Blocks that are searched for in one reading of the documents, each in a worker of its own.
CHAINED = 4

Item = tuple[str | None, list[bytes]]


def words(text: str) -> list[bytes]:
    """Runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Tests:
    """A block of benchmark items as word numbers, its suffixes in order, and the windows that count as contamination."""

    vocabulary: dict[bytes, int]
    names: list[str | None]
    #: All items' words, each item closed by -1; at each word the number of its item.
    stream: np.ndarray
    item: np.ndarray
    #: All suffixes as positions in the stream, in order, and at each position how many words are left of the item.
    suffixes: np.ndarray
    left: np.ndarray
    #: Of each different window: one position in the stream, its length, and as CSR the items that have it.
    starts: np.ndarray
    lengths: np.ndarray
    ends: np.ndarray
    owners: np.ndarray
    #: At each position in the stream the number of the window there, or -1.
    window: np.ndarray

    @classmethod
    def of(cls, items: Iterable[Item], window: int) -> Tests:
        vocabulary: dict[bytes, int] = {}
        names, parts, sizes = [], [], []
        for name, w in items:
            if w:
                names.append(name)
                parts.append(np.fromiter((vocabulary.setdefault(x, len(vocabulary)) for x in w), np.int64, len(w)))
                parts.append(np.array([-1]))
                sizes.append(len(w))
        stream = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64) + 1)
        left = runs(stream)
        need = np.minimum(window, np.array(sizes, np.int64))[item] if sizes else left
        ranks = Ranks(stream, max(sizes, default=1))
        suffixes = ranks.sorted(np.flatnonzero(stream >= 0))
        # windows that are equal stand side by side among the suffixes that hold one
        at = suffixes[left[suffixes] >= need[suffixes]]
        agree, _ = ranks.compare(at[1:], at[:-1], need[at[:-1]]) if len(at) else (np.zeros(0, np.int64), None)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (agree < need[at[:-1]]) | (need[at[1:]] != need[at[:-1]])
        number = np.cumsum(fresh) - 1
        of = np.full(len(stream), -1, np.int64)
        of[at] = number
        # a window of a whole short item may stand between those of longer ones that begin with it
        order = np.lexsort((item[at], number))
        pairs = np.unique(np.stack([number[order], item[at][order]], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        return cls(vocabulary, names, stream, item, suffixes, left, at[fresh], need[at[fresh]], np.searchsorted(pairs[:, 0], np.arange(int(fresh.sum()) + 1)), pairs[:, 1], of)

    @property
    def least(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 1

    @property
    def longest(self) -> int:
        return int(self.left.max()) if len(self.left) else 1

    def items_of(self, numbers: np.ndarray) -> list[str]:
        """The names of the items that have one of these windows, sorted."""
        found = {x for k in numbers.tolist() for x in self.owners[self.ends[k] : self.ends[k + 1]].tolist()}
        return sorted({n for x in found if (n := self.names[x]) is not None})


def suffix_array(text: np.ndarray, begin: np.ndarray, depth: int) -> np.ndarray:
    """The positions `begin` of text in the order of the suffixes there, compared to at least `depth` numbers; see Ranks."""
    return Ranks(text, depth).sorted(begin)


class Ranks:
    """Ranks of all positions of a text by their first 1, 2, 4, ... numbers, -1 included as an end: two suffixes are compared in as
    many steps as there are ranks, however much they agree in.

    text: numbers from 0, -1 where a suffix ends. Ranks are doubled: each round sorts by the ranks of two halves, until
    `depth` numbers are compared or nothing is told apart any more.
    """

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.text, self.left = text, runs(text)
        rank, have = text.astype(np.int64), 1
        self.levels, self.whole = [rank.astype(np.int32)], False
        while have < depth:
            ahead = np.full(len(rank), -1, np.int64)
            ahead[: max(0, len(rank) - have)] = rank[have:]
            ahead[rank < 0] = -1
            live = np.flatnonzero(rank >= 0)
            if not live.size:
                break
            key = rank[live] * (int(rank.max()) + 2) + ahead[live] + 1
            order = np.argsort(key, kind="stable")
            step = np.zeros(len(order), np.int64)
            step[1:] = np.cumsum(key[order][1:] != key[order][:-1])
            fresh = np.full(len(rank), -1, np.int64)
            fresh[live[order]] = step
            # as many ranks as before: what is equal now is equal to the end
            self.whole = bool(have > 1 and step[-1] == rank.max())
            rank, have = fresh, 2 * have
            if self.whole:
                break
            self.levels.append(rank.astype(np.int32))
        self.rank = rank

    def sorted(self, begin: np.ndarray) -> np.ndarray:
        """Positions in the order of the suffixes there."""
        return begin[np.argsort(self.rank[begin], kind="stable")]

    def compare(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of suffixes: how many numbers agree, at most length, and the sign of the first difference."""
        agree, last = np.zeros(len(a), np.int64), len(self.text) - 1
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            x, y = level[np.minimum(a + agree, last)], level[np.minimum(b + agree, last)]
            same = (x == y) & (x >= 0) & (agree < length)
            # the last rank reaches as far as is asked for, or tells that all is equal
            agree[same] = length[same] if self.whole and k == len(self.levels) - 1 else agree[same] + step
        # ranks tell ends apart only by where they are: nothing agrees beyond one
        agree = np.minimum(np.minimum(agree, length), np.minimum(self.left[a], self.left[b]))
        x, y = self.text[np.minimum(a + agree, last)], self.text[np.minimum(b + agree, last)]
        return agree, np.where(agree >= length, 0, np.where(x < y, -1, 1))


def bounds(ranks: Ranks, suffixes: np.ndarray, start: np.ndarray, length: np.ndarray, upper: bool = False) -> np.ndarray:
    """Where each prefix (start, length) would stand among sorted suffixes, all of them positions in one text: before all that
    begin with it, or with `upper` behind them. Binary search, for all prefixes at once."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(suffixes), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        _, sign = ranks.compare(suffixes[mid], start[open_], length[open_])
        right = (sign < 0) | (upper & (sign == 0))
        low[open_] = np.where(right, mid + 1, low[open_])
        high[open_] = np.where(right, high[open_], mid)
    return low


def runs(text: np.ndarray) -> np.ndarray:
    """For each position how many numbers from 0 follow one another from there."""
    stops = np.flatnonzero(text < 0)
    nxt = stops[np.searchsorted(stops, np.arange(len(text)))] if len(text) else stops
    return nxt - np.arange(len(text))


class Shard:
    """Documents as one text of word numbers, a -1 after each; words that no test has are -1 as well."""

    def __init__(self, tests: Tests, documents: list[np.ndarray]) -> None:
        self.tests = tests
        self.lengths = np.array([len(d) for d in documents], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        end = np.array([-1])
        self.text = np.concatenate([x for d in documents for x in (d, end)]) if documents else np.zeros(0, np.int64)
        # what stands between unknown words, or ends, and is shorter than the shortest window holds none
        left = runs(self.text)
        begin = np.flatnonzero((left > 0) & np.concatenate([[True], left[:-1] == 0])) if len(left) else left
        short = begin[left[begin] < tests.least]
        drop = np.repeat(short, left[short]) + np.arange(int(left[short].sum())) - np.repeat(np.cumsum(left[short]) - left[short], left[short])
        self.text[drop] = -1
        left[drop] = 0
        # the tests' words stand behind the shard's, so that both are compared by the same ranks
        self.shift = len(self.text)
        self.ranks = Ranks(np.concatenate([self.text, tests.stream]), tests.longest)
        self.suffixes = self.ranks.sorted(np.flatnonzero(left >= tests.least))

    @classmethod
    def of(cls, tests: Tests, documents: list[list[bytes]]) -> Shard:
        return cls(tests, [numbers(tests, d) for d in documents])

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every suffix of every item, at its position in the tests' stream: the longest verbatim match in this
        shard (0 if shorter than the shortest window) and the place in the text of one such match (-1). Each suffix
        is binary-searched: its neighbours, where it would stand, share most with it."""
        t = self.tests
        start = t.suffixes
        best, place = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64)
        if len(self.suffixes) and len(start):
            low = bounds(self.ranks, self.suffixes, start + self.shift, t.left[start])
            for near in (low - 1, low):
                at = self.suffixes[np.clip(near, 0, len(self.suffixes) - 1)]
                agree, _ = self.ranks.compare(at, start + self.shift, t.left[start])
                better = agree > best
                best, place = np.where(better, agree, best), np.where(better, at, place)
        return start, np.where(best >= t.least, best, 0), np.where(best >= t.least, place, -1)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Each occurrence of a window: its number, and its position in the text. A window occurs if the longest match of
        a suffix that begins with it is as long as it; its occurrences are a range of the suffix array."""
        t = self.tests
        start, best, _ = self.longest()
        of = t.window[start]
        some = np.unique(of[(of >= 0) & (best >= t.lengths[of] if len(t.lengths) else False)])
        if not len(some):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = (bounds(self.ranks, self.suffixes, t.starts[some] + self.shift, t.lengths[some], upper) for upper in (False, True))
        times = high - low
        inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(some, times), self.suffixes[np.repeat(low, times) + inside]

    def verbatim(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest match of any item's words with the text from each position, and where in the stream it begins."""
        t = self.tests
        best, where = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
        if not len(t.suffixes):
            return best, where
        low = bounds(self.ranks, t.suffixes + self.shift, at, self.ranks.left[at])
        for near in (low - 1, low):
            start = t.suffixes[np.clip(near, 0, len(t.suffixes) - 1)]
            agree, _ = self.ranks.compare(at, start + self.shift, t.left[start])
            better = agree > best
            best, where = np.where(better, agree, best), np.where(better, start, where)
        return best, where

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def numbers(tests: Tests, document: list[bytes]) -> np.ndarray:
    get = tests.vocabulary.get
    return np.fromiter((get(w, -1) for w in document), np.int64, len(document))


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[list[Item]]:
    """The stated benchmark in blocks of about block_bytes of words, streamed partition by partition; at least one block.

    An item that is longer is cut into parts that share window - 1 words, so none of its windows is lost.
    """
    rows: list[Item] = []
    size = 0
    for r in benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].cast("string").alias("text")).toLocalIterator():
        w = words(r["text"] or "")
        step = len(w) if sum(map(len, w)) + len(w) <= block_bytes else max(1, block_bytes // 64)
        for k in range(0, max(1, len(w) - window + 1), max(1, step)):
            part = w[k : k + step + (window - 1 if step < len(w) else 0)]
            more = sum(map(len, part)) + len(part)
            if rows and size + more > block_bytes:
                yield rows
                rows, size = [], 0
            rows.append((r["item_id"], part))
            size += more
    yield rows


def _shards(batches: Iterator[pa.RecordBatch], tests: Tests, shard_words: int) -> Iterator[tuple[list[pa.RecordBatch], Shard]]:
    """Consecutive rows of a partition, over as many batches as it takes, until they have shard_words words."""
    parts, found, size = [], [], 0
    for b in batches:
        column, begin = b.column("text"), 0
        for k in range(len(column)):
            found.append(numbers(tests, words(column[k].as_py() or "")))
            size += len(found[-1])
            if size >= shard_words:
                yield [*parts, b.slice(begin, k + 1 - begin)], Shard(tests, found)
                parts, found, size, begin = [], [], 0, k + 1
        if begin < len(column):
            parts.append(b.slice(begin))
    if found:
        yield parts, Shard(tests, found)


_LONGEST = "struct<n_words: bigint, doc_word: bigint, item: string, item_word: bigint>"
_FOUND = pa.struct([("n_words", pa.int64()), ("doc_word", pa.int64()), ("item", pa.string()), ("item_word", pa.int64())])


def _searched(docs: DataFrame, tests: Tests, shard_words: int, again: bool) -> DataFrame:
    """docs: row, text, and if again also hits, items and longest, which are carried on. Adds or carries on n_words, hits
    (array of [first, after] word places, in order and apart), items (sorted) and longest."""
    given = docs.sparkSession.sparkContext.broadcast(tests)

    def merged(spans: list[list[int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for first, after in spans:
            if out and first <= out[-1][1]:
                out[-1][1] = max(out[-1][1], after)
            else:
                out.append([first, after])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = given.value
        for parts, shard in _shards(batches, t, shard_words):
            which, at = shard.windows()
            order = np.argsort(at, kind="stable")
            which, at = which[order], at[order]
            cut = np.searchsorted(at, [*shard.starts, len(shard.text)])
            some, place = shard.verbatim(np.unique(at))
            first = np.searchsorted(np.unique(at), [*shard.starts, len(shard.text)])
            spot = np.unique(at)
            doc = 0
            for b in parts:
                hits, items, longest = [], [], []
                for k in range(b.num_rows):
                    x, y = cut[doc], cut[doc + 1]
                    a = at[x:y] - shard.starts[doc]
                    spans = merged(np.stack([a, a + t.lengths[which[x:y]]], axis=1).tolist()) if y > x else []
                    names, most = t.items_of(np.unique(which[x:y])) if y > x else [], None
                    if y > x:
                        j = first[doc] + int(some[first[doc] : first[doc + 1]].argmax())
                        p = int(place[j])
                        begin = p - int(np.searchsorted(t.item[: p + 1], t.item[p]))
                        most = {"n_words": int(some[j]), "doc_word": int(spot[j] - shard.starts[doc]), "item": t.names[t.item[p]], "item_word": begin}
                    if again:
                        before = {c: b.column(c)[k].as_py() for c in ("hits", "items", "longest")}
                        spans, names = merged(sorted([*before["hits"], *spans])), sorted({*before["items"], *names})
                        if before["longest"] and (not most or before["longest"]["n_words"] >= most["n_words"]):
                            most = before["longest"]
                    hits.append(spans)
                    items.append(names)
                    longest.append(most)
                    doc += 1
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), b.column("text"), pa.array(shard.lengths[doc - b.num_rows : doc]), pa.array(hits, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string())), pa.array(longest, _FOUND)],
                    ["row", "text", "n_words", "hits", "items", "longest"],
                )

    kind = docs.schema["row"].dataType.simpleString()
    return map_batches(docs, run, f"row {kind}, text string, n_words long, hits array<array<long>>, items array<string>, longest {_LONGEST}")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns item (string), item_word, n_words, doc_id, doc_word (long): for every test suffix the longest verbatim
    match within each shard of docs, and one place of it, where it is at least as long as the shortest window. For
    inspection: a shard is some documents of one partition, so a suffix has a row for each shard that holds a match.

    Null and empty texts and items match nothing; items without an id have a null item; columns other than those named are
    ignored, whatever their names. A very long text is a shard by itself, held in memory with ranks for each power of
    two up to the longest item. Suffixes of an item cut for its length count from where the part begins. More than one
    block of the benchmark: results of each are put together.
    """
    out = None
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    for block in _blocks(benchmark, window, block_bytes):
        given = docs.sparkSession.sparkContext.broadcast(Tests.of(block, window))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            t = given.value
            for parts, shard in _shards(batches, t, shard_words):
                start, best, place = shard.longest()
                some = np.flatnonzero(best)
                owner = shard.document(place[some])
                ids = pa.chunked_array([b.column("doc_id") for b in parts]).take(pa.array(owner)).combine_chunks()
                item = t.item[start[some]]
                begin = start[some] - np.searchsorted(t.item, item)
                yield pa.RecordBatch.from_arrays([pa.array([t.names[k] for k in item.tolist()], pa.string()), pa.array(begin), pa.array(best[some]), ids, pa.array(place[some] - shard.starts[owner])], ["item", "item_word", "n_words", "doc_id", "doc_word"])

        part = map_batches(rows, run, "item string, item_word long, n_words long, doc_id long, doc_word long")
        out = part if out is None else out.unionByName(part)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every row of docs (doc_id, text; all other columns stay): n_words, n_hit (long), items (array of string,
    sorted), contaminated (boolean), hits (array of [first, after]: the hit places, in words) and longest (the longest
    verbatim match that holds a window: n_words, doc_word, item, item_word; else null). Columns of docs with those names,
    in any case, are replaced; any other names do no harm.

    Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] with A-Z lower-cased. A window is `window` consecutive words of an
    item of benchmark (item_id, text), or all words of a shorter one. A document word inside any occurrence of a window
    is hit; contaminated: n_hit > 0 and share * n_hit >= n_words. Null and empty texts have no words; items without
    words have no window; an item whose id is null hits words but is not listed. Repeated rows and items do no harm.

    A shard is consecutive documents of a partition, of shard_words words or one document of any length. Its suffix
    array is sorted by rank doubling as deep as the longest item; every suffix of every item is binary-searched in it
    for its longest match, and where that holds a window all occurrences are read from the array. Documents never move.
    The benchmark is a stated query set. It is indexed on the driver and sent out one block of about block_bytes at a
    time, whatever its size; CHAINED blocks are searched for in one reading of the rows, after which these are written
    down with what was found. Suffixes are compared by ranks, so a document that holds a long item, or is one, takes
    little more time than others of its length.
    """
    spark = docs.sparkSession
    made = ("n_words", "n_hit", "items", "contaminated", "hits", "longest")
    rows = wrapped(docs, made, text="string")
    blocks = _blocks(benchmark, window, block_bytes)
    for k, block in enumerate(blocks):
        if k and k % CHAINED == 0:
            rows = checkpointed(rows)
        rows = _searched(rows, Tests.of(block, window), shard_words, k > 0)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    rows = rows.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    return unwrapped(rows, docs, made)


def items_digest(items: list[str]) -> str:
    """Lowercase hex SHA-256 of sorted items joined by commas."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
