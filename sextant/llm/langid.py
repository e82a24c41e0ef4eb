"""Language identification with hyperdimensional profiles: bound letters, bundled n-grams, prototypes by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import map_batches, texts

#: Components of a vector, letters of an n-gram.
DIMENSIONS, GRAM = 512, 3
#: Vectors of letters and of n-grams that a worker remembers; a full memory is emptied.
LETTERS, GRAMS = 4096, 16_384
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_CODE = 21


class Space:
    """Random letter vectors of +1 and -1, made from the letter's code point alone, so all workers have the same."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 1) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.index: dict[int, int] = {}
        self.grams = np.zeros((GRAMS, dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= LETTERS:
                self.letters.clear()
            rng = np.random.Generator(np.random.Philox(key=self.seed << 32 | code))
            self.letters[code] = rng.integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return self.letters[code]

    def gram(self, code: int) -> np.ndarray:
        """An n-gram's vector: its letters' vectors, each rotated by its distance from the last, multiplied."""
        out = np.ones(self.dimensions, np.int8)
        for k in range(GRAM):
            out = out * np.roll(self.letter(code >> _CODE * k & (1 << _CODE) - 1), k)
        return out

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Places of the n-grams' vectors in self.grams; up to GRAMS different codes at a time."""
        known = self.index
        missing = [c for c in codes.tolist() if c not in known]
        if len(known) + len(missing) > GRAMS:
            known.clear()
            missing = codes.tolist()
        for c in missing:
            self.grams[len(known)] = self.gram(c)
            known[c] = len(known)
        return np.fromiter(map(known.__getitem__, codes.tolist()), np.int64, len(codes))

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the n-grams' vectors, each times its count."""
        out = np.zeros(self.dimensions)
        for k in range(0, len(codes), GRAMS):
            at = self.rows(codes[k : k + GRAMS])
            out += counts[k : k + GRAMS].astype(np.float32) @ self.grams[at]
        return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text's letters and their counts: lower case, all between words one space, as at both
    ends. No letters: none."""
    if not _LETTER.search(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer((" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = points[: len(points) - GRAM + 1].copy()
    for k in range(1, GRAM):
        codes = codes << _CODE | points[k : len(points) - GRAM + 1 + k]
    return np.unique(codes, return_counts=True)


_SPACES: dict[tuple[int, int], Space] = {}


def _space(dimensions: int, seed: int) -> Space:
    return _SPACES.setdefault((dimensions, seed), Space(dimensions, seed))


def fit(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = 1) -> dict[str, np.ndarray]:
    """Language -> prototype: the bundle of all n-grams of all rows of docs (text, lang) with that lang, null ones left out.

    Each batch leaves one sum a language; these are added up in two steps, so no task adds more than a share of them.
    The languages' sums, `dimensions` numbers each, reach the driver. Prototypes are what sets a language apart: scaled to
    length 1, less half of what all have in common.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total = _space(dimensions, seed), {}
        for b in batches:
            found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for text, lang in zip(texts(b.column("text")), b.column("lang").to_pylist(), strict=True):
                if lang is not None:
                    found.setdefault(lang, []).append(grams(text))
            for lang, parts in found.items():
                codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([n for _, n in parts]), len(codes)) if len(codes) else np.zeros(0)
                total[lang] = total.get(lang, 0) + space.bundle(codes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["lang", "v"])

    def added(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(table), -1).sum(axis=0)
        return pa.table({"lang": table.column("lang").slice(0, 1), "v": pa.array([v], pa.list_(pa.float64()))})

    kind = "lang string, v array<double>"
    part = map_batches(docs.select(docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")), sums, kind)
    part = part.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    part = part.groupBy("lang", "salt").applyInArrow(lambda t: added(t.select(["lang", "v"])), kind)
    rows = part.groupBy("lang").applyInArrow(added, kind).orderBy("lang").collect()
    unit = {r["lang"]: np.array(r["v"]) / (np.linalg.norm(r["v"]) or 1.0) for r in rows}
    unit = {k: v for k, v in unit.items() if v.any()}
    common = sum(unit.values()) / (2 * len(unit)) if len(unit) > 1 else 0
    return {k: v - common for k, v in unit.items()}


def language_id(docs: DataFrame, training: Column, dimensions: int = DIMENSIONS, seed: int = 1) -> DataFrame:
    """doc_id, lang_pred (string), score (double, 0 to 1) for every row of docs (doc_id, text, lang; others are ignored).

    Learns from text and lang of the rows where `training` holds and lang is not null, all of them, whole; the
    prediction sees the text alone. lang_pred is the language whose prototype has the largest cosine with the bundle of
    the text's n-grams (ties: the first in order), score that cosine, 0 if negative. A text that is null or has no
    letter is `und` with score 0, as is every text if nothing can be learned. Repeated rows come back as often. A very
    long text costs memory for its letters; its n-grams are bundled in bounded parts.
    """
    prototypes = fit(docs.where(training & F.col("lang").isNotNull()).select("text", "lang"), dimensions, seed)
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1.0) for n in names])
    given = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, (names, matrix) = _space(dimensions, seed), given.value
        for b in batches:
            langs, scores = [], []
            for text in texts(b.column("text")):
                codes, counts = grams(text)
                if not len(codes) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                v = space.bundle(codes, counts)
                cosines = matrix @ v / (np.linalg.norm(v) or 1.0)
                best = int(cosines.argmax())
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, lang_pred string, score double")
