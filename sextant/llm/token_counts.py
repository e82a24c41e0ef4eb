"""Token counts with a whole-token shortcut: strings proven to be one token are counted, only the rest is merged."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from sextant.llm.bpe import Merges, byte_letters
from sextant.llm.common import map_batches, texts

#: The pieces of normalised text; white space between them is dropped.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Up to here all characters are known to be normalised and split as the library does it; each one beyond is compared
#: with the library when it is first met.
_BEYOND = regex.compile(r"[^\x00-ɏ]")
#: Pieces other than whole tokens whose counts a worker remembers, and characters; a full memory is emptied.
REMEMBERED = 1 << 17


def whole_tokens(merges: Merges) -> dict[str, int]:
    """The strings of the vocabulary that can end a piece and, given as a piece, merge into one token: proven by merging
    each of them. A vocabulary string need not be one, as merges of lower rank may lead past it."""
    of = {c: b for b, c in enumerate(merges.letters)}
    proven: dict[str, int] = {}
    for token in merges.vocabulary:
        if token in merges.specials or not token.endswith(merges.suffix) or len(token) == len(merges.suffix):
            continue
        letters = token[: len(token) - len(merges.suffix)]
        try:
            piece = bytes([of[c] for c in letters]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if len(merged(merges, letters)) == 1:
            proven[piece] = 1
    return proven


def merged(merges: Merges, letters: str) -> list[int]:
    """The tokens of a piece given as byte letters; its last one carries the end-of-word suffix."""
    v = merges.vocabulary
    return merges.apply([v[c] for c in letters[:-1]] + [v[letters[-1] + merges.suffix]])


class Counts(dict):
    """Piece -> its tokens; the proven ones are there from the start, the rest is merged when asked for."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.proven = merges, whole_tokens(merges)
        super().__init__(self.proven)

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED + len(self.proven):
            self.clear()
            self.update(self.proven)
        n = len(merged(self.merges, "".join([self.merges.letters[b] for b in piece.encode()])))
        if len(piece) < 64:
            self[piece] = n
        return n


class Agreed(dict):
    """Character -> whether the library normalises it and splits around it as PIECES and unicodedata do."""

    def __init__(self, library: Tokenizer) -> None:
        self.library = library

    def __missing__(self, c: str) -> bool:
        if len(self) >= REMEMBERED:
            self.clear()
        text = f"a{c}b 1{c}!{c} {c}C{c}"
        normal = self.library.normalizer.normalize_str(text)
        pieces = [text_of(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        self[c] = unicodedata.category(c) != "Cn" and normalised(text) == normal and PIECES.findall(normal) == pieces
        return self[c]


_BYTE = {c: b for b, c in enumerate(byte_letters())}


def text_of(letters: str) -> str:
    """The text that byte letters stand for."""
    return bytes([_BYTE[c] for c in letters]).decode("utf-8", "replace")


def normalised(text: str) -> str:
    """Composed and in lower case, each character for itself: a final sigma is no other than any."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Counter:
    """Counts the tokens of whole texts as the library would."""

    def __init__(self, tokenizer: str) -> None:
        self.merges = Merges(tokenizer)
        self.counts, self.library = Counts(self.merges), Tokenizer.from_str(tokenizer)
        self.agreed = Agreed(self.library)
        self.special = regex.compile("|".join(map(regex.escape, self.merges.specials))) if self.merges.specials else None

    def count(self, text: str) -> int:
        if self.special and any(s in text for s in self.merges.specials):
            return len(self.special.findall(text)) + sum(self._plain(x) for x in self.special.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        """All pieces are looked up among the proven tokens and what is remembered, however the text was split."""
        if not text.isascii():
            beyond = set(_BEYOND.findall(text))
            if not all(map(self.agreed.__getitem__, beyond)):
                pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return sum(self.counts[text_of(p)] for p, _ in pieces)
            text = normalised(text) if beyond else unicodedata.normalize("NFC", text)
        return sum(map(self.counts.__getitem__, PIECES.findall(text.lower())))


_COUNTERS: dict[int, Counter] = {}


def counter_of(tokenizer: str) -> Counter:
    """One for each worker process and tokenizer."""
    key = hash(tokenizer)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(tokenizer)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """For every row of docs (doc_id, text; other columns are ignored): doc_id, n_bytes (of the text in UTF-8), n_tokens
    (long) and over_limit (n_tokens > limit).

    Tokens are those of the lower-casing word tokenizer in the JSON file at tokenizer_path (read by the driver, sent to
    the workers) for the whole text, without added tokens; special strings in a text are one token each. A null text
    is empty: 0 bytes, 0 tokens. Rows are independent: nothing is shuffled, repeated rows come back as often. A very long
    text is one row, so a task holds it and the list of its pieces, but remembers a bounded number of pieces.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        given = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(given.value)
        for batch in batches:
            sizes, counts = [], []
            for text in texts(batch.column("text")):
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                counts.append(counter.count(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
