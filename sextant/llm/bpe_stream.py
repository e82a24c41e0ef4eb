"""BPE encoding and decoding as streams: tokens leave once nothing that follows can change them."""

from __future__ import annotations

import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sextant.llm.bpe import Memory, Merges
from sextant.llm.common import map_batches, texts

#: The pieces that byte-level BPE never merges across.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: What carries on a piece that began: the kind of its last character.
_KINDS, _SPACES = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")], regex.compile(r"\s+")
#: Pieces whose tokens a worker remembers, twice; characters of a text that are given to a stream at once.
REMEMBERED, CHUNK = 1 << 18, 1 << 14

#: Tokens in order, as numbers and as decimal text joined by commas.
Tokens = tuple[tuple[int, ...], str]


class Transducer:
    """Bytes of one piece in, tokens out as soon as they are stable. Holds twice `window` bytes at most; the window is
    no less than twice the merges' lookahead."""

    def __init__(self, merges: Merges, ahead: int = 0, window: int = 0) -> None:
        self.merges, self.ahead = merges, ahead or merges.lookahead()
        self.window = max(window, 2 * self.ahead, 16)
        self.sizes = [0] * (max(merges.vocabulary.values()) + 1)
        for token, number in merges.vocabulary.items():
            self.sizes[number] = len(token)
        self.held = b""

    def push(self, more: bytes) -> list[int]:
        """Takes more of the piece; returns the tokens that became stable."""
        out: list[int] = []
        for k in range(0, len(more), self.window):
            self.held += more[k : k + self.window]
            if len(self.held) >= 2 * self.window:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        first, end, out = self.merges.first, 0, []
        for token in self.merges.apply([first[b] for b in self.held]):
            if end + self.sizes[token] > len(self.held) - self.ahead:
                break
            end += self.sizes[token]
            out.append(token)
        self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        """The piece is over, so all that is held is stable."""
        first = self.merges.first
        out = self.merges.apply([first[b] for b in self.held]) if self.held else []
        self.held = b""
        return out

    def encode(self, piece: bytes) -> list[int]:
        """A piece from its beginning to its end."""
        return [*self.push(piece), *self.finish()]


class StreamEncoder:
    """Text in, tokens out, in chunks of any size, with memory that doesn't grow with the text. Pieces run through the
    transducer; what it answered for short ones is remembered, in a memory of bounded size that streams may share."""

    #: A piece that ends this far from the end of what is known can't change: 'll needs two more characters.
    MARGIN = 3
    #: A piece of more characters leaves while it goes on.
    LONG = 64

    def __init__(self, merges: Merges, piece: Transducer | None = None, memory: Memory | None = None) -> None:
        self.merges, self.piece = merges, piece or Transducer(merges)
        self.memory = remembering(self.piece) if memory is None else memory
        self.text, self.open, self.space = "", None, ""

    def feed(self, chunk: str) -> list[Tokens]:
        """Takes more of the text; returns what became stable."""
        self.text += chunk
        return self._run(False)

    def finish(self) -> list[Tokens]:
        """The text is over: the rest. The stream may begin anew."""
        return self._run(True)

    def _run(self, over: bool) -> list[Tokens]:
        out: list[Tokens] = []
        specials = self.merges.specials
        while True:
            at, special = min(((k, s) for s in specials if (k := self.text.find(s)) >= 0), default=(-1, ""))
            if at < 0:
                break
            rest, self.text = self.text[at + len(special) :], self.text[:at]
            out += [*self._pieces(True, len(self.text)), _shown([specials[special]])]
            self.text = rest
        # what may be the beginning of a special string waits
        held = 0 if over else max((n for s in specials for n in range(1, len(s)) if self.text.endswith(s[:n])), default=0)
        return out + self._pieces(over, len(self.text) - held)

    def _push(self, part: str, end: bool = False) -> list[Tokens]:
        """More of a piece that is longer than what is known of it."""
        ids = self.piece.push(part.encode()) + (self.piece.finish() if end else [])
        return [_shown(ids)] if ids else []

    def _pieces(self, over: bool, end: int) -> list[Tokens]:
        """Encodes self.text up to end, as far as pieces are certain; over: all of it."""
        out: list[Tokens] = []
        rest, text, k = self.text[end:], self.text[:end], 0
        if self.open:
            m = self.open.match(text)
            k = m.end() if m else 0
            ended = k < len(text) or over
            out += self._push(text[:k], ended)
            if ended:
                self.open = None
        elif self.space:
            # the last of an open run of spaces waits: the next piece may begin with it
            m = _SPACES.match(text)
            run = self.space + (m[0] if m else "")
            if len(run) > len(text) and not over:
                out += self._push(run[:-1])
                self.space, k = run[-1], len(text)
            elif len(run) > len(text):
                out += self._push(run, True)
                self.space, k = "", len(text)
            else:
                out += self._push(run[:-1], True)
                text, self.space = run[-1] + text[len(run) - 1 :], ""
        if k < len(text) and not self.open and not self.space:
            # pieces leave no gaps, so those certain end where the rest begins
            found, k = PIECES.findall(text, k), len(text)
            while not over and found and k > len(text) - self.MARGIN:
                k -= len(found.pop())
            out += map(self.memory.__getitem__, found)
            m = PIECES.match(text, k)
            if m and m.end() == len(text) and len(m[0]) > self.LONG:
                # all but the beginning of a long piece is of one kind, so it may leave while it goes on
                k = len(text)
                if _SPACES.match(m[0][-1]):
                    out += self._push(m[0][:-1])
                    self.space = m[0][-1]
                else:
                    out += self._push(m[0])
                    self.open = next(p for p in _KINDS if p.match(m[0][-1]))
        self.text = text[k:] + rest
        return out


def _shown(ids: list[int]) -> Tokens:
    return tuple(ids), ",".join(map(str, ids))


def remembering(piece: Transducer, most: int = REMEMBERED) -> Memory:
    """What the transducer makes of pieces, remembered for the most frequent short ones."""
    return Memory(lambda text: _shown(piece.encode(text.encode())), most)


class StreamDecoder:
    """Tokens in, text out: bytes go through an incremental UTF-8 state machine; what is not UTF-8 becomes U+FFFD."""

    def __init__(self, merges: Merges, table: dict[int, bytes] | None = None) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.bytes = token_bytes(merges) if table is None else table

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def token_bytes(merges: Merges) -> dict[int, bytes]:
    """The bytes that each token stands for, special ones included."""
    of = {c: b for b, c in enumerate(merges.letters)}
    return {n: bytes([of[c] for c in t]) for t, n in merges.vocabulary.items()} | {n: t.encode() for t, n in merges.specials.items()}


class Codec:
    """What the streams of a worker share: merges, one transducer, its memory, and the tokens' bytes."""

    def __init__(self, merges: Merges, ahead: int = 0) -> None:
        self.merges, self.piece, self.bytes = merges, Transducer(merges, ahead), token_bytes(merges)
        self.memory = remembering(self.piece)

    def round_trip(self, chunks: Iterable[str]) -> Iterator[tuple[list[int], str, str]]:
        """For each chunk of a text, and after the last: the tokens that became stable, as numbers and as decimal text,
        and the text that these complete when decoded. Nothing is held of what has left."""
        encoder, decoder = StreamEncoder(self.merges, self.piece, self.memory), StreamDecoder(self.merges, self.bytes)

        def left(found: list[Tokens]) -> tuple[list[int], str, str]:
            ids = [x for some, _ in found for x in some]
            return ids, ",".join([t for _, t in found]), decoder.feed(ids)

        for chunk in chunks:
            yield left(encoder.feed(chunk))
        yield left(encoder.finish())
        yield [], "", decoder.finish()


_CODECS: dict[int, Codec] = {}


def codec_of(tokenizer: str, ahead: int) -> Codec:
    """One for each worker process and tokenizer, so that what it remembers serves later tasks."""
    key = hash(tokenizer)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(Merges(tokenizer), ahead)
    return _CODECS[key]


def chunks_of(text: str, size: int = CHUNK) -> Iterator[str]:
    return (text[k : k + size] for k in range(0, len(text), size))


def encode_decode(docs: DataFrame, tokenizer_path: str, ids: bool = False, decoded: bool = False, chunk: int = CHUNK) -> DataFrame:
    """For every row of docs (doc_id, text; other columns of any name are ignored): doc_id, n_tokens (long), ids_sha256 and
    decoded_sha256 (string); with ids also token_ids (array of int), with decoded also decoded (string).

    The text is encoded whole by the byte-level tokenizer in the JSON file at tokenizer_path (read by the driver, sent to
    the workers: a vocabulary, whatever the data) without added tokens; special strings in the text are their tokens.
    ids_sha256 is of decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8. A null text is empty: no
    tokens, and the hash of nothing. Rows are independent: nothing is shuffled, repeated rows come back as often.

    The driver checks that the merge list is proper and computes its lookahead. A text of any length goes through in
    chunks of `chunk` characters: tokens leave the transducer once stable, go into the digest and through the decoder,
    and are forgotten, unless ids or decoded ask for them.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    merges = Merges(tokenizer)
    if not merges.is_proper():
        raise ValueError("the merge list is not proper: no bounded lookahead is known for it")
    given = docs.sparkSession.sparkContext.broadcast((tokenizer, merges.lookahead()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(*given.value)
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            numbers, ends, whole = array("i"), [0], []
            for text in texts(batch.column("text")):
                n, of_ids, of_text, parts = 0, hashlib.sha256(), hashlib.sha256(), []
                for some, shown, piece in codec.round_trip(chunks_of(text, chunk)):
                    if some:
                        of_ids.update(("," * (n > 0) + shown).encode())
                        n += len(some)
                        if ids:
                            numbers.extend(some)
                    of_text.update(piece.encode())
                    if decoded:
                        parts.append(piece)
                rows.append((n, of_ids.hexdigest(), of_text.hexdigest()))
                ends.append(ends[-1] + n)
                whole.append("".join(parts))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            out = [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            if ids:
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(numbers, np.int32))))
            yield pa.RecordBatch.from_arrays([*out, *[pa.array(whole, pa.string())] * decoded], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * ids, *["decoded"] * decoded]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids + ", decoded string" * decoded
    return map_batches(rows, run, schema)
