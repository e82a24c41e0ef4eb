"""Token counts and streaming BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import time

import psutil
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sextant.llm.bpe import Memory, Merges
from sextant.llm.bpe_stream import CHUNK, Codec, StreamDecoder, StreamEncoder, Transducer, chunks_of, encode_decode
from sextant.llm.token_counts import Counter, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string"
HARD = [None, "", " ", "Hello World's end", "<|endoftext|>a<|endof", "日本語 Ünïcödé İstanbul ΑΣ", "é", "a\x1cb\x85c", "¾ ⅷ ² 123", "\U0001f600" * 5, "x" * 5000, " " * 3000 + "y", "<|STARTOFTEXT|><|startoftext|>", "'S 'll 're"]


@pytest.fixture(scope="module")
def byte_bpe():
    with open(BYTE, encoding="utf-8") as f:
        return Merges(f.read()), Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_bpe():
    with open(WORD, encoding="utf-8") as f:
        return Counter(f.read()), Tokenizer.from_file(WORD)


PARTS = st.lists(st.sampled_from(["a", "e", "the", "ing", " ", "  ", "\n", "'", "'s", "'LL", "é", "1", "23", "!", "<|endoftext|>", "<|endo", "日", " ", "\U0001f600", "\t", "İ", "Σ", "é", "a" * 70, " " * 70]), max_size=25).map("".join)


@given(text=st.one_of(PARTS, st.text(max_size=60)), cut=st.integers(1, 9))
@settings(max_examples=250, deadline=None)
def test_streams_equal_the_library(byte_bpe, text, cut):
    merges, library = byte_bpe
    text = text.encode("utf-8", "ignore").decode()
    want = library.encode(text, add_special_tokens=False).ids
    assert _encoded(merges, text) == want
    assert _encoded(merges, text, cut) == want
    decoder = StreamDecoder(merges)
    assert "".join(decoder.feed([x]) for x in want) + decoder.finish() == library.decode(want, skip_special_tokens=False)


_MADE: list[Codec] = []


def _encoded(merges, text, cut=1 << 14):
    if not _MADE:
        _MADE.append(Codec(merges))
    parts = [*_MADE[0].round_trip(chunks_of(text, cut))]
    ids = [x for p in parts for x in p[0]]
    assert ",".join(p[1] for p in parts if p[0]) == ",".join(map(str, ids))
    assert "".join(p[2] for p in parts) == text
    return ids


def test_lookahead_is_enough_and_memory_constant(byte_bpe):
    merges, library = byte_bpe
    assert merges.is_proper() and merges.lookahead() < 1000
    rng = random.Random(1)
    for letters in ("etaoin", "a", "th", "0123456789"):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        stream, out, most = StreamEncoder(merges), [], 0
        for k in range(0, len(text), 113):
            out += stream.feed(text[k : k + 113])
            most = max(most, len(stream.text) + len(stream.piece.held))
        out += stream.finish()
        assert [x for ids, _ in out for x in ids] == library.encode(text, add_special_tokens=False).ids
        assert most < 8 * stream.piece.window
    # whatever follows, tokens that end that far back stay
    ahead = merges.lookahead()
    for _ in range(40):
        text = "".join(rng.choice("abcdefinorst") for _ in range(ahead + 60)).encode()
        one = Transducer(merges, window=10_000)
        first, other = one.encode(text), one.encode(text + bytes(rng.choice(b"aeinorst") for _ in range(30)))
        end, n = 0, 0
        while end + one.sizes[first[n]] <= len(text) - ahead:
            end += one.sizes[first[n]]
            n += 1
        assert first[:n] == other[:n]


def test_memory_is_the_same_for_fifty_megabytes(byte_bpe):
    """The whole way of the query, but for the row itself: nothing as long as the text is held."""
    merges, library = byte_bpe
    codec, rng, process = Codec(merges), random.Random(5), psutil.Process()
    passage = " ".join(rng.choice(["streaming", "tokens", "naïve", "日本", "  ", "1234", "!?", "international", "\n"]) for _ in range(200_000)) + ".\n"
    want = library.encode(passage, add_special_tokens=False).ids
    times = -(-50_000_000 // len(passage.encode()))
    digest, expected, count, memory = hashlib.sha256(), hashlib.sha256(), 0, []
    for k, (some, _, piece) in enumerate(codec.round_trip(c for _ in range(times) for c in chunks_of(passage))):
        count += len(some)
        assert len(some) <= 2 * CHUNK and len(piece) <= 2 * CHUNK
        digest.update(piece.encode())
        if k % 64 == 0:
            memory.append(process.memory_info().rss)
    for _ in range(times):
        expected.update(passage.encode())
    assert count == times * len(want) and digest.digest() == expected.digest()
    assert len(memory) > 40 and max(memory[4:]) - memory[4] < 4_000_000


def test_every_piece_runs_through_the_transducer(byte_bpe):
    merges, _ = byte_bpe
    codec = Codec(merges)
    seen: list[bytes] = []
    push = codec.piece.push
    codec.piece.push = lambda more: seen.append(more) or push(more)
    for _ in codec.round_trip(["a short text, ", "x" * 40_000]):
        pass
    assert b"a" in seen and b" short" in seen and len(codec.piece.held) == 0 and sum(map(len, seen)) == 14 + 40_000


@given(text=st.one_of(PARTS, st.text(max_size=60)))
@settings(max_examples=250, deadline=None)
def test_counts_equal_the_library(word_bpe, text):
    counter, library = word_bpe
    text = text.encode("utf-8", "ignore").decode()
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_splitting_agrees_for_all_characters(word_bpe, byte_bpe):
    counter, library = word_bpe
    merges, other = byte_bpe
    for c in [*range(0x3000), *range(0x3000, 0x110000, 257)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b 1{chr(c)}!{chr(c)} {chr(c)}C"
            assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), hex(c)
            assert _encoded(merges, text) == other.encode(text, add_special_tokens=False).ids, hex(c)


def test_any_character_takes_the_shortcut(word_bpe):
    """Texts with quotes, dashes and other scripts are looked up as others are, and few characters need the library."""
    counter, library = word_bpe
    texts = ["It’s “quoted” — and so on… ", "Съешь же ещё этих мягких французских булок ", "日本語のテキストです。 ", "ΟΔΥΣΣΕΥΣ ΑΣ ", "한국어 텍스트 ", "ไทย हिन्दी עברית \u1100\u1161 "]
    merged_before = len(counter.counts)
    for t in texts:
        assert counter.count(t * 50) == len(library.encode(t * 50, add_special_tokens=False).ids), t
    assert len(counter.counts) > merged_before
    assert all(counter.agreed[c] for c in "’“”—…Съ日本語。ΣΟ한")
    known = [c for k in range(0x250, 0xD800) if (c := chr(k)).isalpha()]
    assert sum(map(counter.agreed.__getitem__, known)) > 0.98 * len(known)
    plain, quoted = "the same words again and again " * 20_000, "the same words’ again and again " * 20_000
    times = []
    for t in (plain, quoted):
        began = time.perf_counter()
        counter.count(t)
        times.append(time.perf_counter() - began)
    assert times[1] < 4 * times[0] + 0.1


def test_whole_tokens_are_proven(word_bpe):
    counter, library = word_bpe
    assert len(counter.counts.proven) > 20_000
    for piece in random.Random(3).sample(sorted(counter.counts.proven), 300):
        if piece == piece.lower():
            assert len(library.encode(piece, add_special_tokens=False).ids) == 1


def test_memory_is_bounded():
    made: list[str] = []
    m = Memory(lambda k: made.append(k) or len(k), most=3)
    for _ in range(3):
        for k in "abcdefgh":
            assert m[k] == 1 and m["hot"] == 3
    assert len(m) + len(m.older) <= 7 and made.count("hot") == 1


def test_queries(spark, byte_bpe, word_bpe):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(0, "again"), (None, "no id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOC + ", n_tokens string")
    lib = lambda t, x: t.encode(x or "", add_special_tokens=False).ids
    counts = {(i, len((t or "").encode()), n := len(lib(word_bpe[1], t)), n > 3) for i, t in rows}
    assert {tuple(r) for r in token_counts(df, WORD, 3).collect()} == counts
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {(i, len(ids := lib(byte_bpe[1], t)), sha(",".join(map(str, ids))), sha(byte_bpe[1].decode(ids, skip_special_tokens=False))) for i, t in rows}
    assert {tuple(r) for r in encode_decode(df, BYTE).collect()} == want
    assert {tuple(r) for r in encode_decode(df, BYTE, chunk=3).collect()} == want
    full = encode_decode(df, BYTE, ids=True, decoded=True).where("doc_id = 3").first()
    assert full["decoded"] == HARD[3] and full["token_ids"] == lib(byte_bpe[1], HARD[3])
    empty = spark.createDataFrame([], DOC)
    assert encode_decode(empty, BYTE).collect() == [] and token_counts(empty, WORD).collect() == []
