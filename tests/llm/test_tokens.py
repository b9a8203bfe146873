"""BPE and packing against the tokenizers library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.bpe import REMEMBERED, ByteBpe, bpe_digest, bpe_round_trip
from quillon.llm.packing import CAPACITY, WordIds, cut, pack, plan, price
from quillon.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_pair():
    return ByteBpe(open(BYTES, encoding="utf-8").read(), 50), tokenizers.Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_pair():
    return WordIds(open(WORDS, encoding="utf-8").read(), 50), tokenizers.Tokenizer.from_file(WORDS)


PIECES = st.lists(st.one_of(st.characters(codec="utf-8"), st.sampled_from(["the", " and", "'s", "'LL", "  ", "\n\n", "\t", "<|endoftext|>", "<|startoftext|>", " ", "́", "İ", "9", "***", "\x1c"])), max_size=25).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_byte_ids_and_text(byte_pair, text):
    own, library = byte_pair
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
    assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_decode_of_broken_utf8(byte_pair):
    own, library = byte_pair
    ids = library.encode("é\U0001f600", add_special_tokens=False).ids[:-1]
    assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_word_ids(word_pair, text):
    own, library = word_pair
    assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents_round_trip(documents, texts, byte_pair):
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe_round_trip(documents, BYTES).collect()}
    assert got == {d: (byte_pair[1].encode(t, add_special_tokens=False).ids, t) for d, t in texts.items()}


def test_digests_match_the_library(documents, texts, byte_pair):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_digest(documents, BYTES).collect()}
    want = {}
    for d, t in texts.items():
        ids = byte_pair[1].encode(t or "", add_special_tokens=False).ids
        decoded = byte_pair[1].decode(ids, skip_special_tokens=False)
        want[d] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
    assert got == want


def test_long_pieces_are_not_remembered(byte_pair):
    own, library = byte_pair
    long = "ab" * 5000
    assert np.frombuffer(own.encode(long), "<u4").tolist() == library.encode(long, add_special_tokens=False).ids
    assert not any(len(k) > REMEMBERED for g in (own.cache, own.tokens) for k in (*g, *g.old))


def test_bpe_hostile_rows(hostile, nothing):
    rows = bpe_digest(hostile, BYTES).collect()
    assert len(rows) == 13 and sorted(r.n_tokens for r in rows)[:3] == [0, 0, 0]
    assert bpe_digest(nothing, BYTES).count() == 0


# packing


@pytest.mark.parametrize("tokens", [1, 2, 63, 64, 65, 4095, 4096, 4097, 9000])
def test_cut_covers(tokens):
    pieces = cut(tokens)
    assert [s for s, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) == tokens


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 16).map(lambda i: 16 * i), st.integers(0, 400), max_size=16))
def test_plan_uses_up_the_histogram(histogram):
    made = defaultdict(int)
    for times, pattern in plan(histogram, 256):
        assert sum(s * k for s, k in pattern.items()) <= 256 and times > 0
        for size, k in pattern.items():
            made[size] += k * times
    assert dict(made) == {s: n for s, n in histogram.items() if n}


def test_price_is_the_best_pattern():
    value, pattern = price(np.array([3.0, 5.0, 8.5]), np.array([2, 3, 5]), 11)
    assert value == pytest.approx(18.5) and (np.array([3.0, 5.0, 8.5]) * pattern).sum() == pytest.approx(18.5)


def test_plan_beats_first_fit():
    sizes = {24 * 64: 3000, 27 * 64: 3000, 13 * 64: 3000}
    assert sum(t for t, _ in plan(sizes, CAPACITY)) <= -(-sum(s * n for s, n in sizes.items()) // CAPACITY) + 2


def check_packing(rows, ids):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert by.keys() == ids.keys()
    for d, own in ids.items():
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(own)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= CAPACITY
        padding += CAPACITY - at if at & (at - 1) else 0
    return padding


def test_packing(documents, texts, word_pair):
    ids = {d: [*word_pair[1].encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    assert check_packing(pack(documents, WORDS).collect(), ids) <= 2 * CAPACITY


def test_packing_hostile_rows(hostile, nothing):
    rows = pack(hostile, WORDS).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 1 and sum(r.length for r in rows if r.doc_id == 9) == 30001
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert pack(nothing, WORDS).count() == 0
