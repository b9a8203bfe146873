"""Substring and suffix dedup and the Jaccard join against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.components import components
from quillon.llm.jaccard_join import jaccard_join, representatives
from quillon.llm.sequences import WindowHash, anchored_spans, mix
from quillon.llm.substring_dedup import SuffixAutomaton, substring_dedup
from quillon.llm.suffix_dedup import HashedString, common_prefix, partners, sort_suffixes, suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def covered(sequences, window):
    """For each sequence, which symbols a repeated window covers."""
    count = Counter(tuple(s[i : i + window]) if not isinstance(s, bytes) else s[i : i + window] for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        flags = bytearray(len(s))
        for i in range(len(s) - window + 1):
            if count[tuple(s[i : i + window]) if not isinstance(s, bytes) else s[i : i + window]] > 1:
                flags[i : i + window] = b"\1" * window
        out.append(flags)
    return out


def brute_words(texts, window):
    sequences = [WORD.findall((t or "").encode()) for t in texts]
    return [(len(s), sum(f), hashlib.sha256(b" ".join(w for w, x in zip(s, f) if not x)).hexdigest()) for s, f in zip(sequences, covered(sequences, window))]


def brute_bytes(texts, window):
    sequences = [(t or "").encode() for t in texts]
    out = []
    for s, f in zip(sequences, covered(sequences, window)):
        spans = sum(1 for i, x in enumerate(f) if x and (i == 0 or not f[i - 1]))
        out.append((len(s), sum(f), spans, hashlib.sha256(bytes(b for b, x in zip(s, f) if not x)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [None, 1])
def test_words_match_brute_force(documents, texts, hot):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(documents, hot=hot).collect()}
    assert got == dict(zip(texts, brute_words(texts.values(), 35)))
    assert any(v[1] for v in got.values())


@pytest.mark.parametrize("hot", [None, 1])
def test_bytes_match_brute_force(documents, texts, hot):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(documents, hot=hot).collect()}
    assert got == dict(zip(texts, brute_bytes(texts.values(), 200)))


def test_hostile_rows(hostile, nothing):
    rows = hostile.select("doc_id", "text").collect()
    words = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(hostile).collect())
    assert words == sorted((r.doc_id is None, r.doc_id or 0, *b) for r, b in zip(rows, brute_words([r.text for r in rows], 35)))
    out = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(hostile).collect())
    assert out == sorted((r.doc_id is None, r.doc_id or 0, *b) for r, b in zip(rows, brute_bytes([r.text for r in rows], 200)))
    assert substring_dedup(nothing).count() == 0 and suffix_dedup(nothing).count() == 0


def test_text_without_cut_characters(spark):
    shared = "é" * 150
    docs = spark.createDataFrame([(1, "a" + shared + "ê"), (2, "b" + shared + "ë")], "doc_id bigint, text string")
    got = {r.doc_id: r.kept_text for r in suffix_dedup(docs, text=True).collect()}
    assert got == {1: "a", 2: "b"}  # the first byte of the last character repeats too


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=14), st.integers(1, 3)), min_size=1, max_size=6), st.integers(1, 4))
def test_automaton_statistics(strings, window):
    automaton = SuffixAutomaton()
    for s, weight in strings:
        automaton.add(list(s), weight)
    automaton.close()
    occurs = Counter()
    for s, weight in strings:
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                occurs[s[i:j]] += weight
    for s, _ in strings:
        want = [max([j + 1 - i for i in range(j + 1) if occurs[s[i : j + 1]] > 1], default=0) for j in range(len(s))]
        assert automaton.statistics(list(s)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=12), min_size=1, max_size=8), st.lists(st.binary(max_size=12), min_size=8, max_size=8))
def test_suffix_sort_and_partners(right, left):
    left = [bytes(b % 2 for b in x) for x in left[: len(right)]]
    right = [bytes(b % 2 for b in x) for x in right]
    hashed = [HashedString(s) for s in right]
    assert [right[i] for i in sort_suffixes(hashed)] == sorted(right)

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    assert all(common_prefix(hashed[0], h) == common(right[0], s) for h, s in zip(hashed, right))
    best = defaultdict(set)
    for i, j, before, after in partners([HashedString(s) for s in left], hashed):
        for k in (i, j):
            best[k].add((before, after))
    for i in range(len(right)):
        for j in range(len(right)):
            if i != j:
                before, after = common(left[i], left[j]), common(right[i], right[j])
                assert any(b >= before and a >= after for b, a in best[i]), (left, right, i, j)


# Jaccard


def sets(texts, k):
    out = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_components(texts, k, num, den):
    found, boss = sets(texts, k), {d: d for d in texts}

    def root(x):
        while boss[x] != x:
            x = boss[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(found[a] & found[b])
            if n and den * n >= num * (len(found[a]) + len(found[b]) - n):
                x, y = root(a), root(b)
                boss[max(x, y)] = min(x, y)
    return {d: (len(found[d]), root(d)) for d in texts}


@pytest.mark.parametrize(("k", "num", "rounds"), [(4, 85, 1), (5, 80, 0), (2, 50, 2)])
def test_components_match_brute_force(documents, texts, k, num, rounds):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(documents, k, num, rounds=rounds).collect()}
    assert got == brute_components(texts, k, num, 100)


def test_chains_of_links_and_one_near_group(spark):
    base = [f"t{i}" for i in range(120)]
    chain = {i: " ".join(base[: 60 + 3 * i]) for i in range(12)}  # neighbours link, the ends do not
    near = {100 + i: " ".join([*base[:50], f"edit{i}", *base[51:100]]) for i in range(40)}
    texts = chain | near | {200: "T0 t1 t2", 201: "t0 t1 t2", 202: "t0 t1 t2 t3"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for rounds in (0, 1):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(docs, rounds=rounds).collect()}
        assert got == brute_components(texts, 4, 85, 100)


def test_jaccard_hostile_rows(hostile, nothing):
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join(hostile).collect())
    assert len(rows) == 13
    whole = [r for r in rows if r[2] == 57]
    assert len(whole) == 4 and {r[3] for r in whole} == {1}
    assert [r[3] for r in rows if r[1] in (6, 7)] == [6, 6] and [r[3] for r in rows if r[1] in (3, 4, 5)] == [3, 4, 5]
    assert jaccard_join(nothing).count() == 0
    kept = representatives(hostile)
    assert kept.columns == hostile.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 9, 10]


def test_rows_without_id_whose_texts_collide_in_32_bits(spark):
    shared = " ".join(f"shared{i:02}" for i in range(40))
    texts = [f"x25 {shared}", f"{shared} y140667", "p35083 a b c d", "p122595 a b c d"]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string")
    marks = [r.h for r in docs.selectExpr("hash(text) AS h").collect()]
    assert marks[0] == marks[1] and marks[2] == marks[3]
    assert sorted(r.kept_text for r in substring_dedup(docs).collect()) == sorted(["x25", "y140667", *texts[2:]])
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs).collect())
    assert got == sorted(brute_bytes(texts, 200))
    kept = {r.text for r in representatives(docs).collect()}
    assert len(kept) == 3 and set(texts[2:]) < kept


def test_rows_of_one_id_or_none_and_ids_of_text(spark):
    near = " ".join(f"n{i}" for i in range(60))
    texts = [f"{near} x", f"{near} y", "alone a b c d e", "alone f g h i j"]
    none = spark.createDataFrame([(None, t) for t in texts] * 2, "doc_id bigint, text string")
    assert sorted(r.n_words for r in substring_dedup(none).collect()) == sorted(2 * [len(t.split()) for t in texts])
    assert len(representatives(none).collect()) == 3 and jaccard_join(none).count() == 8
    named = spark.createDataFrame([(f"id-{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join(named).collect()} == {"id-0": "id-0", "id-1": "id-0", "id-2": "id-2", "id-3": "id-3"}
    assert {r.doc_id: r.n_removed for r in substring_dedup(named).collect()} == {"id-0": 60, "id-1": 60, "id-2": 0, "id-3": 0}
    assert {r.doc_id for r in suffix_dedup(named).collect()} == {f"id-{i}" for i in range(4)}


def thue_morse(n):
    """A string and its complement, whose polynomial hashes modulo 2**64 are equal whatever the base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_structured_texts_do_not_collide(spark):
    one, two = thue_morse(2048)
    start = " ".join(f"s{i}" for i in range(34))
    texts = {1: f"{start} {one}", 2: f"{start} {two}", 3: one, 4: two, 5: f"{one} {start}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs).collect()} == dict(zip(texts, brute_words(texts.values(), 35)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs).collect()} == dict(zip(texts, brute_bytes(texts.values(), 200)))
    short = {1: f"a b c {one}", 2: f"a b c {two}", 3: one, 4: two}
    docs = spark.createDataFrame(list(short.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join(docs).collect()} == {d: d for d in short}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 40))
def test_equal_windows_have_equal_hashes_and_others_not(symbols, k):
    codes = mix(np.array(symbols, np.uint64))
    hashes = WindowHash(codes)
    windows = [tuple(symbols[i : i + k]) for i in range(len(symbols) - k + 1)]
    by = {}
    for window, value in zip(windows, hashes.windows(k).tolist(), strict=True):
        assert by.setdefault(window, value) == value
    assert len(set(by.values())) == len(by)
    bounds = [(i, j) for i in range(len(symbols) + 1) for j in range(i, len(symbols) + 1)]
    slices = hashes.slices(*(np.array(x, np.int64) for x in zip(*bounds)))
    by = {}
    for (i, j), value in zip(bounds, slices.tolist()):
        assert by.setdefault(tuple(symbols[i:j]), value) == value
    assert len(set(by.values())) == len(by)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=40), min_size=1, max_size=4), st.integers(1, 5))
def test_anchors_do_not_depend_on_blocks(documents, block):
    codes = mix(np.array([s for d in documents for s in d], np.uint64))
    first = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.int64)
    whole, cut = anchored_spans(codes, first, 9, 3), anchored_spans(codes, first, 9, 3, block)
    offset = {}
    for spans in (whole, cut):
        seen = set()
        for doc, start, n, anchor in zip(*[x.tolist() for x in spans[:4]]):
            for at in range(start, start + n):
                window = tuple(documents[doc][at - first[doc] : at - first[doc] + 9])
                assert offset.setdefault(window, anchor - at) == anchor - at
                seen.add(at)
        assert len(seen) == sum(max(0, len(d) - 8) for d in documents)


def test_components_never_come_unfinished(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u bigint, v bigint")
    with pytest.raises(RecursionError):
        components(edges, most_rounds=2)
    for few in (0, 100):
        assert {r.node: r.root for r in components(edges, few=few).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}
