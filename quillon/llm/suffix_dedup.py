"""Operator 10, suffix-array dedup: a hash-compared suffix sort decides which bytes repeat.

Within a shard (see `repeats`) every run has an anchor; the suffixes that start at anchors,
and the reversed prefixes that end there, are merge-sorted. Two strings are compared by their
common extension: a binary search over equal prefix polynomial hashes, then one byte. A match
found by hashes is verified on the bytes; a collision falls back to a search on the bytes.

A window that starts `l` bytes before the anchor repeats if some other run of the same anchor
agrees on l bytes to the left and window - l to the right. The suffix order is a tree of
common extensions; its nodes are merged from the longest extension to the shortest, the
smaller set into the larger, and only neighbours in the prefix order are compared: the best
partner on the left side is always such a neighbour. That is n log n comparisons, not n².
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from functools import cmp_to_key
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import repeated_windows

WINDOW = 200
#: Bytes of the k-gram that represents a window.
GRAM = 40
_P, _B = (1 << 61) - 1, 0x1F3D5B79A2C4E687


class HashedString:
    """A byte string with prefix hashes modulo 2**61 - 1."""

    __slots__ = ("data", "sums")

    def __init__(self, data: bytes):
        self.data = data
        sums, value = [0], 0
        for byte in data:
            value = (value * _B + byte + 1) % _P
            sums.append(value)
        self.sums = sums


def common_prefix(a: HashedString, b: HashedString) -> int:
    """Length of the longest common prefix: binary search on hashes, verified on the bytes."""
    lo, hi = 0, min(len(a.data), len(b.data))
    left, right = a.sums, b.sums
    while lo < hi:  # prefixes, so no subtraction is needed
        mid = (lo + hi + 1) >> 1
        if left[mid] == right[mid]:
            lo = mid
        else:
            hi = mid - 1
    if a.data[:lo] == b.data[:lo]:
        return lo
    lo, hi = 0, lo  # a collision: search on the bytes
    while lo < hi:
        mid = (lo + hi + 1) >> 1
        lo, hi = (mid, hi) if a.data[:mid] == b.data[:mid] else (lo, mid - 1)
    return lo


def _compare(x: tuple, y: tuple) -> int:
    a, b = x[0], y[0]
    n = common_prefix(a, b)
    if n == len(a.data) or n == len(b.data):
        return len(a.data) - len(b.data)
    return a.data[n] - b.data[n]


def sort_suffixes(strings: list[HashedString]) -> list[int]:
    """Merge sort (the runtime's own is one) by hash-compared common extensions."""
    return [i for _, i in sorted(((s, i) for i, s in enumerate(strings)), key=cmp_to_key(_compare))]


def partners(left: list[HashedString], right: list[HashedString]):
    """(i, j, common left, common right) that suffice to know each string's repeated windows."""
    n = len(left)
    by_right, by_left = sort_suffixes(right), sort_suffixes(left)
    rank = [0] * n
    for place, i in enumerate(by_left):
        rank[i] = place
    extension = [common_prefix(right[a], right[b]) for a, b in zip(by_right, by_right[1:])]
    boss = list(range(n))
    members = [[rank[i]] for i in by_right]

    def find(x: int) -> int:
        while boss[x] != x:
            boss[x] = boss[boss[x]]
            x = boss[x]
        return x

    for at in sorted(range(n - 1), key=lambda k: -extension[k]):
        a, b = find(at), find(at + 1)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        boss[b] = a
        into = members[a]
        for value in members[b]:
            place = bisect_left(into, value)
            for near in (place - 1, place):
                if 0 <= near < len(into):
                    i, j = by_left[value], by_left[into[near]]
                    yield i, j, common_prefix(left[i], left[j]), extension[at]
            insort(into, value)
        members[b] = []


def decide(rows: list[tuple], window: int) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = []
    for _, group in groupby(rows, key=lambda r: r[0]):
        group = list(group)
        flags = [bytearray(b"\1" * r[3]) if r[1] > 1 else bytearray(r[3]) for r in group]
        if len(group) > 1 and any(r[1] == 1 for r in group):
            left = [HashedString(r[4][: r[2]][::-1]) for r in group]
            right = [HashedString(r[4][r[2] :]) for r in group]
            for i, j, before, after in partners(left, right):
                for k in (i, j):
                    lead, n = group[k][2], group[k][3]
                    # window offset o starts lead - o bytes before the anchor
                    lo, hi = max(0, lead - before), min(n - 1, lead - (window - after))
                    if lo <= hi:
                        flags[k][lo : hi + 1] = b"\1" * (hi - lo + 1)
        for f in flags:
            edges = np.flatnonzero(np.diff(np.frombuffer(bytes([0]) + bytes(f) + bytes([0]), np.int8)))
            out.append([(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])])
    return out


class _Kept:
    """The remaining bytes; as a text, without characters that were cut in two, if `text`."""

    def __init__(self, text: bool):
        self.text = text
        self.columns = [("kept_text", pa.string()) if text else ("kept_bytes", pa.binary()), *self.figures]

    figures = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]

    def __call__(self, raw, offsets, symbols, covered):
        sums = np.concatenate([[0], np.cumsum(covered)])
        total, removed = np.diff(offsets), sums[offsets[1:]] - sums[offsets[:-1]]
        rises = covered.copy()
        rises[1:] &= ~covered[:-1]
        firsts = offsets[:-1][np.diff(offsets) > 0]
        rises[firsts] = covered[firsts]
        rose = np.concatenate([[0], np.cumsum(rises)])
        kept_raw = raw[~covered].tobytes()
        bounds = (offsets - sums[offsets]).tolist()
        kept = [kept_raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        first = [k.decode("utf-8", "ignore") for k in kept] if self.text else kept
        return first, total.tolist(), removed.tolist(), (rose[offsets[1:]] - rose[offsets[:-1]]).tolist(), [hashlib.sha256(k).hexdigest() for k in kept]


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: list[str] | None = None, text: bool = False, hot: int | None = None) -> DataFrame:
    """doc_id (or the columns of carry), kept_bytes, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    Texts are taken as UTF-8 bytes. A byte is removed if a string of `window` bytes that covers
    it also starts elsewhere in the input, the same document included; matches never cross
    documents. Null and empty texts give 0, 0, 0 and the hash of nothing. Repeated rows count
    as occurrences of each other. An empty table gives an empty table. With text, kept_text
    takes the place of kept_bytes; a character that lost some of its bytes is left out of it.
    """
    carry = carry or ["doc_id"]
    more = {} if hot is None else {"hot": hot}
    return repeated_windows(docs, "bytes", window, gram, decide, _Kept(text), f"{'kept_text string' if text else 'kept_bytes binary'}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", carry, **more)
