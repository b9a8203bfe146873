"""Vectorised text primitives shared by the operators of this subpackage.

Texts stay in the Arrow buffers they arrive in: one uint8 array for the bytes
of many documents and one int64 array of offsets. Everything below works on
such a pair at once, never document by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: The six characters that end a word (space, \t \n \v \f \r).
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
#: Salts that keep hashes of different purposes apart.
SALT_A, SALT_B = 0x9E3779B97F4A7C55, 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


class _Weights:
    """Pseudo-random 64-bit weights of the places in a segment; grows as asked."""

    def __init__(self):
        self.values = np.zeros(0, _U)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            self.values = mix((np.arange(max(n, 4096, 2 * len(self.values)), dtype=_U) + _U(1)) * _U(SALT_B))
        return self.values


_WEIGHTS = _Weights()


def segment_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each of the disjoint ascending segments starts..ends-1 of codes.

    The sum of code times a weight of the place in the segment. The weights are no powers of a
    base, so there are no strings, like Thue and Morse's, whose difference a base cannot see.
    """
    if not len(starts):
        return np.zeros(0, _U)
    step = np.zeros(len(codes) + 1, np.int64)
    full = ends > starts
    step[starts[full]] = np.diff(starts[full], prepend=0)
    place = np.arange(len(codes)) - np.cumsum(step[:-1])
    total = np.zeros(len(codes) + 1, _U)
    np.cumsum(codes * _WEIGHTS.upto(int(place.max(initial=0)) + 1)[place], out=total[1:])
    return mix(total[ends] - total[starts] + (ends - starts).astype(_U) * _U(SALT_A))


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A mixed hash of pairs of hashes, in order."""
    x = left * _U(SALT_A)
    x += right
    x ^= x >> _U(32)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    return x


class WindowHash:
    """Hashes of slices: two halves are paired and mixed, level by level; no algebra that structured texts could cancel in."""

    def __init__(self, symbols: np.ndarray):
        self.levels = [symbols]

    def _level(self, j: int) -> np.ndarray:
        while len(self.levels) <= j:
            half, x = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(_paired(x[:-half], x[half:]) if len(x) > half else np.zeros(0, _U))
        return self.levels[j]

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all slices of k symbols."""
        if len(self.levels[0]) < k:
            return np.zeros(0, _U)
        j = k.bit_length() - 1
        x, rest = self._level(j), k - (1 << j)
        return _paired(x[: len(x) - rest], x[rest:]) if rest else x

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the slices start..end-1, lengths included; a level's slices share a length's highest bit."""
        n = end - start
        out = np.zeros(len(n), _U)
        high = np.frexp(n.astype(np.float64))[1] - 1
        for j in np.unique(high[n > 0]).tolist():
            at = np.flatnonzero((high == j) & (n > 0))
            x = self._level(j)
            out[at] = _paired(x[start[at]], x[end[at] - (1 << j)])
        return mix(out + n.astype(_U) * _U(SALT_B))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0])
    return raw[first : int(offsets[-1])], offsets - first


def pieces(offsets: np.ndarray, most: int = 2 << 20):
    """Consecutive document ranges [a, b) of at most `most` bytes each (a longer document alone)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (n+1 values)."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~WHITE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets[:-1]] = True
    edge[offsets[-1]] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each word's bytes."""
    return segment_hashes(BYTE_CODES[raw], starts, ends)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


#: Bits of a place beside which a k-gram's hash is compared, the same for every piece; longer texts are cut in blocks.
_PLACE_BITS = 24


def _anchors(grams: np.ndarray, w: int, block: int) -> np.ndarray:
    """The leftmost least of each w consecutive grams, by the hash's upper 40 bits."""
    out, low = [], _U(_PLACE_BITS)
    for a in range(0, len(grams) - w + 1, block):
        part = grams[a : a + block + w - 1]
        least = sliding_min((part >> low << low) | np.arange(len(part), dtype=_U), w)
        out.append((least & ((_U(1) << low) - _U(1))).astype(np.int64) + a)
    return np.concatenate(out)


def anchored_spans(symbols: np.ndarray, first: np.ndarray, window: int, k: int, block: int = 1 << 23):
    """Cuts every document's windows into runs that share a minimiser.

    symbols: the hashed symbols of all documents, document d's at first[d]:first[d+1].
    Each window of `window` symbols is represented by the least hash among its k-grams (upper
    40 bits, leftmost if tied), so equal windows have equal representatives at equal offsets.
    Returns, per run of consecutive windows with one representative: document, position
    of the first window, number of windows, position of the anchor, the anchor's hash; and
    the hashes of all symbols' windows, for the contents.
    """
    n, w = len(symbols), window - k + 1
    hashes = WindowHash(symbols)
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, _U), hashes)
    grams = mix(hashes.windows(k))
    anchor = _anchors(grams, w, block)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    head = np.empty(len(anchor), bool)
    head[0] = True
    head[1:] = (anchor[1:] != anchor[:-1]) | (doc[1 : len(anchor)] != doc[: len(anchor) - 1])
    valid = doc[: len(anchor)] == doc[window - 1 :]
    head[1:] |= valid[1:] != valid[:-1]
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, len(anchor)))
    real = valid[at]
    at, count = at[real], count[real]
    return doc[at], at, count, anchor[at], grams[anchor[at]], hashes
