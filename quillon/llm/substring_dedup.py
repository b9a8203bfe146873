"""Operator 2, substring dedup: suffix automata of reference shards give matching statistics.

The reference strings are the corpus's own repeated runs (see `repeats`). They are routed by
anchor to shards of a bounded number of words; each shard's generalised suffix automaton is
built with the number of occurrences of every state, and the shard's documents' runs are
streamed through it. At each word the automaton gives the longest suffix that occurs at least
twice in the corpus; where that is `window` words or more, the words are removed. All shards
together hold the corpus's repeated text, which grows with the corpus, so they are not
broadcast whole: a run is sent to the one shard that can hold its matches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import repeated_windows

WINDOW = 35
#: Words of the k-gram that represents a window.
GRAM = 8


class SuffixAutomaton:
    """Generalised suffix automaton of weighted symbol sequences."""

    def __init__(self):
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.weight = [0]
        self.repeated: list[int] | None = None

    def _clone(self, of: int, length: int) -> int:
        self.step.append(self.step[of].copy())
        self.link.append(self.link[of])
        self.length.append(length)
        self.weight.append(0)
        return len(self.link) - 1

    def _redirect(self, state: int, symbol, old: int, new: int) -> None:
        while state >= 0 and self.step[state].get(symbol) == old:
            self.step[state][symbol] = new
            state = self.link[state]

    def add(self, sequence: list, weight: int) -> None:
        step, link, length = self.step, self.link, self.length
        last = 0
        for symbol in sequence:
            q = step[last].get(symbol)
            if q is not None:
                if length[q] != length[last] + 1:
                    twin = self._clone(q, length[last] + 1)
                    link[q] = twin
                    self._redirect(last, symbol, q, twin)
                    q = twin
                last = q
            else:
                new = len(link)
                step.append({})
                link.append(0)
                length.append(length[last] + 1)
                self.weight.append(0)
                p = last
                while p >= 0 and symbol not in step[p]:
                    step[p][symbol] = new
                    p = link[p]
                if p >= 0:
                    q = step[p][symbol]
                    if length[q] == length[p] + 1:
                        link[new] = q
                    else:
                        twin = self._clone(q, length[p] + 1)
                        link[q] = link[new] = twin
                        self._redirect(p, symbol, q, twin)
                last = new
            self.weight[last] += weight

    def close(self) -> None:
        """Sums the occurrences of each state, and finds each state's longest suffix that occurs twice or more."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        weight, link = self.weight, self.link
        for state in reversed(order):
            weight[link[state]] += weight[state]
        weight[0] = 2
        self.repeated = [0] * len(link)
        for state in order:
            self.repeated[state] = state if weight[state] > 1 else self.repeated[link[state]]

    def statistics(self, sequence: list) -> list[int]:
        """For each symbol, the length of the longest suffix ending there that occurs at least twice."""
        out, state, matched = [], 0, 0
        for symbol in sequence:
            while state and symbol not in self.step[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.step[state]:
                state = self.step[state][symbol]
                matched += 1
            twice = self.repeated[state]
            out.append(min(matched, self.length[twice]))
        return out


def ranges(flags: list[bool]) -> list[tuple[int, int]]:
    """Inclusive runs of true values."""
    out, start = [], None
    for i, flag in enumerate(flags):
        if flag and start is None:
            start = i
        elif not flag and start is not None:
            out.append((start, i - 1))
            start = None
    if start is not None:
        out.append((start, len(flags) - 1))
    return out


def decide(rows: list[tuple], window: int) -> list[list[tuple[int, int]]]:
    automaton = SuffixAutomaton()
    sequences = [row[4].split() for row in rows]
    for row, words in zip(rows, sequences):
        automaton.add(words, row[1])
    automaton.close()
    return [ranges([s >= window for s in automaton.statistics(words)[window - 1 :]]) for words in sequences]


class _Kept:
    columns = [("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]

    def __call__(self, raw, offsets, symbols, covered):
        text = raw.tobytes()
        keep = np.flatnonzero(~covered)
        bounds = np.searchsorted(keep, symbols.first)
        total = np.diff(symbols.first)
        starts, ends = symbols.starts[keep].tolist(), symbols.ends[keep].tolist()
        kept = [b" ".join([text[i:j] for i, j in zip(starts[a:b], ends[a:b])]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return [k.decode() for k in kept], total.tolist(), (total - np.diff(bounds)).tolist(), [hashlib.sha256(k).hexdigest() for k in kept]


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed, kept_sha256 for each row of docs (doc_id, text).

    Words are runs of characters other than the six ASCII white-space ones. A word is removed
    if a window of `window` words that covers it also starts elsewhere in the input, the same
    document included. Null and empty texts have no words: 0, 0 and the hash of nothing.
    Repeated rows count as occurrences of each other. An empty table gives an empty table.
    """
    more = {} if hot is None else {"hot": hot}
    return repeated_windows(docs.select("doc_id", "text"), "words", window, gram, decide, _Kept(), "kept_text string, n_words long, n_removed long, kept_sha256 string", ["doc_id"], **more)
