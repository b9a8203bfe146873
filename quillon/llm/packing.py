"""Operator 6, packing: cutting-stock column generation over the length histogram.

A document's ids are cut into full sequences, one piece whose length is a multiple of UNIT,
and a tail shorter than UNIT. The lengths that remain fall into at most 2 * (capacity / UNIT)
classes, whose counts are all that reaches the driver. For them a linear program chooses how
often to cut each pattern; a knapsack by dynamic programming prices new patterns with the
program's dual values until none improves it. The solution is rounded down, the few pieces
left are placed first-fit decreasing, and patterns are assigned to ranked pieces: the k-th
piece of a class finds its sequence and offset by arithmetic on the table of patterns.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPACE, Generations, Merger, kept, packed
from .shared import give_back, small_batches, written

CAPACITY, UNIT = 4096, 64
#: The id that ends a document.
END_ID = 2
WORD = re.compile(rf"[^{SPACE}]+")
#: Characters whose normal form and lower case depend on themselves alone, and the pre-tokens among them.
PLAIN = re.compile("[!-~À-ÖØ-öø-įĲ-ľŁ-ňŊ-ž]+")
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[\W_]+")
#: The rank of a pair that never merges.
NEVER = 1 << 30
#: White space to str.split that isn't to the pre-tokeniser.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Words, and as many pre-tokens, of a generation that a Python worker remembers: 183 MB after a quarter of check_l (100,000: 42 MB, for half as much CPU time again).
GENERATION = 400_000


class WordIds:
    """Ids as the tokenizers library gives them, remembered by word: no pre-token crosses white space.

    Words of plain characters are split and merged here; all others go to the library.
    """

    def __init__(self, spec: str, generation: int = GENERATION):
        from tokenizers import Tokenizer

        model = json.loads(spec)["model"]
        self.merge = Merger(model, model["end_of_word_suffix"])
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)").search
        self.words = Generations(self._word, generation)
        self.parts = Generations(self._part, generation)

    def _part(self, part: str) -> bytes:
        """One pre-token: by scans for the least rank if short, by the queue else."""
        data = part.encode()
        if len(data) > 32:
            return packed(self.merge(data))
        of, last = self.merge.byte_id, data[-1]
        ids = [of[b] for b in data]
        ids[-1] = self.merge.last_id[last]
        rank_of, pairs = self.merge.ranks.get, self.merge.pairs
        ranks = [rank_of(a << 24 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            ids[i] = whole = pairs[least][2]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << 24 | whole, NEVER)
            if i < len(ranks):
                ranks[i] = rank_of(whole << 24 | ids[i + 1], NEVER)
        return packed(ids)

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.parts[word.lower()]
        if not PLAIN.fullmatch(word) or self.special(word):
            return packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return b"".join(map(self.parts.__getitem__, PRETOKEN.findall(word.lower())))

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, WORD.findall(text) if SEPARATORS.search(text) else text.split()))


def cut(tokens: int, capacity: int = CAPACITY, unit: int = UNIT) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    out = [(s, capacity) for s in range(0, tokens - capacity + 1, capacity)]
    at = len(out) * capacity
    whole = (tokens - at) // unit * unit
    if whole:
        out.append((at, whole))
    if tokens - at - whole:
        out.append((at + whole, tokens - at - whole))
    return out


def _pieces(spec, capacity: int, unit: int, generation: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back()  # the worker may have served other stages
    encode, end = kept(WordIds, spec.value, generation), np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        row, starts, lengths, sums, totals = [], [], [], [], []
        for i, text in enumerate(batch["text"].to_pylist()):
            ids = encode(text or "") + end
            for start, length in cut(len(ids) // 4, capacity, unit):
                row.append(i)
                starts.append(start)
                lengths.append(length)
                sums.append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                totals.append(len(ids) // 4)
        yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row, pa.int32())), *[pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    give_back()


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern that fits."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = np.flatnonzero(sizes <= room)
        if len(fits):
            gains = best[room - sizes[fits]] + values[fits]
            top = int(np.argmax(gains))
            if gains[top] > best[room] + 1e-12:
                best[room], choice[room] = gains[top], fits[top]
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), pattern


def column_generation(counts: np.ndarray, sizes: np.ndarray, capacity: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Basic patterns (columns) and how often the linear program uses each; revised simplex."""
    basis = np.diag(capacity // sizes).astype(float)
    used = counts / np.diag(basis)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, pattern = price(duals, sizes, capacity)
        if value <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        used = np.maximum(used - step * direction, 0)
        used[out] = step
        basis[:, out] = pattern
    return basis.astype(np.int64).T, used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: pieces}) that use up the histogram exactly."""
    out: list[tuple[int, dict[int, int]]] = []
    sizes = np.array(sorted(s for s, n in histogram.items() if n and s < capacity), np.int64)
    if histogram.get(capacity):
        out.append((histogram[capacity], {capacity: 1}))
    if not len(sizes):
        return out
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    scale = int(np.gcd.reduce(np.append(sizes, capacity)))
    patterns, used = column_generation(left.astype(float), sizes // scale, capacity // scale)
    for at in np.argsort(-used):
        has = patterns[at] > 0
        times = min(int(used[at] + 1e-6), int((left[has] // patterns[at][has]).min()))
        if times:
            out.append((times, {int(s): int(k) for s, k in zip(sizes[has], patterns[at][has])}))
            left = left - times * patterns[at]
    while left.any():  # first-fit decreasing; at most about one sequence for each pattern above
        room, chosen = capacity, {}
        for at in range(len(sizes) - 1, -1, -1):
            k = min(int(left[at]), room // int(sizes[at]))
            if k:
                chosen[int(sizes[at])] = k
                room -= k * int(sizes[at])
        times = min(int(left[np.searchsorted(sizes, s)]) // k for s, k in chosen.items())
        for s, k in chosen.items():
            left[np.searchsorted(sizes, s)] -= k * times
        out.append((times, chosen))
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, unit: int = UNIT, generation: int = GENERATION) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of each row of docs.

    A null or empty text is the end id alone: one piece of length 1. Repeated rows are packed
    each. Pieces that are a multiple of `unit` and tails go to different sequences. A sequence
    not filled is padded to capacity unless its length is a power of two. An empty table gives
    an empty table. `generation` bounds what a Python worker remembers, not the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    (kind,) = [t for c, t in docs.dtypes if c == "doc_id"]
    pieces = docs.select("doc_id", "text").mapInArrow(partial(_pieces, spec, capacity, unit, generation), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    # the table fixes a unique number for each piece; its high bits are the writing task, a bounded group
    pieces = written(pieces.withColumn("uid", F.monotonically_increasing_id()).withColumn("task", F.shiftrightunsigned("uid", 33)), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most 2 * capacity / unit rows
    coarse = plan({s: n for s, n in histogram.items() if s % unit == 0}, capacity)
    fine = plan({s: n for s, n in histogram.items() if s % unit}, capacity)
    table, sequence, taken = [], 0, {}
    for times, pattern in coarse + fine:
        offset = 0
        for size, k in pattern.items():
            first = taken.get(size, 0)
            table.append((size, first, first + times * k, sequence, k, offset))
            taken[size] = first + times * k
            offset += size * k
        sequence += times
    patterns = spark.createDataFrame(table, "length long, first long, stop long, sequence long, k long, base long")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("length", "task", "before")
    ranked = pieces.withColumn("row", F.row_number().over(Window.partitionBy("length", "task").orderBy("uid"))).join(before, ["length", "task"])
    ranked = ranked.withColumn("rank", F.col("row") - 1 + F.col("before"))
    # the patterns of a length partition its ranks: a piece meets one of them
    per_length = patterns.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "stop", "sequence", "k", "base"))).alias("patterns"))
    placed = ranked.join(F.broadcast(per_length), "length").withColumn("p", F.expr("filter(patterns, x -> rank >= x.first AND rank < x.stop)[0]"))
    inside = F.col("rank") - F.col("p.first")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("p.sequence") + F.expr("(rank - p.first) div p.k")).alias("sequence_id"),
        (F.col("p.base") + (inside % F.col("p.k")) * F.col("length")).alias("offset"),
    )
