"""Operator 4, quality rules: counted rules, then an isolation forest on the rules' statistics.

Random trees split random statistics within the bounds of all labelled documents. Half of those
of quality 1 are counted in the trees' nodes, every one in every tree; unusual rows end on short
paths. The anomaly score beyond which a document is rejected is an exact rank among the scores of
the other half. Nothing is sampled: bounds, counts and scores are got where the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import BYTE_CODES, SALT_A, SALT_B, WindowHash, mix, pieces, segment_hashes, text_buffers, word_bounds, word_hashes
from .shared import carried, forget, restored, small_batches, written

REPEAT, MIN_WORDS, MOST_REPEATED = 8, 20, 30
#: Trees; each is as deep as one of this many rows, and counts all rows.
TREES, SUBSAMPLE = 120, 256
#: The share of labelled rows of quality 1 that the calibrated threshold may reject.
CLEAN_LOSS = 0.004


def _flags(chars: str | range) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) if isinstance(c, str) else c for c in chars]] = 1
    return out


SYMBOLS, UPPER, DIGITS, STOPS, HEADS = _flags("#*$%&|<>"), _flags(range(65, 91)), _flags(range(48, 58)), _flags(".,;:!?"), _flags([b for b in range(256) if b & 0xC0 != 0x80])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = ("log words", "word length", "symbols", "repeated lines", "repeated words", "upper case", "digits", "stops", "distinct words", "one-letter words", "word length spread", "stop runs")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(doc: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Number of different codes of each document."""
    keys = mix(codes + doc.astype(np.uint64) * np.uint64(SALT_B))
    order = np.argsort(keys)
    found = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = found[1:] != found[:-1]
    return np.bincount(doc[order[fresh]], minlength=n)


def rule_counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS and STATISTICS of each document, a row each."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(raw, offsets)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    codes = word_hashes(raw, starts, ends)
    heads = np.concatenate([[0], np.cumsum(HEADS[raw])])
    length = heads[ends] - heads[starts]
    # lines: bounded by \n and by the documents' ends
    breaks = np.flatnonzero(raw == 10)
    left = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    right = np.sort(np.concatenate([breaks, offsets[1:]]))
    line_doc = np.searchsorted(offsets, left, "right") - 1
    # a line that starts where the next document does belongs to a document that ends with \n or is empty
    busy = np.searchsorted(starts, right) > np.searchsorted(starts, left)
    left, right, line_doc = left[busy], right[busy], line_doc[busy]
    lines = segment_hashes(BYTE_CODES[raw], left, right)
    dup_lines = np.bincount(line_doc, minlength=n) - _distinct(line_doc, lines, n)
    repeated = np.zeros(len(starts), bool)
    if len(codes) >= REPEAT:
        windows = WindowHash(codes).windows(REPEAT)
        at = np.flatnonzero(doc[: len(windows)] == doc[REPEAT - 1 :])
        keys = mix(windows[at] + doc[at].astype(np.uint64) * np.uint64(SALT_A))
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(len(starts) + 1, np.int64)
        step[at[twice]] += 1
        step[at[twice] + REPEAT] -= 1
        repeated = np.cumsum(step[:-1]) > 0
    repeat_words = _sums(repeated, first)
    chars, word_chars, symbols = _sums(HEADS[raw], offsets), _sums(length, first), _sums(SYMBOLS[raw], offsets)
    counts = np.stack([words, word_chars, symbols, dup_lines, repeat_words], 1).astype(np.int64)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    mean = word_chars / w
    stops = STOPS[raw]
    runs = stops.copy()
    runs[1:] *= stops[:-1]
    runs[:1] = 0
    stats = np.stack([
        np.log1p(words), mean, symbols / c, dup_lines / np.maximum(1, np.bincount(line_doc, minlength=n)), repeat_words / w, _sums(UPPER[raw], offsets) / c, _sums(DIGITS[raw], offsets) / c,
        _sums(stops, offsets) / w, _distinct(doc, codes, n) / w ** 0.9, _sums(length == 1, first) / w, np.sqrt(np.maximum(_sums(length * length, first) / w - mean * mean, 0)), _sums(runs, offsets) / w,
    ], 1)
    return counts, stats


class IsolationForest:
    """Random trees as arrays; a row's score is 2 ** (-mean path / expected path).

    Splits are drawn over the box that a node stands for, not over its rows: the root's box
    spans `low` to `high`, so that a region which the growing rows do not reach ends early. So
    the trees are drawn before any row is seen, and rows may be counted anywhere: `size` is
    then their number, and `settle` gets the sums of their `counts`.
    """

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7, size: int | None = None):
        rng = np.random.default_rng(seed)
        self.size = len(rows) if size is None else size
        self.depth = max(1, int(np.ceil(np.log2(max(2, min(subsample, self.size))))))
        self.expected = float(self._path(np.array(self.size))) or 1.0
        nodes = 2 ** (self.depth + 1)
        self.feature = np.zeros((trees, nodes), np.int32)
        self.split = np.full((trees, nodes), np.inf)
        self.path = np.zeros((trees, nodes))
        self._draw(low, high, rng)
        self.settle(self.counts(rows))

    @staticmethod
    def _path(n: np.ndarray) -> np.ndarray:
        """Expected path length of an unsuccessful search among n rows."""
        m = np.maximum(n, 3)
        return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m))

    def _draw(self, low: np.ndarray, high: np.ndarray, rng) -> None:
        choice = np.flatnonzero(high > low)
        if not len(choice):
            return  # no statistic differs: all rows go left
        trees = len(self.path)
        low, high = np.tile(low, (trees, 1, 1)).astype(float), np.tile(high, (trees, 1, 1)).astype(float)
        for level in range(self.depth):
            width = 1 << level
            tree, at = np.indices((trees, width))
            f = rng.choice(choice, (trees, width))
            split = rng.uniform(low[tree, at, f], high[tree, at, f])
            self.feature[:, width : 2 * width], self.split[:, width : 2 * width] = f, split
            low, high = np.repeat(low, 2, axis=1), np.repeat(high, 2, axis=1)
            high[tree, 2 * at, f] = low[tree, 2 * at + 1, f] = split

    def _leaves(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """The rows' nodes on the last level, tree by tree."""
        at_row = np.arange(len(rows))
        for feature, split in zip(self.feature, self.split):
            node = np.ones(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (rows[at_row, feature[node]] > split[node])
            yield node

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Number of rows in each node of the last level, a row a tree."""
        return np.stack([np.bincount(leaf, minlength=self.path.shape[1]) for leaf in self._leaves(rows)])

    def settle(self, counts: np.ndarray) -> None:
        """Sets the path lengths by the number of rows in each node of the last level."""
        counts = counts.copy()
        for level in range(self.depth - 1, -1, -1):
            width = 1 << level
            counts[:, width : 2 * width] = counts[:, 2 * width : 4 * width : 2] + counts[:, 2 * width + 1 : 4 * width : 2]
        ended = np.zeros((len(counts), 1), bool)
        self.path[:] = 0
        for level in range(self.depth + 1):
            here = slice(1 << level, 2 << level)
            if level:
                # below a node of one row or none, its path length holds
                ended, above = np.repeat(ended, 2, axis=1), np.repeat(self.path[:, (1 << level) >> 1 : 1 << level], 2, axis=1)
                self.path[:, here] = np.where(ended, above, 0.0)
            ends = ~ended & ((counts[:, here] <= 1) | (level == self.depth))
            self.path[:, here] = np.where(ends, level + self._path(counts[:, here]), self.path[:, here])
            ended = ended | ends

    def score(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for path, leaf in zip(self.path, self._leaves(rows)):
            out += path[leaf]
        return 2.0 ** (-out / len(self.path) / self.expected)


def _counted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_buffers(batch["text"])
    parts = [rule_counts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets, 256 << 10)]
    if not parts:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(STATISTICS)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(list(_counted(batch)[1]), pa.list_(pa.float64()))], ["doc_id", "stats"])


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return batch["stats"].flatten().to_numpy().reshape(-1, len(STATISTICS))


def _leaf_counts(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of all batches together, those that are not 0, by their places in the trees' arrays."""
    forest = model.value
    total = np.zeros(forest.path.shape, np.int64)
    for batch in batches:
        total += forest.counts(_stats(batch))
    leaf = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(total.ravel()[leaf])], ["leaf", "n"])


def _scores(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(model.value.score(_stats(batch)))], ["score"])


def marked(labels: DataFrame) -> DataFrame:
    """doc_id and its least label, for all rows of labels that have both."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    return rows.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def labelled(docs: DataFrame, labels: DataFrame, sample: int, where=None) -> DataFrame:
    """At most `sample` labelled rows (quality, place, text) in the order of a hash of doc_id.

    A document's label is its least one; rows without an id, text or label are left out.
    """
    rows = marked(labels).withColumn("place", F.xxhash64("doc_id"))
    if where is not None:
        rows = rows.where(where)
    chosen = rows.orderBy("place", "doc_id").limit(sample)  # a bounded sample, so it may be broadcast
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return found.where("text is not null").dropDuplicates(["doc_id"]).select("quality", "place", "text")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[IsolationForest | None, float]:
    """The forest and the score beyond which a document is rejected, by all labelled documents.

    A document's label is its least one; rows without an id, text or label are left out, repeated
    rows count each. A bit of doc_id's hash tells the half that grows the forest from the half that
    calibrates. With fewer than 8 rows of quality 1, or with none in a half: no forest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    # statistics before the join: their rows are short, so that no text is shuffled
    found = texts.mapInArrow(_statistics, "doc_id long, stats array<double>").join(marked(labels), "doc_id")
    rows = written(found.select("quality", F.xxhash64("doc_id").bitwiseAND(F.lit(1)).alias("half"), "stats"), "rule-statistics")
    try:
        growing, calibrating = (F.expr(f"quality = 1 and half = {h}") for h in (0, 1))
        bounds = [f(F.col("stats")[i]) for f in (F.min, F.max) for i in range(len(STATISTICS))]
        grown, calibrated, *bounds = rows.agg(F.count_if(growing), F.count_if(calibrating), *bounds).first()
        if grown + calibrated < 8 or not grown or not calibrated:
            return None, 1.0
        low, high = np.array(bounds).reshape(2, -1)
        forest = IsolationForest(np.zeros((0, len(low))), low, high, size=grown)
        drawn = spark.sparkContext.broadcast(forest)
        leaves = rows.where(growing).select("stats").mapInArrow(partial(_leaf_counts, drawn), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(forest.path.size, np.int64)
        counts[[r["leaf"] for r in leaves]] = [r["n"] for r in leaves]
        forest.settle(counts.reshape(forest.path.shape))
        settled = spark.sparkContext.broadcast(forest)
        scores = rows.where(calibrating).select("stats").mapInArrow(partial(_scores, settled), "score double")
        # the threshold's rank from above, so that only CLEAN_LOSS of the scores meet in one task
        rank = calibrated - min(calibrated - 1, int(np.ceil(calibrated * (1 - CLEAN_LOSS))))
        limit = scores.orderBy(F.desc("score")).limit(rank).agg(F.min("score")).first()[0]
        return forest, limit + 1e-9
    finally:
        forget(rows)


def _judge(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, limit = model.value
    for batch in batches:
        counts, stats = _counted(batch)
        words, repeats = counts[:, 0], counts[:, 4]
        failed = (words < MIN_WORDS) | (100 * repeats > MOST_REPEATED * words)
        scores = forest.score(stats) if forest else np.zeros(len(words))
        own = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in own], *[pa.array(counts[:, i]) for i in range(len(COUNTS))], pa.array(failed), pa.array(~failed & (scores <= limit)), pa.array(scores)], own + [*COUNTS, "base_failed", "kept", "anomaly"])


def quality_rules(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The columns of carry (doc_id), then COUNTS, base_failed, kept and anomaly for each row of docs.

    Null and empty texts have no words and fail. Repeated rows are judged each. With fewer than
    8 labelled rows of quality 1, or with all in one half, there is no forest, and the counted rules alone decide.
    """
    carry = carry or ["doc_id"]
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    columns, schema = carried(docs, carry)
    figures = ", ".join([f"{c} long" for c in COUNTS] + ["base_failed boolean, kept boolean, anomaly double"])
    out = docs.select(*columns, "text").mapInArrow(partial(_judge, model), f"{schema}, {figures}")
    return out.select(*restored(carry), *COUNTS, "base_failed", "kept", "anomaly")
