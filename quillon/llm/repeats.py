"""The distributed frame under both exact substring operators.

Goal: which windows of W symbols (words or bytes) of a document occur anywhere else,
without comparing documents in pairs and without a corpus-sized structure in one place.

1. Each document's windows are cut into runs that share a minimiser, the anchor
   (`sequences.anchored_spans`). Equal windows have equal anchors at equal offsets, so an
   anchor that occurs once proves all its windows unique. The runs are written once, a row
   for each input row, whose number stands for it from here on. One record per run is
   shuffled, about one per 11 words or 63 bytes, never the windows.
2. Records of repeated anchors are written to the shared folder and grouped by content
   (anchor hash and span hash, 128 bits): a class of equal runs is examined once, with its
   multiplicity, whatever the number of copies.
3. The classes' contents are routed by anchor to reference shards of a bounded number of
   symbols. There the operator's own method (a suffix automaton, or a hash-compared suffix
   sort) decides which windows occur twice or more.
4. An anchor with more than `hot` different contents would make an unbounded shard. Its
   windows are counted one by one instead, by 128-bit hash with partial aggregation: exact,
   and no key holds more than the copies of one window, which are summed before the shuffle.
5. The verdicts go back to the classes' occurrences and, gathered per document, to the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import BYTE_CODES, SALT_A, SALT_B, WindowHash, anchored_spans, mix, pieces, text_buffers, word_bounds, word_hashes
from .shared import carried, forget, restored, row_keys, small_batches, written

#: Different contents of one anchor beyond which its windows are counted singly.
HOT = 4000
#: Symbols of one reference shard.
SHARD = {"words": 30_000, "bytes": 400_000}
_PIECE = {"words": 512 << 10, "bytes": 256 << 10}
#: What is known of a run: hashes of its anchor and its content, first window, the anchor's place from there, windows.
_RUN = {"anchor": pa.int64(), "span": pa.int64(), "start": pa.int32(), "lead": pa.int16(), "n": pa.int16()}


class Symbols:
    """The symbols of the documents of one piece: hashes, first symbol of each document, byte bounds."""

    def __init__(self, unit: str, raw: np.ndarray, offsets: np.ndarray):
        if unit == "words":
            self.starts, self.ends, self.first = word_bounds(raw, offsets)
            self.codes = word_hashes(raw, self.starts, self.ends)
        else:
            self.starts, self.first = None, offsets
            self.codes = BYTE_CODES[raw]

    def cut(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte bounds of the symbols lo..hi-1."""
        return (lo, hi) if self.starts is None else (self.starts[lo], self.ends[hi - 1])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def _records(unit: str, window: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each row that has any, as lists."""
    for batch in batches:
        raw, offsets = text_buffers(batch["text"])
        for a, b in pieces(offsets, _PIECE[unit]):
            s = Symbols(unit, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            doc, start, n, anchor, key, hashes = anchored_spans(s.codes, s.first, window, gram)
            lead = anchor - start
            content = hashes.slices(start, start + n + window - 1)
            span = mix(content + lead.astype(np.uint64) * np.uint64(SALT_A))
            runs = np.bincount(doc, minlength=b - a)
            ends = pa.array(np.concatenate([[0], np.cumsum(runs)]).astype(np.int32))
            values = [_signed(key), _signed(span), start - s.first[doc], lead, n]
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(t.to_pandas_dtype(), copy=False))) for v, t in zip(values, _RUN.values())]
            made = pa.RecordBatch.from_arrays([*[batch[c].slice(a, b - a) for c in ("row_id", "k1", "k2")], *lists], ["row_id", "k1", "k2", *_RUN])
            yield made.filter(pa.array(runs > 0))


def _contents(unit: str, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the class representatives that each document holds."""
    for batch in batches:
        raw, offsets = text_buffers(batch["text"])
        wanted = batch["wanted"]
        at = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
        rows = wanted.flatten()
        start, n = rows.field("start").to_numpy(), rows.field("n").to_numpy()
        for a, b in pieces(offsets, 4 << 20):
            piece = raw[offsets[a] : offsets[b]]
            s = Symbols(unit, piece, offsets[a : b + 1] - offsets[a])
            r = slice(at[a], at[b])
            lo = np.repeat(s.first[:-1], np.diff(at[a : b + 1])) + start[r]
            left, right = s.cut(lo, lo + n[r] + window - 1)
            text = piece.tobytes()
            content = pa.array([text[i:j] for i, j in zip(left.tolist(), right.tolist())], pa.binary())
            sub = rows.slice(at[a], at[b] - at[a])
            yield pa.RecordBatch.from_arrays([sub.field(c) for c in ("anchor", "span", "copies", "lead", "n")] + [content], ["anchor", "span", "copies", "lead", "n", "content"])


def _shards(unit: str, decide: Callable, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole anchors (rows come sorted by anchor) are gathered into shards and decided together."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        anchors, spans, lows, highs = [], [], [], []
        for row, found in zip(rows, decide([(r[0], r[2], r[3], r[4], r[5]) for r in rows], window)):
            for lo, hi in found:
                anchors.append(row[0]), spans.append(row[1]), lows.append(lo), highs.append(hi)
        return pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(spans, pa.int64()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32())], ["anchor", "span", "lo", "hi"])

    held, size = [], 0
    for batch in batches:
        for row in zip(*[batch[c].to_pylist() for c in ("anchor", "span", "copies", "lead", "n", "content")]):
            if size >= SHARD[unit] and row[0] != held[-1][0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += row[4] + window - 1
    if held:
        yield flush(held)


def _windows(unit: str, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a hot anchor's contents as two hashes."""
    for batch in batches:
        raw, offsets = text_buffers(batch["content"])
        n, copies = batch["n"].to_numpy().astype(np.int64), batch["copies"].to_numpy()
        s = Symbols(unit, raw, offsets)
        row = np.repeat(np.arange(len(n)), n)
        lo = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = s.first[row] + lo
        one, two = (WindowHash(x).windows(window)[at] for x in (s.codes, mix(s.codes ^ np.uint64(SALT_B))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(_signed(one)), pa.array(_signed(two)), batch["anchor"].take(pa.array(row)), batch["span"].take(pa.array(row)), pa.array(lo.astype(np.int32)), pa.array(copies[row])],
            ["one", "two", "anchor", "span", "lo", "copies"],
        )


def _runs(batches: Iterator[pa.RecordBatch], unit: str, window: int, finish: Callable) -> Iterator[pa.RecordBatch]:
    """Turns the covered symbols of each document into disjoint sorted runs and hands them to `finish`."""
    for batch in batches:
        raw, offsets = text_buffers(batch["text"])
        marks = batch["marks"]
        if marks.null_count:
            marks = marks.fill_null([])
        at = marks.offsets.to_numpy() - marks.offsets[0].as_py()
        flat = marks.flatten()
        lo, hi = flat.field("lo").to_numpy().astype(np.int64), flat.field("hi").to_numpy().astype(np.int64)
        columns = [[] for _ in finish.columns]
        for a, b in pieces(offsets, 1 << 20):
            piece = raw[offsets[a] : offsets[b]]
            s = Symbols.__new__(Symbols)
            if unit == "words":
                s.starts, s.ends, s.first = word_bounds(piece, offsets[a : b + 1] - offsets[a])
                size = len(s.starts)
            else:
                s.starts, s.ends, s.first = None, None, offsets[a : b + 1] - offsets[a]
                size = len(piece)
            r = slice(at[a], at[b])
            base = np.repeat(s.first[:-1], np.diff(at[a : b + 1]))
            step = np.zeros(size + 1, np.int64)
            np.add.at(step, base + lo[r], 1)
            np.add.at(step, base + hi[r] + window, -1)
            covered = np.cumsum(step[:-1]) > 0
            for column, values in zip(columns, finish(piece, offsets[a : b + 1] - offsets[a], s, covered)):
                column.extend(values)
        own = [batch[c] for c in batch.schema.names if c not in ("text", "marks")]
        yield pa.RecordBatch.from_arrays(own + [pa.array(c, t) for c, (_, t) in zip(columns, finish.columns)], [c for c in batch.schema.names if c not in ("text", "marks")] + [c for c, _ in finish.columns])


def repeated_windows(docs: DataFrame, unit: str, window: int, gram: int, decide: Callable, finish: Callable, schema: str, carry: list[str], hot: int = HOT) -> DataFrame:
    """docs (doc_id, text and the columns of `carry`): one row per input row, `carry` plus finish's columns.

    Input rows are counted each; texts are found again by 128 bits of doc_id and text, so rows that
    share these get equal results. decide(rows, window) gets (anchor, copies, lead, n, content) of
    whole anchors and gives each row's inclusive ranges of repeated window offsets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own, own_schema = carried(docs, carry)
    one = docs.select(*row_keys(docs), F.coalesce(docs["text"], F.lit("")).alias("text"), *own)
    numbered = one.select(F.monotonically_increasing_id().alias("row_id"), "k1", "k2", "text")
    kinds = ", ".join(f"{c} array<{t}>" for c, t in zip(_RUN, ("long", "long", "int", "short", "short")))
    runs = written(numbered.mapInArrow(partial(_records, unit, window, gram), f"row_id long, k1 long, k2 long, {kinds}"), "runs")
    # a table of its own, so that the join below shuffles both sides itself and can split a hot anchor
    repeated = written(runs.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("rows")).where("rows > 1").select("anchor"), "repeated")
    records = runs.select("row_id", F.explode(F.arrays_zip(*_RUN)).alias("x")).select("row_id", "x.*")
    shared = written(records.join(repeated.hint("shuffle_merge"), "anchor"), "shared")
    # one row stands for all of equal doc_id and text: the first, which is also the one that its classes name
    named = written(runs.groupBy("k1", "k2").agg(F.min("row_id").alias("row_id")), "named")
    forget(runs, repeated)
    classes = written(
        shared.groupBy("anchor", "span").agg(F.count("*").alias("copies"), F.min(F.struct("row_id", "start", "lead", "n")).alias("first")).select("anchor", "span", "copies", "first.*"),
        "classes",
    )
    variety = classes.groupBy("anchor").agg(F.count("*").alias("contents"))
    wanted = classes.groupBy("row_id").agg(F.collect_list(F.struct("anchor", "span", "copies", "start", "lead", "n")).alias("wanted"))
    wanted = wanted.join(named.hint("shuffle_merge"), "row_id").select("k1", "k2", "wanted")
    text = one.select("k1", "k2", "text").join(wanted.hint("shuffle_merge"), ["k1", "k2"])
    # a repeated (doc_id, text) row would yield its contents twice
    content = written(text.dropDuplicates(["k1", "k2"]).select("text", "wanted").mapInArrow(partial(_contents, unit, window), "anchor long, span long, copies long, lead short, n short, content binary"), "contents")
    hot_anchor = variety.where(F.col("contents") > hot).select("anchor")
    cold = content.join(hot_anchor, "anchor", "left_anti")
    decided = cold.repartition("anchor").sortWithinPartitions("anchor", "span").mapInArrow(partial(_shards, unit, decide, window), "anchor long, span long, lo int, hi int")
    single = content.join(hot_anchor, "anchor", "left_semi").mapInArrow(partial(_windows, unit, window), "one long, two long, anchor long, span long, lo int, copies long")
    twice = single.groupBy("one", "two").agg(F.sum("copies").alias("rows")).where("rows > 1").select("one", "two")
    counted = single.join(twice.hint("shuffle_merge"), ["one", "two"]).select("anchor", "span", "lo", F.col("lo").alias("hi"))
    verdicts = written(decided.unionByName(counted), "verdicts")
    forget(content, classes)
    marks = shared.join(verdicts.hint("shuffle_merge"), ["anchor", "span"]).select("row_id", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")).groupBy("row_id").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    marks = marks.join(named.hint("shuffle_merge"), "row_id").select("k1", "k2", "marks")
    names = [f"own_{i}" for i in range(len(carry))]
    joined = one.join(marks.hint("shuffle_merge"), ["k1", "k2"], "left").select(*names, "text", "marks")
    out = joined.mapInArrow(partial(_runs, unit=unit, window=window, finish=finish), f"{own_schema}, {schema}")
    return out.select(*restored(carry), *[c for c, _ in finish.columns])
