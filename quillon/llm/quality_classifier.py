"""Operator 1, quality classifier: nearest-neighbour voting among latent-semantic vectors.

A document's terms are hashed byte trigrams and binned rule statistics; a truncated singular
value decomposition of the labelled sample's weighted term matrix gives the latent space.
The labelled vectors, a bounded table, are broadcast. Every document's cosine with every
labelled vector is computed exactly, in blocks, and the nearest vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import labelled, rule_counts
from .sequences import pieces, text_buffers
from .shared import carried, restored, small_batches

#: Labelled rows fitted at most; hashed terms; bins of a statistic; latent dimensions; neighbours.
SAMPLE, TERMS, BINS, DIMENSIONS, NEIGHBOURS = 5000, 1024, 8, 40, 25
#: Length of the statistics beside the trigrams' 1 in a term vector: half of its square; similarity's power in a vote; the score that is accepted.
STATISTICS_WEIGHT, SHARPNESS, ACCEPT = 1.0, 8, 0.3
_BLOCK = 512


def term_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed byte-trigram counts of each document."""
    n = len(offsets) - 1
    if len(raw) < 3:
        return np.zeros((n, TERMS), np.float32)
    x = raw.astype(np.uint32)
    code = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(22)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    inside = doc[2:] == doc[:-2]
    return np.bincount((doc[:-2] * TERMS + code)[inside], minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)


def _features(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(term counts, statistics, word counts), for a few hundred documents at a time."""
    raw, offsets = text_buffers(batch["text"])
    for a, b in pieces(offsets, 256 << 10):
        for c in range(a, b, _BLOCK):
            d = min(b, c + _BLOCK)
            part, at = raw[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c]
            counts, stats = rule_counts(part, at)
            yield term_counts(part, at), stats, counts[:, 0]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = list(_features(batch))
        rows = [(t.astype("<f2").tobytes(), s.astype("<f8").tobytes()) for terms, stats, _ in parts for t, s in zip(np.minimum(terms, 60000), stats)]
        yield pa.RecordBatch.from_arrays([batch["quality"], batch["place"], pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["quality", "place", "terms", "stats"])


class Model:
    """Term weights, the latent projection, and the labelled vectors."""

    def __init__(self, terms: np.ndarray, stats: np.ndarray, labels: np.ndarray):
        self.idf = np.log1p(len(terms) / (1 + (terms > 0).sum(0))).astype(np.float32)
        self.edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
        # the bounds of each class widen the bins, so that a rare class is not one bin with its neighbours
        for label in (0, 1):
            if (labels == label).any():
                self.edges = np.concatenate([self.edges, np.quantile(stats[labels == label], [0.02, 0.5, 0.98], axis=0)])
        self.edges = np.sort(self.edges, axis=0)
        x = self.weighted(terms, stats)
        _, _, axes = np.linalg.svd(x, full_matrices=False)
        self.axes = np.ascontiguousarray(axes[: min(DIMENSIONS, len(axes))].T, np.float32)
        self.vectors = self.unit(x @ self.axes)
        self.labels = labels.astype(np.float32)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def weighted(self, terms: np.ndarray, stats: np.ndarray) -> np.ndarray:
        x = self.unit(np.log1p(terms) * self.idf)
        bins = np.stack([(stats >= edge) for edge in self.edges], 2).astype(np.float32) - 0.5
        y = self.unit(bins.reshape(len(stats), -1))
        return np.concatenate([x, STATISTICS_WEIGHT * y], 1)

    def score(self, terms: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest."""
        cosine = self.unit(self.weighted(terms, stats) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** SHARPNESS
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    small_batches(docs.sparkSession)
    training = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    rows = labelled(docs, labels, sample, training).mapInArrow(_sampled, "quality int, place long, terms binary, stats binary").collect()
    rows.sort(key=lambda r: r["place"])
    if not rows:
        return None
    terms = np.stack([np.frombuffer(r["terms"], "<f2") for r in rows]).astype(np.float32)
    return Model(terms, np.stack([np.frombuffer(r["stats"], "<f8") for r in rows]), np.array([r["quality"] for r in rows]))


def _scored(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        scores = [np.where(words > 0, model.score(terms, stats), 0.0) if model else np.full(len(words), 0.5) * (words > 0) for terms, stats, words in _features(batch)]
        scores = np.clip(np.concatenate(scores) if scores else np.zeros(0), 0, 1).astype(float)
        own = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in own], pa.array(scores), pa.array((scores >= ACCEPT).astype(np.int32))], own + ["score", "predicted"])


def quality_classifier(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """The columns of carry (doc_id), then held_out, score and predicted for each row of docs (doc_id, text).

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are fitted, at most `sample` of them.
    A text without words, null or empty, has nothing that could vote for it: score 0. Without
    any labelled row, other texts score 0.5. Repeated rows are scored each. A null doc_id
    counts as the empty text.
    """
    carry = carry or ["doc_id"]
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    columns, schema = carried(docs, carry)
    own = docs.select(*columns, held_out.alias("held_out"), "text")
    out = own.mapInArrow(partial(_scored, model), f"{schema}, held_out boolean, score double, predicted int")
    return out.select(*restored(carry), "held_out", "score", "predicted")
