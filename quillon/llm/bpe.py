"""Operator 3, BPE encoding and decoding.

A priority queue holds the adjacent pairs of a doubly linked list of symbols by merge rank;
the least rank is merged first, the leftmost if tied, and entries whose symbols have changed
meanwhile are skipped as stale. Decoding concatenates the vocabulary's byte strings.

A text is first cut where no pre-token can cross: before a single blank in front of a word
and around other white space. The pieces repeat, so their ids are remembered, in two
generations of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import small_batches

#: The white space of the pre-tokeniser, and the pattern that it splits by.
SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PIECE = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The merge ranks of a byte-level BPE vocabulary."""

    def __init__(self, model: dict, suffix: str = ""):
        alphabet = byte_alphabet()
        vocab = model["vocab"]
        self.byte_id, self.last_id = [-1] * 256, [-1] * 256
        for char, byte in alphabet.items():
            self.byte_id[byte] = vocab.get(char, -1)
            self.last_id[byte] = vocab.get(char + suffix, -1)
        self.ranks: dict[int, int] = {}
        self.pairs: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] << 24 | vocab[b], rank)
            self.pairs.append((vocab[a], vocab[b], vocab[a + b]))

    def __call__(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        ids = [self.byte_id[b] for b in data]
        ids[-1] = self.last_id[data[-1]]
        n, rank_of, pairs = len(ids), self.ranks.get, self.pairs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # an entry is a rank and the place of the pair's left symbol; the rank tells both symbols
        queue = [rank << 32 | i for i in range(n - 1) if (rank := rank_of(ids[i] << 24 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            left, right, whole = pairs[entry >> 32]
            j = after[i]
            if j >= n or ids[i] != left or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = whole, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(whole << 24 | ids[k])
                if rank is not None:
                    push(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(ids[h] << 24 | whole)
                if rank is not None:
                    push(queue, rank << 32 | h)
        return [x for x in ids if x >= 0]


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteBpe:
    """Byte-level BPE read from the text of a tokenizer file."""

    def __init__(self, spec: str, generation: int = 400_000):
        model = json.loads(spec)
        alphabet = byte_alphabet()
        vocab = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.strings: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()], default=-1) + 1)
        for token, at in vocab.items():
            self.strings[at] = bytes(alphabet[c] for c in token)
        for token, at in self.special.items():
            self.strings[at] = token.encode()
        self.merge = Merger(model["model"])
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache = Generations(self._piece, generation)
        self.tokens = Generations(lambda token: packed(self.merge(token.encode())), generation)

    def _piece(self, piece: str) -> bytes:
        found = PRETOKEN.findall(piece)
        return packed(self.merge(piece.encode())) if len(found) == 1 else b"".join(map(self.tokens.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if self.split_special is None or not any(t in text for t in self.special):
            return b"".join(map(self.cache.__getitem__, PIECE.findall(text)))
        out = []
        for part in self.split_special.split(text):
            out.append(packed([self.special[part]]) if part in self.special else b"".join(map(self.cache.__getitem__, PIECE.findall(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


#: Characters of a piece beyond which its ids are not remembered: long pieces are rare, and a few could fill a worker.
REMEMBERED = 64


class Generations(dict):
    """A dict that computes missing values, and forgets those unused for a generation. Long keys are not kept, so its size is bounded in bytes too."""

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        if len(key) > REMEMBERED:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_kept: dict = {}


def kept(make, spec: str, *bounds: int):
    """make(spec, *bounds), once per Python worker: what a model remembers serves the worker's later tasks."""
    key = make.__name__, hashlib.sha256(spec.encode()).digest(), bounds
    if key not in _kept:
        _kept[key] = make(spec, *bounds)
    return _kept[key]


def _encode(spec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = kept(ByteBpe, spec.value)
    for batch in batches:
        ids = [model.encode(t or "") for t in batch["text"].to_pylist()]
        decoded = [model.decode(x) for x in ids]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])


def bpe_round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded text for each row of docs (doc_id, text).

    Null and empty texts have no ids and decode to "". Special tokens' strings in a text become
    their ids, as the tokenizers library does by default. tokenizer_path is read on the driver;
    the file, of bounded size (1.6 MB), is broadcast.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    (kind,) = [t for c, t in docs.dtypes if c == "doc_id"]
    return docs.select("doc_id", "text").mapInArrow(partial(_encode, spec), f"doc_id {kind}, ids binary, decoded string")


def bpe_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The round trip as digests, made beside the texts so that neither ids nor texts leave Python."""
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    (kind,) = [t for c, t in docs.dtypes if c == "doc_id"]
    return docs.select("doc_id", "text").mapInArrow(partial(_digest, spec), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _digest(spec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _encode(spec, batches):
        ids, texts = batch["ids"].to_pylist(), batch["decoded"].to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )
