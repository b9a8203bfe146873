"""Operator 5, media columns: AVI files of lossless motion JPEG, their frames and shots.

A payload is kept as 8-bit grey samples, 16 x 12 to a frame. Frames are intra frames of lossless
JPEG (predictor 1, Huffman-coded differences), a chunk each of an AVI file with a RIFF index.
Reading parses the index, decodes the frames, and detects shots: a frame starts a shot if its
histogram differs from the one before by more than a multiple of the recent differences.

Frames are coded and decoded in step, one sample of thousands of frames at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .sequences import pieces, text_buffers
from .shared import small_batches

WIDTH, HEIGHT, RATE = 16, 12, 25
FRAME = WIDTH * HEIGHT
#: Shots: histogram bins, differences that a threshold follows, its factor and least value.
BINS, RECENT, FACTOR, FLOOR = 16, 12, 1.6, 60
_BLOCK = 1 << 20


def huffman_lengths() -> tuple[bytes, bytes]:
    """The table as DHT stores it: codes of each length 1 to 16, and their symbols. Nine codes of four bits."""
    return bytes([0, 0, 0, 9] + [0] * 12), bytes(range(9))


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, length, code) of a canonical table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], length, code))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def jpeg_header(width: int = WIDTH, height: int = HEIGHT) -> bytes:
    """Everything before the coded data: SOI, DHT, SOF3, SOS."""
    counts, symbols = huffman_lengths()
    table = b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols), 0) + counts + symbols
    frame = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, height, width, 1, 1, 0x11, 0)
    scan = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
    return b"\xff\xd8" + table + frame + scan


def _differences(frames: np.ndarray) -> np.ndarray:
    """Frames (n, height, width) less their predictions: left, above in the first column, 128 at first."""
    x = frames.astype(np.int16)
    out = x.copy()
    out[:, :, 1:] -= x[:, :, :-1]
    out[:, 1:, 0] -= x[:, :-1, 0]
    out[:, 0, 0] -= 128
    return out.reshape(len(x), -1)


def encode_frames(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded data of frames (n, height, width), one after another, and their n + 1 bounds."""
    n = len(frames)
    d = _differences(frames).astype(np.int32)
    size = d.shape[1]
    category = _BIT_LENGTH[np.abs(d)]
    bits = _CODE[category].astype(np.uint64) << category.astype(np.uint64) | np.where(d < 0, d + (1 << category) - 1, d).astype(np.uint64)
    length = _CODE_LENGTH[category] + category
    # four symbols, of at most 12 bits each, to a word
    word, many = np.zeros((n, size // 4), np.uint64), np.zeros((n, size // 4), np.int64)
    for k in range(4):
        part = length[:, k::4]
        word = word << part.astype(np.uint64) | bits[:, k::4]
        many += part
    ends = np.cumsum(many, axis=1)
    total = ends[:, -1] if size else np.zeros(n, np.int64)
    whole = (total + 7) >> 3
    bounds = np.concatenate([[0], np.cumsum(whole)])
    at = (bounds[:-1, None] << 3) + ends - many
    out = np.zeros(int(bounds[-1]) + 8, np.uint8)
    lead = at & 7
    aligned = (word << (64 - many - lead).astype(np.uint64)).astype(">u8").view(np.uint8).reshape(n, size // 4, 8)
    first, covered = at >> 3, (lead + many + 7) >> 3
    for half in (0, 1):  # words of one half never share a byte
        f, c, v = first[:, half::2], covered[:, half::2], aligned[:, half::2]
        for k in range(7):
            use = c > k
            out[f[use] + k] |= v[..., k][use]
    spare = (whole << 3) - total
    out[bounds[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)  # the last byte is filled with ones
    return _stuffed(out[: int(bounds[-1])], bounds)


def _stuffed(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A zero byte after each 0xFF."""
    marks = data == 255
    before = np.concatenate([[0], np.cumsum(marks)])
    out = np.zeros(len(data) + int(before[-1]), np.uint8)
    out[np.arange(len(data)) + before[:-1]] = data
    return out, bounds + before[bounds]


def _unstuffed(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    drop = np.zeros(len(data), bool)
    drop[1:] = (data[1:] == 0) & (data[:-1] == 255)
    drop[bounds[:-1][bounds[:-1] < len(data)]] = False
    gone = np.concatenate([[0], np.cumsum(drop)])
    return data[~drop], bounds - gone[bounds]


_BIT_LENGTH = np.array([int(v).bit_length() for v in range(512)], np.int32)
_CODE, _CODE_LENGTH = np.zeros(9, np.int64), np.zeros(9, np.int32)
for _symbol, _length, _code in _codes(*huffman_lengths()):
    _CODE[_symbol], _CODE_LENGTH[_symbol] = _code, _length


def parse_jpeg(data: bytes) -> tuple[int, int, int, bytes, bytes]:
    """(header bytes, width, height, code counts, symbols) of a lossless grey frame."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, shape, table = 2, None, None
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xC4:
            table = body[1:17], body[17 : 17 + sum(body[1:17])]
        elif marker == 0xC3:
            depth, height, width, parts = struct.unpack_from(">BHHB", body)
            if depth != 8 or parts != 1:
                raise ValueError("only 8-bit grey frames")
            shape = width, height
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only lossless Huffman-coded frames")
        at += 2 + size
        if marker == 0xDA:
            if body[3] != 1:
                raise ValueError("only predictor 1")
            return at, *shape, *table


def decode_frames(data: np.ndarray, bounds: np.ndarray, width: int, height: int, counts: bytes, symbols: bytes) -> np.ndarray:
    """Frames (n, height, width) from coded data at the given bounds, all frames in step."""
    category, length = np.zeros(1 << 16, np.uint64), np.ones(1 << 16, np.uint64)
    for symbol, n, code in _codes(counts, symbols):
        category[code << (16 - n) : (code + 1) << (16 - n)] = symbol
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    data, bounds = _unstuffed(data, bounds)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = padded[:-4] << np.uint64(32) | padded[1:-3] << np.uint64(24) | padded[2:-2] << np.uint64(16) | padded[3:-1] << np.uint64(8) | padded[4:]
    n, one = len(bounds) - 1, np.uint64(1)
    at = bounds[:-1].astype(np.uint64) << np.uint64(3)
    out = np.empty((width * height, n), np.int16)
    for k in range(width * height):
        view = word[(at >> np.uint64(3)).astype(np.int64)] << (at & np.uint64(7)) & np.uint64(0xFFFFFFFFFF)  # 40 bits, the symbol at the top
        code = (view >> np.uint64(24)).astype(np.int64)
        s, used = category[code], length[code]
        extra = (view << used & np.uint64(0xFFFFFFFFFF)) >> (np.uint64(40) - s)
        low = np.where(s > 0, one << (np.maximum(s, one) - one), np.uint64(0))
        out[k] = extra.astype(np.int64) - np.where(extra < low, (one << s) - one, np.uint64(0)).astype(np.int64)
        at += used + s
    x = out.T.reshape(n, height, width)
    x[:, 0, 0] += 128
    x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1)
    return (np.cumsum(x, axis=2) & 255).astype(np.uint8)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi_head(frames: int, largest: int) -> bytes:
    """The hdrl list."""
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, frames, 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, RATE, 0, frames, largest, -1, 0, 0, 0, WIDTH, HEIGHT)
    picture = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    streams = b"LIST" + struct.pack("<I", 4 + 8 + len(stream) + 8 + len(picture)) + b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)
    inner = b"hdrl" + _chunk(b"avih", main) + streams
    return b"LIST" + struct.pack("<I", len(inner)) + inner


def write_avi(payload: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """An AVI file for each slice of payload; slices are multiples of FRAME."""
    coded, at = encode_frames(payload.reshape(-1, HEIGHT, WIDTH))
    header = np.frombuffer(jpeg_header(), np.uint8)
    size = np.diff(at) + len(header) + 2
    room = 8 + size + (size & 1)
    place = np.concatenate([[0], np.cumsum(room)])
    movie = np.zeros(int(place[-1]), np.uint8)
    movie[place[:-1, None] + np.arange(4)] = np.frombuffer(b"00dc", np.uint8)
    movie[place[:-1, None] + np.arange(4, 8)] = size.astype("<u4").view(np.uint8).reshape(-1, 4)
    movie[place[:-1, None] + np.arange(8, 8 + len(header))] = header
    movie[np.arange(len(coded)) + np.repeat(place[:-1] + 8 + len(header) - at[:-1], np.diff(at))] = coded
    movie[place[:-1] + 8 + size - 2], movie[place[:-1] + 8 + size - 1] = 0xFF, 0xD9
    out = []
    for a, b in zip((bounds[:-1] // FRAME).tolist(), (bounds[1:] // FRAME).tolist()):
        index = np.zeros((b - a, 4), "<u4")
        index[:, 0] = int.from_bytes(b"00dc", "little")
        index[:, 1] = 0x10  # every frame is a key frame
        index[:, 2] = place[a:b] - place[a] + 4
        index[:, 3] = size[a:b]
        body = b"movi" + movie[place[a] : place[b]].tobytes()
        inside = b"AVI " + avi_head(b - a, int(size[a:b].max(initial=0))) + b"LIST" + struct.pack("<I", len(body)) + body + _chunk(b"idx1", index.tobytes())
        out.append(b"RIFF" + struct.pack("<I", len(inside)) + inside)
    return out


def frame_index(media: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes of the video frames, from the RIFF index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movie, index = 12, None, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movie = at + 8
        elif kind == b"idx1":
            index = np.frombuffer(media, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movie is None or index is None:
        raise ValueError("an AVI file without frames or index")
    rows = index[(index[:, 0] >> 16) == int.from_bytes(b"dc", "little")].astype(np.int64)
    return movie + rows[:, 2] + 8, rows[:, 3]


def read_avi(files: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All files' frames (n, height, width), and for each file its first frame."""
    starts, sizes, many, base = [], [], [], 0
    for media in files:
        offset, size = frame_index(media)
        starts.append(offset + base)
        sizes.append(size)
        many.append(len(size))
        base += len(media)
    first = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
    if not first[-1]:
        return np.zeros((0, HEIGHT, WIDTH), np.uint8), first
    data = np.frombuffer(b"".join(files), np.uint8)
    start, size = np.concatenate(starts), np.concatenate(sizes)
    header = bytes(data[start[0] : start[0] + size[0]])
    skip, width, height, counts, symbols = parse_jpeg(header)
    if not (data[start[:, None] + np.arange(skip)] == np.frombuffer(header[:skip], np.uint8)).all():
        raise ValueError("frames of different shapes or tables")
    length = size - skip - 2
    bounds = np.concatenate([[0], np.cumsum(length)])
    coded = data[np.arange(int(bounds[-1])) + np.repeat(start + skip - bounds[:-1], length)]
    return decode_frames(coded, bounds, width, height, counts, symbols), first


def shots(frames: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each frame starts a shot; files' first frames do."""
    n = len(frames)
    file = np.repeat(np.arange(len(first) - 1), np.diff(first))
    flat = frames.reshape(n, -1)
    levels = np.bincount((np.arange(n)[:, None] * BINS + (flat >> 4)).reshape(-1), minlength=n * BINS).reshape(n, BINS)
    change = np.zeros(n)
    change[1:] = np.abs(np.diff(levels, axis=0)).sum(1)
    change[first[:-1][first[:-1] < n]] = 0
    # the mean of the file's last RECENT differences before this frame
    total = np.concatenate([[0], np.cumsum(change)])
    low = np.maximum(np.arange(n) - RECENT, first[file] + 1 if n else 0)
    seen = np.arange(n) - low
    mean = np.where(seen > 0, (total[:-1] - total[np.minimum(low, n)]) / np.maximum(seen, 1), 0)
    out = (change > FLOOR) & (seen > 0) & (change > FACTOR * mean)
    out[first[:-1][first[:-1] < n]] = True
    return out


def clips(frames: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(file, first frame, last frame, mean level in 1/256) of each shot."""
    n = len(frames)
    if not n:
        return []
    at = np.flatnonzero(shots(frames, first))
    file = np.searchsorted(first, at, "right") - 1
    last = np.append(at[1:], n) - 1
    sums = np.concatenate([[0], np.cumsum(frames.reshape(n, -1).sum(1, dtype=np.int64))])
    level = (sums[last + 1] - sums[at]) * 256 // ((last + 1 - at) * frames[0].size)
    return list(zip(file.tolist(), (at - first[file]).tolist(), (last - first[file]).tolist(), level.tolist()))


def _payloads(batch: pa.RecordBatch):
    """(first row, payload, bounds, unpadded sizes), for about a megabyte at a time."""
    raw, offsets = text_buffers(batch["text"])
    for a, b in pieces(offsets, _BLOCK):
        size = np.diff(offsets[a : b + 1])
        padded = np.maximum(1, -(-size // FRAME)) * FRAME
        bounds = np.concatenate([[0], np.cumsum(padded)])
        payload = np.full(int(bounds[-1]), 32, np.uint8)
        payload[np.arange(int(size.sum())) + np.repeat(bounds[:-1] - (offsets[a:b] - offsets[a]), size)] = raw[offsets[a] : offsets[b]]
        yield a, payload, bounds, size


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, payload, bounds, size in _payloads(batch):
            files = write_avi(payload, bounds)
            frames, first = read_avi(files)
            back = frames.tobytes()
            features: list[list[str]] = [[] for _ in files]
            for file, start, stop, level in clips(frames, first):
                features[file].append(f"{start}-{stop}:{level}")
            kept = [back[i:j] for i, j in zip((first[:-1] * FRAME).tolist(), (first[1:] * FRAME).tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(a, len(size)), pa.array(size), pa.array([len(k) for k in kept], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([zlib.crc32(k[-16:]) for k in kept], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array([f"{len(f)} clips " + " ".join(f) for f in features]),
                ],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )


def media_digest(docs: DataFrame) -> DataFrame:
    """Each text written to an AVI file and read back: its digests, and its clips as `feature`.

    feature: the number of clips, then first frame-last frame:mean level (in 1/256) of each. Null
    and empty texts are one frame of blanks. The files stay in Python; `avi_files` returns them.
    """
    small_batches(docs.sparkSession)
    (kind,) = [t for c, t in docs.dtypes if c == "doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_digest, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, payload, bounds, size in _payloads(batch):
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, len(size)), pa.array(write_avi(payload, bounds), pa.binary())], ["doc_id", "media"])


def avi_files(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text of docs (doc_id, text) as an AVI file."""
    small_batches(docs.sparkSession)
    (kind,) = [t for c, t in docs.dtypes if c == "doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_files, f"doc_id {kind}, media binary")


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, media in enumerate(batch["media"].to_pylist()):
            if media:
                rows.extend((i, k, start, stop, level) for k, (_, start, stop, level) in enumerate(clips(*read_avi([media]))))
        column = [np.array(c) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 5
        yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(column[0], pa.int64())), pa.array(column[1], pa.int32()), pa.array(column[2] / RATE, pa.float64()), pa.array((column[3] + 1) / RATE, pa.float64()), pa.array(column[4] / 256, pa.float64())], ["doc_id", "clip", "start_s", "end_s", "level"])


def avi_clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, start_s, end_s, level: timed clip rows of AVI files (doc_id, media); null and empty media have none."""
    small_batches(media.sparkSession)
    (kind,) = [t for c, t in media.dtypes if c == "doc_id"]
    return media.select("doc_id", "media").mapInArrow(_clips, f"doc_id {kind}, clip int, start_s double, end_s double, level double")
