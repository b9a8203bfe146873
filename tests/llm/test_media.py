"""AVI files: exact round trips, RIFF structure, shots."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import media


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=media.FRAME, max_size=media.FRAME), min_size=1, max_size=4))
def test_frames_round_trip(frames):
    x = np.frombuffer(b"".join(frames), np.uint8).reshape(-1, media.HEIGHT, media.WIDTH)
    coded, bounds = media.encode_frames(x)
    assert (media.decode_frames(coded, bounds, media.WIDTH, media.HEIGHT, *media.huffman_lengths()) == x).all()


def test_extreme_frames():
    x = np.stack([np.zeros((12, 16)), np.full((12, 16), 255), np.indices((12, 16)).sum(0) % 2 * 255]).astype(np.uint8)
    coded, bounds = media.encode_frames(x)
    assert (media.decode_frames(coded, bounds, 16, 12, *media.huffman_lengths()) == x).all()


def test_another_huffman_table():
    """The decoder follows the stored table: code lengths of its own."""
    counts, symbols = bytes([0, 1, 3, 3, 2] + [0] * 11), bytes([5, 4, 6, 3, 7, 2, 1, 0, 8])
    codes = {s: (n, c) for s, n, c in media._codes(counts, symbols)}
    x = np.arange(192, dtype=np.uint8).reshape(1, 12, 16) * 3
    bits = ""
    for d in media._differences(x)[0].tolist():
        s = abs(d).bit_length()
        n, c = codes[s]
        bits += format(c, f"0{n}b") + (format(d if d >= 0 else d + (1 << s) - 1, f"0{s}b") if s else "")
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    assert (media.decode_frames(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 16, 12, counts, symbols) == x).all()


def test_riff_structure():
    (file,) = media.write_avi(np.full(3 * media.FRAME, 65, np.uint8), np.array([0, 3 * media.FRAME]))
    assert file[:4] == b"RIFF" and struct.unpack_from("<I", file, 4)[0] == len(file) - 8 and b"MJPG" in file
    at, size = media.frame_index(file)
    assert len(at) == 3 and all(file[a : a + 2] == b"\xff\xd8" and file[a + n - 2 : a + n] == b"\xff\xd9" and file[a - 8 : a - 4] == b"00dc" for a, n in zip(at, size))
    for broken in (b"", b"RIFF", b"RIFF\4\0\0\0AVI "):
        with pytest.raises(ValueError, match="AVI"):
            media.frame_index(broken)


def test_shots_follow_histograms():
    frames = np.concatenate([np.full((20, 12, 16), 30), np.full((10, 12, 16), 200)]).astype(np.uint8)
    assert [c[:3] for c in media.clips(frames, np.array([0, 30]))] == [(0, 0, 19), (0, 20, 29)]


def plain_feature(text):
    """Shots frame by frame: a frame starts one if its histogram differs by more than FACTOR times the mean of the last differences."""
    data = (text or "").encode()
    data += b" " * (-len(data) % media.FRAME if data else media.FRAME)
    frames = [data[i : i + media.FRAME] for i in range(0, len(data), media.FRAME)]
    levels = [[sum(b >> 4 == level for b in f) for level in range(16)] for f in frames]
    change = [0] + [sum(abs(x - y) for x, y in zip(a, b)) for a, b in zip(levels, levels[1:])]
    cuts = [0]
    for i in range(1, len(frames)):
        before = change[max(1, i - media.RECENT) : i]
        if before and change[i] > media.FLOOR and change[i] > media.FACTOR * sum(before) / len(before):
            cuts.append(i)
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(frames)]):
        out.append(f"{a}-{b - 1}:{sum(map(sum, frames[a:b])) * 256 // ((b - a) * media.FRAME)}")
    return f"{len(out)} clips " + " ".join(out)


def test_features_match_plain_shots(spark, documents, texts):
    odd = {-1: "a" * 1000 + "\U0001f600" * 300 + "zz" * 900 + "0" * 500, -2: None, -3: "é" * 96}
    extra = spark.createDataFrame(list(odd.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.feature for r in media.media_digest(documents.select("doc_id", "text").unionByName(extra)).collect()}
    want = {d: plain_feature(t) for d, t in {**texts, **odd}.items()}
    assert got == want and any(not f.startswith("1 ") for f in want.values())


def expected(text):
    data = (text or "").encode()
    payload = data + b" " * (-len(data) % 192) if data else b" " * 192
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def test_documents(documents, texts, hostile, nothing):
    rows = media.media_digest(documents).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == {d: expected(t) for d, t in texts.items()}
    odd = media.media_digest(hostile).collect()
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in odd) == sorted(expected(r.text) for r in hostile.collect())
    assert len({r[1:] for r in odd if r.doc_id in (1, 2)}) == 1  # equal texts, equal values
    assert media.media_digest(nothing).count() == 0


def test_clip_rows(documents):
    files = media.avi_files(documents.limit(20))
    clips = media.avi_clips(files.unionAll(files.sparkSession.createDataFrame([(None, None), (5, b"")], files.schema))).collect()
    assert len({r.doc_id for r in clips}) == 20 and all(r.end_s > r.start_s for r in clips) and all(r.start_s == 0 for r in clips if r.clip == 0)
