import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import media


@given(st.binary(max_size=20_000))
@settings(max_examples=60, deadline=None)
def test_round_trip(data):
    whole = media.padded(data)
    assert len(whole) % 576 == 0 and len(whole) > 0 and whole.startswith(data) and set(whole[len(data) :]) <= {255}
    made = media.wrap(whole)
    info = media.parse(made)
    assert media.payload_of(made, info) == whole
    assert info["codec"] == "raw " and info["ticks"] == len(whole) // 576
    assert list(info["keys"]) == list(range(0, len(whole) // 576, 8))


def test_wide_and_open_boxes():
    """A 64-bit box size, a box that runs to the end, sizes of their own for each sample, several runs of chunks."""
    body = bytes(range(200))
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(body)) + body
    stbl = media.box(
        b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"mp4v", bytes(70))),
        media.full(b"stts", struct.pack(">IIIII", 2, 2, 10, 3, 20)),
        media.full(b"stsz", struct.pack(">II5I", 0, 5, 10, 20, 30, 40, 50)),
        media.full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 3, 1, 1)),
        media.full(b"co64", struct.pack(">I3Q", 3, 16, 46, 150)),
    )
    mdia = media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 80, 0, 0)), media.full(b"hdlr", bytes(4), b"vide", bytes(12)), media.box(b"minf", stbl))
    moov = media.box(b"moov", media.box(b"trak", mdia))
    raw = mdat + struct.pack(">I", 0) + moov[4:]
    info = media.parse(raw)
    assert list(info["starts"]) == [16, 26, 46, 76, 150] and info["ticks"] == 80 and list(info["keys"]) == [0, 1, 2, 3, 4]
    assert media.payload_of(raw, info) == b"".join(raw[a : a + n] for a, n in zip(info["starts"], info["sizes"], strict=True))
    for cut in (b"", raw[:100], raw[:-9], b"\x00\x00\x00\x02abcd"):
        with pytest.raises(ValueError):
            media.parse(cut)


def test_columns(spark, awkward):
    got = {(r.doc_id, r.n_bytes): r for r in media.text_as_media(awkward).collect()}
    assert media.text_as_media(awkward).count() == awkward.count()
    for r in awkward.collect():
        raw = (r.text or "").encode()
        want = media.padded(raw)
        x = got[(r.doc_id, len(raw))]
        assert (x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    assert media.text_as_media(awkward.limit(0)).count() == 0
    blobs = spark.createDataFrame([(1, bytearray(media.wrap(b"\x01" * 576 * 9))), (2, None), (3, bytearray(b"junk junk junk"))], "k bigint, m binary")
    rows = {r.id: r for r in media.media_columns(blobs, "k", "m").collect()}
    assert rows[1].seconds == 9 / 25 and [tuple(k) for k in rows[1].keyframes] == [(32, 608), (32 + 8 * 576, 32 + 9 * 576)]
    assert rows[2].codec is None and rows[2].error is None and rows[3].error
    assert np.isfinite(rows[1].seconds)


def track(kind=b"vide", stsz=None, stss=None, n=2, chunk=100):
    tables = [
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"mp4v", bytes(70))), media.full(b"stts", struct.pack(">III", 1, n, 10)), stsz or media.full(b"stsz", struct.pack(">II", 10, n)),
        media.full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)), media.full(b"stco", struct.pack(">II", 1, chunk)), *([stss] if stss else []),
    ]
    return media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 80, 0, 0)), media.full(b"hdlr", bytes(4), kind, bytes(12)), media.box(b"minf", media.box(b"stbl", *tables))))


def movie(*parts):
    return media.box(b"mdat", bytes(300)) + media.box(b"moov", *parts)


def test_malformed_tables_are_errors(spark):
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    bad = {
        "a keyframe beyond the track": movie(track(stss=media.full(b"stss", struct.pack(">II", 1, 3)))),
        "keyframe 0": movie(track(stss=media.full(b"stss", struct.pack(">II", 1, 0)))),
        "nested boxes": deep,
        "more samples than bytes": movie(track(stsz=media.full(b"stsz", struct.pack(">II", 7, (1 << 32) - 1)))),
        "a sample beyond the file": movie(track(chunk=1 << 30)),
        "odd sizes": movie(track(stsz=media.full(b"stz2", struct.pack(">II", 3, 2), bytes(4)))),
        "fragments": movie(track()) + media.box(b"moof", bytes(8)),
        "no tracks": movie(),
    }
    for name, raw in bad.items():
        with pytest.raises(ValueError):
            media.parse(raw)
            raise AssertionError(name)
    rows = media.media_columns(spark.createDataFrame([(k, bytearray(v)) for k, v in bad.items()], "k string, m binary"), "k", "m").collect()
    assert len(rows) == len(bad) and all(r.error and r.codec is None for r in rows)


def test_the_video_track_and_compact_sizes():
    raw = movie(track(b"soun"), track(b"vide", media.full(b"stz2", struct.pack(">II", 4, 3), bytes([0x21, 0x30])), n=3))
    info = media.parse(raw)
    assert info["track"] == "vide" and list(info["sizes"]) == [2, 1, 3] and list(info["starts"]) == [100, 102, 103]
    wide = media.parse(movie(track(stsz=media.full(b"stz2", struct.pack(">II", 16, 2), struct.pack(">HH", 5, 260)), chunk=8)))
    assert list(wide["sizes"]) == [5, 260]
