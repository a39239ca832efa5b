"""ISO media containers as columns: codec, duration and keyframe byte ranges, read from the sample tables alone.

The reader walks nested boxes (32-bit, 64-bit and to-the-end sizes), decodes the tables of the first track that has any,
and never touches the payload. The writer makes a one-track container whose samples are 24 x 24 frames of 8-bit grey, 576
bytes each, every eighth a keyframe.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.scratch import small_batches

FRAME = 576
SIDE = 24
RATE = 25
GROUP_OF_FRAMES = 8
CHUNK_FRAMES = 16
#: The box types that hold boxes.
#: Levels of boxes that are read.
DEPTH = 16
HOLDERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"dinf")


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)
    return struct.pack(">I4s", size, kind) + b"".join(parts)


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(payload: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of FRAME."""
    return payload + b"\xff" * (max(FRAME, -(-len(payload) // FRAME) * FRAME) - len(payload))


def wrap(payload: bytes) -> bytes:
    """A container whose samples are the payload's frames; its length is a positive multiple of FRAME."""
    n = len(payload) // FRAME
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    media = box(b"mdat", payload)
    first = len(head) + len(media) - len(payload)
    at = first + np.arange(0, n, CHUNK_FRAMES, dtype=np.int64) * FRAME
    wide = at[-1] >= 1 << 32
    offsets = full(b"co64" if wide else b"stco", struct.pack(">I", len(at)), at.astype(">u8" if wide else ">u4").tobytes())
    whole, rest = divmod(n, CHUNK_FRAMES)
    runs = ([(1, CHUNK_FRAMES, 1)] if whole else []) + ([(whole + 1, rest, 1)] if rest else [])
    keys = np.arange(1, n + 1, GROUP_OF_FRAMES)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, 1)),
        full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", FRAME, n)),
        offsets,
    )
    identity = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    handler = full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\x00")
    info = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
    track = box(
        b"trak",
        full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), identity, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7),
        box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), handler, info),
    )
    movie = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 1 << 16, 1 << 8), bytes(10), identity, bytes(24), struct.pack(">I", 2))
    return head + media + box(b"moov", movie, track)


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, body start and body end of the boxes in a range; a box that overruns it is an error."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} of {size} bytes overruns {end}")
        yield kind, body, start + size
        start += size


def _tables(data: memoryview, start: int, end: int, out: dict, depth: int = 0) -> dict:
    """Kind to body range of the boxes below, with a list of the tracks under `tracks`; fragments are an error."""
    if depth > DEPTH:
        raise ValueError(f"boxes are nested over {DEPTH} deep")
    for kind, a, b in walk(data, start, end):
        if kind == b"moof":
            raise ValueError("a fragmented file, whose samples are not in its movie box")
        if kind == b"trak":
            out.setdefault("tracks", []).append(_tables(data, a, b, {}, depth + 1))
        elif kind in HOLDERS:
            _tables(data, a, b, out, depth + 1)
        else:
            out.setdefault(kind, (a, b))
    return out


def _track(data: memoryview) -> dict:
    """The tables of the first video track with samples, or else of the first track with samples."""
    tracks = [t for t in _tables(data, 0, len(data), {}).get("tracks", []) if b"stsz" in t or b"stz2" in t]
    if not tracks:
        raise ValueError("no track with samples")
    seen = [t for t in tracks if b"hdlr" in t and bytes(data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]) == b"vide"]
    return (seen or tracks)[0]


def _sizes(data: memoryview, t: dict) -> np.ndarray:
    """Sizes of the samples, which together are no more than the file."""
    a, b = t[b"stsz"] if b"stsz" in t else t[b"stz2"]
    (n,) = struct.unpack_from(">I", data, a + 8)
    (first,) = struct.unpack_from(">I", data, a + 4)
    if b"stsz" in t:
        if first and n * first > len(data):
            raise ValueError("the samples are larger than the file")
        return np.full(n, first, np.int64) if first else _array(data, a + 12, ">u4", n, b)
    bits = first & 255
    if bits not in (4, 8, 16):
        raise ValueError(f"sample sizes of {bits} bits")
    if bits == 4:
        both = _array(data, a + 12, "u1", (n + 1) // 2, b)
        return np.column_stack([both >> 4, both & 15]).ravel()[:n]
    return _array(data, a + 12, f">u{bits // 8}", n, b)


def _array(data: memoryview, at: int, kind: str, n: int, end: int) -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > end:
        raise ValueError("a table overruns its box")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def parse(raw: bytes) -> dict:
    """codec, track, width, height, timescale, ticks, starts, sizes, keys (sample numbers from 0); ValueError if malformed."""
    data = memoryview(raw)
    try:
        t = _track(data)
        u32 = lambda at: struct.unpack_from(">I", data, at)[0]
        a, b = t[b"stsd"]
        codec, width, height = bytes(data[a + 12 : a + 16]).decode("latin-1"), *struct.unpack_from(">HH", data, a + 8 + 32)
        a, b = t[b"mdhd"]
        timescale = u32(a + (20 if data[a] else 12))
        sizes = _sizes(data, t)
        n = len(sizes)
        a, b = t[b"stts"]
        spans = _array(data, a + 8, ">u4", 2 * u32(a + 4), b).reshape(-1, 2)
        a, b = t.get(b"co64", t.get(b"stco", (0, 0)))
        chunks = _array(data, a + 8, ">u8" if b"co64" in t else ">u4", u32(a + 4), b)
        a, b = t[b"stsc"]
        runs = _array(data, a + 8, ">u4", 3 * u32(a + 4), b).reshape(-1, 3)
        spread = np.diff(np.append(runs[:, 0] - 1, len(chunks)))
        if (spread < 0).any() or (len(runs) and runs[0, 0] != 1) or (len(chunks) and not len(runs)):
            raise ValueError("runs of chunks are out of order")
        each = np.repeat(runs[:, 1], spread)
        if each.sum() != n:
            raise ValueError("the chunks do not hold all samples")
        before = np.cumsum(sizes) - sizes
        lead = np.repeat(before[np.cumsum(each) - each], each) if n else before
        starts = np.repeat(chunks, each) + before - lead
        if b"stss" in t:
            a, b = t[b"stss"]
            keys = _array(data, a + 8, ">u4", u32(a + 4), b) - 1
        else:
            keys = np.arange(n)
        if len(keys) and (keys.min() < 0 or keys.max() >= n):
            raise ValueError("a keyframe is no sample of the track")
        if n and (starts.min() < 0 or (starts + sizes).max() > len(raw)):
            raise ValueError("a sample lies outside the file")
        handler = bytes(data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]).decode("latin-1")
    except (struct.error, KeyError, IndexError, OverflowError) as e:
        raise ValueError(f"malformed container: {e!r}") from e
    return {"codec": codec, "track": handler, "width": width, "height": height, "timescale": timescale, "ticks": int((spans[:, 0] * spans[:, 1]).sum()), "starts": starts, "sizes": sizes, "keys": keys}


def payload_of(raw: bytes, info: dict) -> bytes:
    """The samples' bytes in order."""
    starts, sizes = info["starts"], info["sizes"]
    if not len(starts):
        return b""
    cut = np.flatnonzero(np.append(True, starts[1:] != starts[:-1] + sizes[:-1]))
    ends = np.append(cut[1:], len(starts)) - 1
    return b"".join(raw[starts[i] : starts[j] + sizes[j]] for i, j in zip(cut, ends, strict=True))


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for blob in batch.column(1):
            raw = blob.as_py()
            row = {"codec": None, "seconds": None, "width": None, "height": None, "samples": None, "keyframes": None, "error": None}
            if raw is not None:
                try:
                    x = parse(raw)
                    ranges = [{"start": int(x["starts"][k]), "end": int(x["starts"][k] + x["sizes"][k])} for k in x["keys"]]
                    row |= {"codec": x["codec"], "seconds": x["ticks"] / x["timescale"] if x["timescale"] else None, "width": x["width"], "height": x["height"], "samples": len(x["starts"]), "keyframes": ranges}
                except ValueError as e:
                    row["error"] = str(e)
            rows.append(row)
        schema = pa.schema([("codec", pa.string()), ("seconds", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("error", pa.string())])
        made = pa.RecordBatch.from_pylist(rows, schema)
        yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], ["id", *schema.names])


def media_columns(df: DataFrame, key: str, media: str) -> DataFrame:
    """id, codec, seconds, width, height, samples, keyframes (byte ranges, end exclusive), error; one row for each row.

    A null blob has nulls throughout; one that is no container has nulls and the reason in error. Other columns are not
    read; an empty table gives no rows.
    """
    schema = "id {}, codec string, seconds double, width int, height int, samples bigint, keyframes array<struct<start:bigint,end:bigint>>, error string"
    return small_batches(df).select(F.col(key).alias("id"), F.col(media).alias("media")).mapInArrow(_columns, schema.format(dict(df.dtypes)[key]))


def feature(info: dict) -> str:
    """What the container's tables say, as text."""
    at = ",".join(f"{s}-{e}" for s, e in zip(info["starts"][info["keys"]], (info["starts"] + info["sizes"])[info["keys"]], strict=True))
    return f"{info['codec'].strip()}/{info['track']} {info['width']}x{info['height']} {info['ticks']}/{info['timescale']}s samples={len(info['starts'])} keyframes={len(info['keys'])} ranges={at}"


def _round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for text in batch.column(1):
            own = text.as_buffer()
            raw = own.to_pybytes() if own is not None else b""
            media = wrap(padded(raw))
            info = parse(media)
            back = payload_of(media, info)
            values = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(info))
            for column, v in zip(out, values, strict=True):
                column.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def text_as_media(docs: DataFrame) -> DataFrame:
    """Stores each text as a container, reads it back and describes it; one row for each row of docs.

    Null and empty texts are one frame of bytes 255. Equal texts, and so rows that repeat, give equal values. Other columns
    are not read; an empty table gives no rows.
    """
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return small_batches(docs).select("doc_id", "text").mapInArrow(_round_trip, schema)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an ISO media container and back."""
    return text_as_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
