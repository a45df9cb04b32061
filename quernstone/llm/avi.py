"""Motion-JPEG in AVI as a media column (operator 2).

The container is RIFF with an ``idx1`` index. Frames are intra-only JPEG: lossless process 14 (SOF3) with predictor 1
is written and read; its Huffman table gives a difference of category s a code of 9 - s bits, so that each sample takes
nine bits and whole frames are packed and unpacked as arrays. Other tables are read bit by bit, and baseline frames as
``jpeg`` does. Files of several RIFF segments are read whole. Shots are cut where the
histogram distance between neighbouring frames stands out from those before it in the same shot.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.common import small_batches, table, text_or_empty, trimmed
from quernstone.llm.jpeg import luma as jpeg_luma

WIDTH, HEIGHT, FPS = 64, 16, 25
UNIT = 64
#: A cut: the distance exceeds FLOOR and the mean of the last WINDOW distances of the shot plus DEVIATIONS of theirs.
FLOOR, WINDOW, DEVIATIONS, BINS = 0.25, 8, 2.0, 16

_CATEGORY = np.array([int(abs(d)).bit_length() for d in range(-255, 256)])
_VALUE = np.array([(((1 << (9 - s)) - 2) << s) | ((d if d > 0 else d + (1 << s) - 1) if s else 0) for d, s in zip(range(-255, 256), _CATEGORY)])
_BITS = ((_VALUE[:, None] >> np.arange(8, -1, -1)) & 1).astype(np.uint8)
_POWERS = (1 << np.arange(8, -1, -1)).astype(np.uint16)
_DHT = b"\xff\xc4" + struct.pack(">HB", 2 + 17 + 9, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))


@lru_cache(maxsize=4096)
def _head(h: int, w: int) -> bytes:
    sof = b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\x00"
    return b"\xff\xd8" + _DHT + sof + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00\x01\x00\x00"


def encode_frames(payload: bytes, width: int = WIDTH, height: int = HEIGHT) -> list[bytes]:
    """The payload (a positive multiple of ``width`` bytes) as lossless JPEG frames; the last may have fewer rows.

    ``width`` is a multiple of 8, so that rows end at bytes and no bits need filling.
    """
    if width % 8 or not payload or len(payload) % width:
        raise ValueError("payloads are rows of a multiple of 8 bytes")
    x = np.frombuffer(payload, np.uint8).reshape(-1, width).astype(np.int16)
    d = np.empty_like(x)
    d[:, 1:] = x[:, 1:] - x[:, :-1]
    d[1:, 0] = x[1:, 0] - x[:-1, 0]
    d[::height, 0] = x[::height, 0] - 128
    packed = np.packbits(_BITS[d.ravel() + 255].ravel()).tobytes()
    step, rows = width * height * 9 // 8, len(x)
    return [_head(min(height, rows - k * height), width) + packed[i : i + step].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for k, i in enumerate(range(0, len(packed), step))]


def write_avi(frames: list[bytes], width: int = WIDTH, height: int = HEIGHT, fps: int = FPS) -> bytes:
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(chunk(b"00dc", f))
        at += len(movi[-1])
    body = b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The video frames by the index (by a walk over ``movi`` where there is none), and frames per second.

    Further RIFF segments (AVIX) follow the first; their frames are found by a walk.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, end, index, at, more = float(FPS), None, 0, b"", 12, []
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            if (k := data.find(b"strh", at, at + 8 + size)) >= 0:
                scale, rate = struct.unpack_from("<II", data, k + 8 + 20)
                fps = rate / scale if scale else fps
        elif kind == b"RIFF" and data[at + 8 : at + 12] == b"AVIX":
            at += 12
            continue
        elif kind == b"LIST" and data[at + 8 : at + 12] == b"movi":
            if movi is None:
                movi, end = at + 8, at + 8 + size
            else:
                more.append((at + 8, at + 8 + size))
        elif kind == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    if index:
        rows = [r for r in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if r[0][2:] in (b"dc", b"db")]
        base = movi if rows and data[movi + rows[0][2] : movi + rows[0][2] + 4] == rows[0][0] else 0
        frames = [data[base + o + 8 : base + o + 8 + n] for _, _, o, n in rows]
    else:
        frames = _walked(data, movi, end)
    return [*frames, *(f for a, b in more for f in _walked(data, a, b))], fps


def _walked(data: bytes, movi: int, end: int) -> list[bytes]:
    """The video frames of a ``movi`` list, those within record lists too."""
    frames, at = [], movi + 4
    while at + 8 <= min(end, len(data)):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"LIST":
            at += 12
            continue
        if data[at + 2 : at + 4] in (b"dc", b"db"):
            frames.append(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return frames


@lru_cache(maxsize=4096)
def _plan(head: bytes) -> tuple[int, int, np.ndarray | None, dict]:
    """Height, width, the differences by nine bits (None: codes vary) and the codes, from the markers before the scan."""
    at, h, w, codes = 2, 0, 0, {}
    while at < len(head):
        kind, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        if kind == 0xC3:
            if head[at + 4] != 8 or head[at + 9] != 1:
                raise ValueError("one component of 8 bits is read")
            h, w = struct.unpack_from(">HH", head, at + 5)
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("lossless and baseline frames are read")
        elif kind == 0xC4:
            counts, values, code, k = head[at + 5 : at + 21], head[at + 21 : at + 2 + n], 0, 0
            for length, m in enumerate(counts, 1):
                for _ in range(m):
                    codes[length, code] = values[k]
                    code, k = code + 1, k + 1
                code <<= 1
        at += 2 + n
    table9 = None
    if codes and all(length + s == 9 for (length, _), s in codes.items()):
        table9 = np.zeros(512, np.int16)
        for (_, code), s in codes.items():
            for extra in range(1 << s):
                table9[(code << s) | extra] = (extra if not s or extra >> (s - 1) else extra - (1 << s) + 1) if s else 0
    return h, w, table9, codes


def _slow(bits: np.ndarray, n: int, codes: dict) -> np.ndarray:
    out, at = np.empty(n, np.int32), 0
    for i in range(n):
        code = length = 0
        while True:
            code, length, at = code << 1 | int(bits[at]), length + 1, at + 1
            if (length, code) in codes:
                break
            if length > 16:
                raise ValueError("no such code")
        s, extra = codes[length, code], 0
        for _ in range(s):
            extra, at = extra << 1 | int(bits[at]), at + 1
        out[i] = (extra if extra >> (s - 1) else extra - (1 << s) + 1) if s else 0
    return out


def _frame_kind(jpeg: bytes) -> int | None:
    """The marker of the frame header; None if the scan or the end comes first."""
    at = 2
    while at + 4 <= len(jpeg) and (kind := jpeg[at + 1]) != 0xDA:
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return kind
        at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    return None


def decode_frame(jpeg: bytes) -> np.ndarray:
    """The samples of one frame, height by width; of a baseline frame those of its first component."""
    if _frame_kind(jpeg) in (0xC0, 0xC1):
        return jpeg_luma(jpeg)
    scan = jpeg.index(b"\xff\xda")
    start = scan + 2 + struct.unpack_from(">H", jpeg, scan + 2)[0]
    h, w, table9, codes = _plan(jpeg[:scan])
    bits = np.unpackbits(np.frombuffer(jpeg[start : jpeg.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff"), np.uint8))
    d = (table9[bits[: h * w * 9].reshape(-1, 9) @ _POWERS] if table9 is not None else _slow(bits, h * w, codes)).reshape(h, w).astype(np.int32)
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    return (np.cumsum(d, axis=1) & 0xFFFF).astype(np.uint8)


def clips(frames: list[np.ndarray], fps: float = FPS) -> list[tuple[int, int, float, float]]:
    """(first frame, last frame, start and end in seconds) of each shot."""
    hist = np.array([np.bincount(f.ravel() >> 4, minlength=BINS) / f.size for f in frames])
    far = np.abs(np.diff(hist, axis=0)).sum(axis=1).round(9).tolist()
    cuts, seen = [0], []
    for k, x in enumerate(far, 1):
        last = seen[-WINDOW:]
        mean = sum(last) / len(last) if last else 0.0
        spread = (sum((y - mean) ** 2 for y in last) / len(last)) ** 0.5 if last else 0.0
        if x > FLOOR and (not last or x > mean + DEVIATIONS * spread):
            cuts.append(k)
            seen = []
        else:
            seen.append(x)
    ends = [*cuts[1:], len(frames)]
    return [(a, b - 1, a / fps, b / fps) for a, b in zip(cuts, ends)]


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = [x.as_py().encode() for x in part["text"]]
            media = pa.array([write_avi(encode_frames(payload_of(t))) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(map(len, texts), pa.int64()), media], names=["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as an AVI file of its UTF-8 bytes, padded to a positive multiple of 64.

    A null text is an empty one; every row gives a row, repeated ones and null doc_ids too; an empty table an empty one.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(trimmed(_encode), "doc_id long, n_bytes long, media binary")


def _clip_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for d, m in zip(batch["doc_id"].to_pylist(), batch["media"]):
            if (data := m.as_py()) is not None:
                frames, fps = read_avi(data)
                out += [(d, k, *c) for k, c in enumerate(clips([decode_frame(f) for f in frames], fps) if frames else [])]
        names = ["doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)


def clip_table(media: DataFrame) -> DataFrame:
    """One timed row per clip of each ``media`` value; null media and files without frames give none."""
    small_batches(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(trimmed(_clip_rows), "doc_id long, clip int, first_frame int, last_frame int, start_s double, end_s double")


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, n_clips int"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for d, n, m in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"]):
            data = m.as_py()
            frames, fps = read_avi(data)
            samples = [decode_frame(f) for f in frames]
            payload = b"".join(f.tobytes() for f in samples)
            shots = clips(samples, fps)
            feature = f"{len(frames)} frames; clips from " + ",".join(f"{c[2]:.2f}" for c in shots)
            out.append((d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(frames), len(shots)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in _DIGEST.split(", ")])


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(table(spark, sf_dir, "documents")).mapInArrow(trimmed(_digest), _DIGEST)
