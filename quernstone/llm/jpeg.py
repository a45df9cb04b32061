"""Baseline JPEG frames (SOF0, SOF1 of 8 bits) to their luma samples.

Huffman decoding walks the scan bit by bit in Python; dequantising and the inverse cosine transform run over all blocks
at once. Restart intervals and any sampling factors are read; chroma blocks are passed over, as shots are detected on luma.
Frames without Huffman tables of their own, progressive and arithmetic ones raise ValueError.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

_K = np.arange(8)
_COSINE = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)[:, None]
#: Place of the k-th coefficient of the zigzag order: diagonals in turn, every other one upwards.
_ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


@lru_cache(maxsize=256)
def _lookup(counts: bytes, values: bytes) -> tuple[list[int], list[int]]:
    """Symbol and length of the code that each run of 16 bits starts with; length 0 where there is none."""
    symbol, length, code, k = [0] * 65536, [0] * 65536, 0, 0
    for n, m in enumerate(counts, 1):
        for _ in range(m):
            first, span = code << (16 - n), 1 << (16 - n)
            symbol[first : first + span], length[first : first + span] = [values[k]] * span, [n] * span
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data + b"\xff\xff\xff", "big"), 8 * len(data) + 24

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        if self.left < 16:
            raise ValueError("a scan that ends early")
        at = self.value >> (self.left - 16) & 0xFFFF
        if not (n := table[1][at]):
            raise ValueError("no such code")
        self.left -= n
        return table[0][at]

    def number(self, n: int) -> int:
        """``n`` bits as a signed number, whose first bit says that it is positive."""
        self.left -= n
        x = self.value >> self.left & ((1 << n) - 1)
        return x if x >> (n - 1) else x - (1 << n) + 1

    def trim(self) -> None:
        self.value &= (1 << self.left) - 1


def _block(bits: _Bits, dc, ac, before: int, out: list[int] | None) -> int:
    n = bits.symbol(dc)
    before += bits.number(n) if n else 0
    if out is not None:
        out[0] = before
    k = 1
    while k < 64:
        s = bits.symbol(ac)
        run, n = s >> 4, s & 15
        if not n:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("a block of more than 64 coefficients")
        x = bits.number(n)
        if out is not None:
            out[k] = x
        k += 1
    bits.trim()
    return before


def luma(jpeg: bytes) -> np.ndarray:
    """The first component's samples, height by width."""
    at, tables, quant, parts, every, size = 2, {}, {}, [], 0, (0, 0)
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError("no marker where one should be")
        kind, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(float)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                m = sum(body[1:17])
                tables[body[0]] = _lookup(bytes(body[1:17]), bytes(body[17 : 17 + m]))
                body = body[17 + m :]
        elif kind in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples of 8 bits are read")
            size = struct.unpack_from(">HH", body, 1)
            parts = [{"id": c, "h": f >> 4, "v": f & 15, "q": q} for c, f, q in struct.iter_unpack("3B", body[6 : 6 + 3 * body[5]])]
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("baseline frames are read")
        elif kind == 0xDD:
            every = struct.unpack_from(">H", body)[0]
        elif kind == 0xDA:
            order = [(next(p for p in parts if p["id"] == c), t) for c, t in struct.iter_unpack("2B", body[1 : 1 + 2 * body[0]])]
            return _scan(jpeg[at : jpeg.rindex(b"\xff\xd9")], order, tables, quant, every, *size)
    raise ValueError("a frame without a scan")


def _scan(data: bytes, order: list, tables: dict, quant: dict, every: int, height: int, width: int) -> np.ndarray:
    if not tables or any(t >> 4 not in tables or 16 + (t & 15) not in tables for _, t in order):
        raise ValueError("a frame without its Huffman tables")
    first = order[0][0]
    most_h, most_v = (max(p[k] for p, _ in order) for k in "hv")
    alone = len(order) == 1
    per_h, per_v = (1, 1) if alone else (first["h"], first["v"])
    across, down = (-(-width // 8), -(-height // 8)) if alone else (-(-width // (8 * most_h)), -(-height // (8 * most_v)))
    blocks = np.zeros((down * per_v, across * per_h, 64))
    intervals = [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", data)]
    mcu, total = 0, across * down
    for part in intervals:
        bits, before = _Bits(part), dict.fromkeys(range(len(order)), 0)
        for mcu in range(mcu, min(total, mcu + every) if every else total):
            row, column = divmod(mcu, across)
            for c, (p, t) in enumerate(order):
                for y in range(1 if alone else p["v"]):
                    for x in range(1 if alone else p["h"]):
                        out = [0] * 64 if not c else None
                        before[c] = _block(bits, tables[t >> 4], tables[16 + (t & 15)], before[c], out)
                        if out is not None:
                            blocks[row * per_v + y, column * per_h + x] = out
        mcu += 1
        if mcu >= total:
            break
    square = np.zeros_like(blocks)
    square[..., _ZIGZAG] = blocks * quant[first["q"]]
    square = square.reshape(*blocks.shape[:2], 8, 8)
    samples = _COSINE.T @ square @ _COSINE + 128
    image = np.clip(np.rint(samples), 0, 255).astype(np.uint8).swapaxes(1, 2).reshape(8 * blocks.shape[0], 8 * blocks.shape[1])
    # a first component of fewer samples than the others covers less of the grid
    return image[: -(-height * first["v"] // most_v), : -(-width * first["h"] // most_h)]
