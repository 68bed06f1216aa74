"""Baseline JPEG: quantisation and Huffman tables, restart intervals and sampling factors as the file gives them."""

from __future__ import annotations

import struct
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: The zigzag order of JPEG coefficients.
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]

#: The Huffman tables of the JPEG standard (codes of each length, symbols), which motion JPEG frames may leave out.
#: Symbols of the second and fourth table that aren't named here follow in ascending order.
_DC_LUMA = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
_AC_LUMA = ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], list(bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282")))
_DC_CHROMA = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
_AC_CHROMA = ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], list(bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1")))
_AC_ALL = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]


def basis() -> np.ndarray:
    """64 x 64: from coefficients in zigzag order to samples."""
    k = np.arange(8)
    c = np.sqrt(np.where(k == 0, 1 / 8, 2 / 8))[:, None] * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = basis()


@lru_cache(maxsize=64)
def _lookup(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int] | None]:
    """(code length, symbol) by the next 16 bits."""
    out: list[tuple[int, int] | None] = [None] * 65536
    code = at = 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[code << (16 - n) : (code + 1) << (16 - n)] = [(n, symbols[at])] * (1 << (16 - n))
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Component(NamedTuple):
    number: int
    across: int
    down: int
    table: int


class Header(NamedTuple):
    height: int
    width: int
    components: list[_Component]
    quantisation: dict[int, np.ndarray]
    huffman: dict[tuple[int, int], tuple[tuple[int, ...], tuple[int, ...]]]
    tables: dict[int, tuple[int, int]]  # of each component in the scan: DC and AC table
    restart: int
    scan_at: int


def read_header(data: bytes) -> Header:
    """Everything before the entropy-coded data. Files that aren't baseline JPEG of one scan raise ValueError."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    quantisation: dict[int, np.ndarray] = {}
    huffman = {(0, 0): _DC_LUMA, (1, 0): _AC_LUMA, (0, 1): _DC_CHROMA, (1, 1): _AC_CHROMA}
    huffman = {k: (tuple(a), tuple(b if k[0] == 0 else [*b, *sorted({*_AC_ALL} - {*b})])) for k, (a, b) in huffman.items()}
    size, restart, at = None, 0, 2
    components: list[_Component] = []
    while True:
        while at < len(data) and data[at] == 0xFF and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a JPEG marker is missing")
        marker, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, table = body[k] >> 4, body[k] & 15
                quantisation[table] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.float32)
                k += 129 if wide else 65
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                lengths = tuple(body[k + 1 : k + 17])
                huffman[body[k] >> 4, body[k] & 15] = lengths, tuple(body[k + 17 : k + 17 + sum(lengths)])
                k += 17 + sum(lengths)
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples of another size than 8 bits")
            size = struct.unpack(">HH", body[1:5])
            components = [_Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            if size is None or body[0] != len(components):
                raise ValueError("not one scan of all components")
            return Header(*size, components, quantisation, huffman, {body[k]: (body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)}, restart, at)


def scan_parts(data: bytes, at: int) -> list[bytes]:
    """The entropy-coded bytes of each restart interval, without stuffing."""
    parts, start = [], at
    while True:
        k = data.find(b"\xff", at)
        if k < 0 or k + 1 >= len(data):
            parts.append(data[start:])
            break
        if data[k + 1] == 0 or data[k + 1] == 0xFF:
            at = k + (2 if data[k + 1] == 0 else 1)
            continue
        parts.append(data[start:k])
        if not 0xD0 <= data[k + 1] <= 0xD7:
            break
        start = at = k + 2
    return [p.replace(b"\xff\x00", b"\xff") for p in parts]


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the first component's blocks (in zigzag order, blocks as coded, undone only of prediction), and its samples (height x width)."""
    h = read_header(data)
    parts = scan_parts(data, h.scan_at)
    if len(h.components) == 1:
        h = h._replace(components=[h.components[0]._replace(across=1, down=1)])
    most = max(c.across for c in h.components), max(c.down for c in h.components)
    wide, high = -(-h.width // (8 * most[0])), -(-h.height // (8 * most[1]))
    tables = [tuple(_lookup(*h.huffman[kind, n]) for kind, n in enumerate(h.tables[c.number])) for c in h.components]
    first = h.components[0]
    blocks = np.zeros((wide * high * first.across * first.down, 64), np.int32)
    done = unit = 0
    for part in parts:
        bits = left = at = 0  # bits that were read and not yet used, how many of them, and where to read on
        before = [0] * len(h.components)
        for _ in range(min(h.restart or wide * high, wide * high - unit)):
            for i, c in enumerate(h.components):
                dc, ac = tables[i]
                for _ in range(c.across * c.down):
                    values, k = [0] * 64, 0
                    while k < 64:
                        if left < 32:  # a code and its extra bits are 16 + 15 bits at most
                            if at > len(part) + 8:
                                raise ValueError("the entropy-coded data end early")
                            bits = (bits & ((1 << left) - 1)) << 64 | int.from_bytes(part[at : at + 8].ljust(8, b"\xff"), "big")
                            left, at = left + 64, at + 8
                        found = (ac if k else dc)[bits >> (left - 16) & 0xFFFF]
                        if found is None:
                            raise ValueError("an unknown code")
                        left -= found[0]
                        run, size = found[1] >> 4, found[1] & 15
                        if k and not size:
                            if run != 15:
                                break
                            k += 16
                            continue
                        k += run
                        if k > 63:
                            raise ValueError("too many coefficients")
                        if size:
                            left -= size
                            v = bits >> left & ((1 << size) - 1)
                            values[k] = v if v >> (size - 1) else v - (1 << size) + 1
                        k += 1
                    values[0] += before[i]
                    before[i] = values[0]
                    if i == 0:
                        blocks[done] = values
                        done += 1
            unit += 1
    if unit < wide * high:
        raise ValueError("the entropy-coded data end early")
    samples = np.clip(np.rint(blocks.astype(np.float32) * h.quantisation[first.table] @ BASIS) + 128, 0, 255).astype(np.uint8)
    grid = samples.reshape(high, wide, first.down, first.across, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(high * first.down * 8, wide * first.across * 8)
    rows, columns = -(-h.height * first.down // most[1]), -(-h.width * first.across // most[0])
    return blocks, grid[:rows, :columns]
