"""Payloads in AVI files of motion JPEG, read back, and cut into shots.

write_avi: a payload (bytes, zero-filled to a positive multiple of 64) becomes the coefficients of 8x8 JPEG blocks, one byte
each: a byte b is the coefficient of size class 8 whose extra bits are b. With one-bit Huffman codes and a restart after
each block, a block is 72 bytes and the JPEG is a valid baseline file; a 0xFF inside is followed by a stuffed 0 as usual. Frames
are GRID x GRID blocks; the last one is filled with zero blocks, and an INFO comment holds the payload's length.

read_avi: walks the RIFF chunks of any motion-JPEG AVI, finds frames by the index (or, without one, in their order), decodes each
intra frame (baseline JPEG with the tables of the file, see jpeg.py) to coefficients and to 8-bit samples of its first component, and compares histograms of
neighbouring frames. The coefficients of files with a length are the payload. A cut is where the difference exceeds the mean of the
differences just before it by DEVIATIONS standard deviations and is at least LEAST. The runs between cuts are timed clips.

Null texts are empty (one zero block); equal payloads give equal files and clips; empty tables give empty results; other
columns of the input are not read. Null files, and files that are broken or of another kind, give a row with the reason in
error, and no payload and clips; files without a payload's length have clips and no payload. A frame of no bytes repeats the one before.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import whole_text

GRID, RATE, BINS = 4, 25, 16
BLOCKS = GRID * GRID
DEVIATIONS, LEAST, BEFORE = 3.0, 0.2, 8

def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_ONE_CODE = bytes([1] + [0] * 15) + b"\x08"  # one code of one bit, for size class 8 after no zeros
_HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * GRID, 8 * GRID, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + _ONE_CODE)
    + _segment(0xC4, b"\x10" + _ONE_CODE)
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)
def jpeg_scans(blocks: np.ndarray) -> np.ndarray:
    """Entropy-coded bytes (72 a block, before stuffing) of rows of 64 byte values."""
    bits = np.zeros((len(blocks), 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks[:, :, None], axis=2)
    return np.packbits(bits.reshape(len(blocks), 576), axis=1)


def jpeg_frame(scan: np.ndarray) -> bytes:
    parts = [row.tobytes().replace(b"\xff", b"\xff\x00") for row in scan]
    body = b"".join(p + bytes((0xFF, 0xD0 + i % 8)) for i, p in enumerate(parts[:-1])) + parts[-1]
    return _HEADER + body + b"\xff\xd9"


def _own_scan(frame: bytes) -> bytes | None:
    """The entropy-coded blocks of a frame with this module's header, 72 bytes each; None of other frames."""
    if not frame.startswith(_HEADER):
        return None
    parts = jpeg.scan_parts(frame, len(_HEADER))
    return b"".join(parts) if all(len(p) == 72 for p in parts) and len(parts) == BLOCKS else None


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi_file(payload: bytes) -> bytes:
    """The AVI of a payload of 64 * n bytes."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    n = -(-len(blocks) // BLOCKS)
    blocks = np.concatenate([blocks, np.zeros((n * BLOCKS - len(blocks), 64), np.uint8)])
    scans = jpeg_scans(blocks)
    frames = [jpeg_frame(scans[i : i + BLOCKS]) for i in range(0, len(scans), BLOCKS)]
    side, most = 8 * GRID, max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, side, side, 0, 0, 0, 0)
    head = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, most, 0xFFFFFFFF, 0, 0, 0, side, side)
    form = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", head) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", str(len(payload)).encode()))
    index, movi, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


def avi_frames(data: bytes) -> tuple[list[bytes], int | None, float]:
    """Frames of the first video stream, the payload's length if the file has one, and seconds a frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, found, length, step = 0, [], None, 0.0
    in_order: list[tuple[int, int]] = []
    for name, a, b in _chunks(data, 12, len(data)):
        kind = data[a : a + 4]
        if name == b"LIST" and kind == b"hdrl":
            step = next((struct.unpack_from("<I", data, x)[0] / 1e6 for n, x, _ in _chunks(data, a + 4, b) if n == b"avih"), 0.0)
        elif name == b"LIST" and kind == b"INFO":
            length = next((int(data[x:y].rstrip(b"\0")) for n, x, y in _chunks(data, a + 4, b) if n == b"ICMT" and data[x:y].rstrip(b"\0").isdigit()), None)
        elif name == b"LIST" and kind == b"movi":
            movi = a
            in_order = [(x, y - x) for n, x, y in _chunks(data, a + 4, min(b, len(data))) if n[2:] in (b"dc", b"db")]
        elif name == b"idx1":
            for at in range(a, min(b, len(data)) - 15, 16):
                stream, _, offset, size = struct.unpack_from("<4sIII", data, at)
                if stream[2:] in (b"dc", b"db"):
                    # offsets count from the list's name, or from the start of the file
                    found.append(((movi if data[movi + offset : movi + offset + 4] == stream else 0) + offset + 8, size))
    frames = [data[x : x + size] for x, size in found or in_order]
    frames = [f for i, f in enumerate(frames) if f or i]
    for i, f in enumerate(frames):
        frames[i] = f or frames[i - 1]
    if not frames:
        raise ValueError("no video frames")
    return frames, length, step


def decode_frames(frames: list[bytes]) -> tuple[bytes, list[np.ndarray]]:
    """Bytes stored in the coefficients of intra frames, and the 8-bit samples of each."""
    scans = [_own_scan(f) for f in frames]
    stored, images = [], []
    for frame, scan in zip(frames, scans, strict=True):
        if scan is None:
            blocks, image = jpeg.decode(frame)
            stored.append(np.where(blocks < 0, blocks + 255, blocks).clip(0, 255).astype(np.uint8).tobytes())
            images.append(image)
            continue
        raw = np.frombuffer(scan, np.uint8).reshape(BLOCKS, 72)
        own = np.packbits(np.unpackbits(raw, axis=1).reshape(BLOCKS, 64, 9)[:, :, 1:], axis=2).reshape(BLOCKS, 64)
        values = own.astype(np.float32)
        values = np.where(own >= 128, values, values - 255)  # size class 8: extra bits to coefficient
        stored.append(own.tobytes())
        images.append(np.clip(np.rint(values @ jpeg.BASIS) + 128, 0, 255).astype(np.uint8))
    return b"".join(stored), images


def shot_starts(images: list[np.ndarray]) -> list[int]:
    """Numbers of the frames that begin a shot."""
    hist = np.stack([np.bincount(x.ravel() >> 4, minlength=BINS) / x.size for x in images])
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    starts = [0]
    for i, d in enumerate(diff):
        recent = diff[max(starts[-1], i - BEFORE) : i]
        if d >= LEAST and (len(recent) == 0 or d > recent.mean() + DEVIATIONS * recent.std()):
            starts.append(i + 1)
    return starts


def write_avi(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), media (the AVI) of all documents (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                raw = [t.encode() for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": [len(r) for r in raw], "media": [avi_file(r + b"\0" * (-len(r) % 64 or 64 * (not r))) for r in raw]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInPandas(run, "doc_id long, n_bytes long, media binary")


CLIPS = "array<struct<start_frame: int, end_frame: int, start_s: double, end_s: double>>"


def read_file(data: bytes | None) -> tuple[bytes | None, list[dict] | None, str | None]:
    """Payload, clips and error of one file."""
    try:
        if data is None:
            raise ValueError("no file")
        frames, length, step = avi_frames(data)
        stored, images = decode_frames(frames)
        if length is not None and length > len(stored):
            raise ValueError("less data than the payload's length")
    except (ValueError, IndexError, KeyError, struct.error) as e:
        return None, None, f"{type(e).__name__}: {e}"
    starts = shot_starts(images)
    clips = [{"start_frame": a, "end_frame": b, "start_s": a * step, "end_s": b * step} for a, b in zip(starts, [*starts[1:], len(frames)], strict=True)]
    return None if length is None else stored[:length], clips, None


def read_avi(media: DataFrame) -> DataFrame:
    """The input's doc_id, n_bytes, media with payload (binary), clips (an array of start_frame, end_frame, start_s, end_s; ends excluded) and error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                payloads, clips, errors = (list(x) for x in zip(*map(read_file, part["media"]), strict=True))
                yield part.assign(payload=payloads, clips=clips, error=errors)

    return media.select("doc_id", "n_bytes", "media").mapInPandas(run, f"doc_id long, n_bytes long, media binary, payload binary, clips {CLIPS}, error string")


def clip_rows(decoded: DataFrame) -> DataFrame:
    """One row for each timed clip."""
    return decoded.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")
