"""Media columns: texts as PNG images in a binary column, read back with checksum tests, and image hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged

ROW_BYTES = 192  # 64 RGB pixels
PIXEL_BYTES = 3
HASH_SIDE = 8
SHRUNK_SIDE = 32
# Fixed value: the signature that begins every PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes | None) -> bytes:
    """The text's bytes, padded with spaces to a positive multiple of a pixel row."""
    text = text or b""
    return text.ljust(max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(data: bytes, level: int = 1) -> bytes:
    """An 8-bit RGB PNG of 64 pixels a row: the smaller of no filters and, row by row, the filter of least absolute sum."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, ROW_BYTES)
    sub = rows.copy()
    sub[:, PIXEL_BYTES:] -= rows[:, :-PIXEL_BYTES]
    up = rows.copy()
    up[1:] -= rows[:-1]
    kinds = np.stack([rows, sub, up])
    cost = np.abs(kinds.view(np.int8)).astype(np.uint8).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), ROW_BYTES + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = kinds[best, np.arange(len(rows))]
    plain = np.zeros_like(lines)
    plain[:, 1:] = rows
    packed = min((zlib.compress(x.tobytes(), level) for x in (plain, lines)), key=len)
    head = struct.pack(">IIBBBBB", ROW_BYTES // PIXEL_BYTES, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", packed) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Rows without their filters. Runs of none, sub and up are undone by whole arrays, the others row by row."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    sub = np.flatnonzero(kinds == 1)
    if len(sub):
        pixels = out[sub].reshape(len(sub), -1, bpp)
        out[sub] = np.add.accumulate(pixels, axis=1, dtype=np.uint8).reshape(len(sub), -1)
    change = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip(np.concatenate([[0], change]), np.concatenate([change, [len(kinds)]]), strict=True):
        if b == a or kinds[a] < 2:
            continue
        above = out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
        if kinds[a] == 2:
            out[a:b] = np.add.accumulate(np.vstack([above, out[a:b]]), axis=0, dtype=np.uint8)[1:]
            continue
        for r in range(a, b):
            row, up = out[r].astype(np.int64), above.astype(np.int64)
            left, corner = np.zeros(bpp, np.int64), np.zeros(bpp, np.int64)
            for x in range(0, len(row), bpp):
                b_up = up[x : x + bpp]
                if kinds[r] == 3:
                    guess = (left + b_up) // 2
                else:
                    p = left + b_up - corner
                    da, db, dc = abs(p - left), abs(p - b_up), abs(p - corner)
                    guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, b_up, corner))
                left = row[x : x + bpp] = (row[x : x + bpp] + guess) & 255
                corner = b_up
            above = out[r] = row.astype(np.uint8)
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Pixel rows (height, width * channels) of an 8-bit, not interlaced PNG; raises ValueError on any damage."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, data, ended = 8, None, [], False
    while at + 12 <= len(media):
        n = int.from_bytes(media[at : at + 4], "big")
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(body) < n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("PNG chunk fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + n
    if head is None or not ended:
        raise ValueError("PNG lacks a chunk")
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlace or channels is None:
        raise ValueError("only 8-bit grey and colour PNGs without interlace are read")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(lines) != height * (1 + width * channels):
        raise ValueError("PNG has another size than it says")
    return _unfilter(lines.reshape(height, -1), channels)


_k = np.arange(SHRUNK_SIDE)
_COSINES = np.cos(np.pi / SHRUNK_SIDE * (_k[None, :] + 0.5) * np.arange(HASH_SIDE + 1)[:, None])


def _shrunk(grey: np.ndarray, side: int, axis: int) -> np.ndarray:
    """Means over ``side`` equal parts of an axis (parts repeat if the axis is shorter)."""
    n = grey.shape[axis]
    edges = np.arange(side + 1) * n // side
    first, last = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
    total = np.concatenate([np.zeros_like(grey.take([0], axis)), np.cumsum(grey, axis=axis)], axis=axis)
    width = (last - first).astype(float)
    return (total.take(last, axis) - total.take(first, axis)) / (width if axis else width[:, None])


def image_hash(rows: np.ndarray, channels: int = PIXEL_BYTES) -> bytes:
    """64 bits: which low-frequency cosine terms (without the constant one) exceed their median."""
    grey = rows.reshape(len(rows), -1, channels).mean(axis=2)
    small = _shrunk(_shrunk(grey, SHRUNK_SIDE, 0), SHRUNK_SIDE, 1)
    low = (_COSINES @ small @ _COSINES.T)[1:, 1:].ravel()
    return np.packbits(low > np.median(low)).tobytes()


def _encoded(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([encode_png(payload(t)) for t in texts], pa.binary())],
            ["doc_id", "n_bytes", "media"],
        )


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, image_hash binary"


def _features(batches):
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    for batch in batches:
        rows = []
        for doc, n, media in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            pixels = decode_png(media)
            data = pixels.tobytes()
            code = image_hash(pixels)
            rows.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), code.hex(), code))
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def to_media(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media): every whole text as a lossless PNG; null texts count as empty.

    Null and repeated ids are rows like any other; other columns are ignored; an empty table gives no row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Decoded payload digests and the 64-bit hash of each row of (doc_id, n_bytes, media); damaged media fail the job."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, _FEATURES)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = staged(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return media_features(stored).drop("image_hash")
