"""Byte payloads as PNG images in binary columns, and perceptual hashes of their low frequencies.

A payload (padded to whole rows of WIDTH bytes) is stored as an 8-bit grey PNG: signature, IHDR, IDAT and IEND, each
chunk with its CRC, rows filtered by None, Sub or Up (the one with the least absolute sum for the image) and deflated.
The reader walks the chunks, tests every checksum, inflates, and undoes the filters in numpy (all five are known).
The hash takes the image's area means on a 32 x 32 grid, its two-dimensional cosine transform, and the signs of the 63
lowest frequencies but the mean against their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import append, id_text, table

WIDTH = 64
GRID = 32
LOW = 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 1


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of WIDTH, and their number before."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0"), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: np.ndarray, level: int = LEVEL) -> bytes:
    """An 8-bit grey PNG of a two-dimensional uint8 array."""
    height, width = samples.shape
    sub, up = samples.copy(), samples.copy()
    sub[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    kinds = (samples, sub, up)
    kind = min(range(3), key=lambda i: int(np.abs(kinds[i].view(np.int8).astype(np.int16)).sum()))
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kind, kinds[kind]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")



def _unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows (the first column is each row's filter), one byte a sample."""
    kinds, data = rows[:, 0], rows[:, 1:].copy()
    if (kinds == 0).all():
        return data
    if (kinds == 1).all():
        return np.cumsum(data, axis=1, dtype=np.uint8)
    if (kinds == 2).all():
        return np.cumsum(data, axis=0, dtype=np.uint8)
    above = np.zeros(data.shape[1], np.uint8)
    for kind, row in zip(kinds.tolist(), data, strict=True):
        if kind == 1:
            row[:] = np.cumsum(row, dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            left = corner = 0
            for x in range(len(row)):
                b = int(above[x])
                if kind == 3:
                    guess = (left + b) // 2
                else:
                    p = left + b - corner
                    da, db, dc = abs(p - left), abs(p - b), abs(p - corner)
                    guess = left if da <= db and da <= dc else b if db <= dc else corner
                left, corner = (int(row[x]) + guess) & 255, b
                row[x] = left
        elif kind:
            raise ValueError(f"PNG filter {kind}")
        above = row
    return data


def decode_png(blob: bytes) -> np.ndarray:
    """Samples of an 8-bit grey, not interlaced PNG. ValueError if the signature, a checksum or a size is wrong."""
    if blob[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, data, kind = 8, None, [], b""
    while at + 12 <= len(blob) and kind != b"IEND":
        (size,) = struct.unpack_from(">I", blob, at)
        kind, body = blob[at + 4 : at + 8], blob[at + 8 : at + 8 + size]
        check = blob[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", check)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if header is None or kind != b"IEND" or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey PNG")
    width, height = header[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != height * (width + 1):
        raise ValueError("size of the image data")
    return _unfilter(raw.reshape(height, width + 1))


@lru_cache(maxsize=4)
def _cosines(n: int = GRID, low: int = LOW) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


def _means(a: np.ndarray, n: int) -> np.ndarray:
    """Means of n equal stretches along the first axis; stretches may cut through rows."""
    total = np.concatenate([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0, dtype=np.float64)])
    at = np.linspace(0, len(a), n + 1)
    low = np.minimum(at.astype(int), len(a) - 1)
    upto = total[low] + (at - low)[:, None] * a[low]
    return np.diff(upto, axis=0) * (n / len(a))


def low_frequency_hash(samples: np.ndarray) -> bytes:
    """64 bits of the signs of low cosine frequencies against their median; the first bit (the mean) is zero.

    Frequencies are rounded to six places, so that those that are zero but for rounding errors are ties and give zeros.
    """
    grid = _means(_means(samples, GRID).T, GRID).T
    c = _cosines()
    flat = np.round(c @ grid @ c.T, 6).ravel()
    bits = flat > np.median(flat[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media, dct_hash, payload_sha256, payload_bytes, tail_crc32) for every row.

    media is the PNG; the digests and the hash are of the samples read back from it. Null or empty text: one row of
    zeros. Empty table: no rows. Whole texts are stored, however long. Equal texts give equal values; other columns are
    ignored. A reading that differs in size raises.
    """

    def kernel(batch: pa.RecordBatch) -> list:
        cols: list[list] = [[] for _ in range(6)]
        for text in batch.column("__text").to_pylist():
            body, n = payload(text)
            blob = encode_png(np.frombuffer(body, np.uint8).reshape(-1, WIDTH))
            samples = decode_png(blob)
            back = samples.tobytes()
            row = (n, blob, low_frequency_hash(samples), hashlib.sha256(back).hexdigest(), len(back), zlib.crc32(back[-WIDTH:]))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        return cols

    ddl = "n_bytes bigint, media binary, dct_hash binary, payload_sha256 string, payload_bytes bigint, tail_crc32 bigint"
    return append(id_text(docs, id_col, text_col), kernel, ddl).drop("__text")


def op6(spark, sf_dir: str) -> DataFrame:
    return store(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        "cast(octet_length(media) AS bigint) AS media_bytes", "sha2(media, 256) AS media_sha256", "lower(hex(dct_hash)) AS feature",
    )
