"""Media columns: bytes as greyscale PNG images in binary columns, and low-frequency cosine hashes of them.

A payload is the UTF-8 text with bytes 0 appended up to a positive multiple of 64. It becomes an
image 64 samples wide, 8 bits each. PNG chunks carry checksums that are tested on reading; rows are
filtered by the one of None, Sub and Up with the least sum of absolute differences, and unfiltered
with numpy (all five filter types are read). The hash averages the image to 32 x 32 cells, takes
the cosine transform and compares its 8 x 8 lowest frequencies with their median: 64 bits in hex.

Null text counts as empty: a payload of 64 zero bytes. Equal texts give equal values. A broken
chunk raises ValueError. Columns other than key and text are not carried.
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

from . import common
from .bpe import slices

NAME = "op4_media"
WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CELLS, LOW = 32, 8
BATCH_BYTES = 8_000_000


def payload_of(text: bytes, unit: int = WIDTH) -> bytes:
    return text + bytes((-len(text)) % unit or (0 if text else unit))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_encode(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    tried = {0: rows, 1: np.diff(rows, axis=1, prepend=np.uint8(0)), 2: np.diff(rows, axis=0, prepend=np.zeros((1, width), np.uint8))}
    cost = {k: int(np.abs(v.view(np.int8).astype(np.int16)).sum(dtype=np.int64)) for k, v in tried.items()}
    best = min(cost, key=lambda k: (cost[k], k))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = best, tried[best]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    kinds, raw = lines[:, 0], lines[:, 1:]
    out = np.zeros_like(raw)
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    above = np.zeros(raw.shape[1], np.uint8)
    for a, b in zip(cuts, cuts[1:], strict=False):
        kind, part = int(kinds[a]), raw[a:b]
        if kind == 0:
            out[a:b] = part
        elif kind == 1:
            out[a:b] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(np.vstack([above, part]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for y in range(a, b):
                left = corner = 0
                for x in range(raw.shape[1]):
                    up = int(above[x])
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        p = left + up - corner
                        guess = min((left, up, corner), key=lambda v, p=p: abs(p - v))
                    left, corner = (int(raw[y, x]) + guess) & 255, up
                    out[y, x] = left
                above = out[y]
        else:
            raise ValueError(f"filter type {kind}")
        above = out[b - 1]
    return out


def png_decode(png: bytes) -> np.ndarray:
    """The image's samples; ValueError where signature, checksum or size is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, head, ended = 8, [], None, False
    while at + 12 <= len(png) and not ended:
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if len(body) < n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale PNG, or cut off")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(lines) != head[1] * (head[0] + 1):
        raise ValueError("size")
    return _unfilter(lines.reshape(head[1], head[0] + 1))


_k = np.arange(CELLS)
COSINES = np.cos(np.pi * (2 * _k[None, :] + 1) * _k[:LOW, None] / (2 * CELLS))


def cosine_hash(image: np.ndarray) -> str:
    """Hex of the 64 bits that say which of the lowest frequencies exceed their median."""
    h, w = image.shape
    rows, cols = (np.arange(CELLS) * h) // CELLS, (np.arange(CELLS) * w) // CELLS
    if h >= CELLS:
        small = np.add.reduceat(image.astype(np.int64) if h * w < 1 << 22 else image, rows, axis=0, dtype=np.int64) / np.diff(np.append(rows, h))[:, None]
    else:
        small = image[rows].astype(float)
    small = np.add.reduceat(small, cols, axis=1) / np.diff(np.append(cols, w))
    low = (COSINES @ small @ COSINES.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def _map(df: DataFrame, schema: str, fields: list[str], make) -> DataFrame:
    """make(row bytes) -> tuple, over the second column; the first is carried."""
    common.ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, BATCH_BYTES):
                cols = zip(*(make(x or b"") for x in b.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], fields)

    return df.mapInArrow(run, schema)


def store(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media: the PNG of each text's payload."""
    kind = df.schema[key].dataType.simpleString()
    return _map(df.select(F.col(key), F.col(text).cast("binary").alias("text")), f"`{key}` {kind}, n_bytes long, media binary", [key, "n_bytes", "media"], lambda x: (len(x), png_encode(payload_of(x))))


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads the stored images back: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def make(png: bytes) -> tuple:
        image = png_decode(png)
        payload = image.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(image)

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = media.schema[key].dataType.simpleString()
    return _map(media.select(F.struct(key, "n_bytes").alias("k"), "media"), f"k struct<`{key}`:{kind},n_bytes:bigint>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", ["k", *names], make).select("k.*", *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of every document's image."""
    return features(store(common.table(spark, sf_dir, "documents")))


ORACLE_SQL = None
