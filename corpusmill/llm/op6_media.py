"""Media columns: payloads as PNG files in a binary column, and perceptual hashes of what is read back.

A payload is the text's UTF-8 bytes with zero bytes up to a positive multiple of 64; it is stored as an 8-bit grey
image 64 samples wide. The encoder picks the filter of each row (none, left, above) by the least sum of absolute
differences, deflates the rows and cuts them into IDAT chunks with checksums. The decoder tests every chunk's
checksum, inflates and undoes all five filters of the format with numpy. The feature is the sign pattern of the 63
lowest frequencies of a two-dimensional cosine transform of the image averaged to 32 x 32, against their median; the
transform uses integers, so that equal images give equal bits on every machine.

Cases: a null text is empty (64 zero bytes); equal rows are stored each; a null doc_id is kept; an empty table gives
no rows; other columns aren't read. A damaged file raises ValueError.
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

from corpusmill.llm import common

WIDTH = 64
CHUNK = 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRID, LOW = 32, 8
_k = np.arange(LOW)[:, None] * (2 * np.arange(GRID)[None, :] + 1)
COSINES = np.rint(np.cos(np.pi * _k / (2 * GRID)) * 4096).astype(np.int64)


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    above = rows.copy()
    above[1:] -= rows[:-1]
    choices = (rows, left, above)
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in choices])
    best = cost.argmin(axis=0).astype(np.uint8)
    raw = np.empty((len(rows), width + 1), np.uint8)
    raw[:, 0] = best
    raw[:, 1:] = np.where(best[:, None] == 0, rows, np.where(best[:, None] == 1, left, above))
    packed = zlib.compress(raw.tobytes(), level)
    body = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The file's chunks, each after its checksum's test."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, kind = 8, b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise ValueError("the file ends within a chunk")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        yield kind, body
        at += 12 + n


def unfilter(raw: np.ndarray) -> np.ndarray:
    """Undoes the row filters of 8-bit grey rows; raw has each row's filter in column 0."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown row filter")
    own = kinds == 1
    rows[own] = np.cumsum(rows[own], axis=1, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[255, kinds, 255].astype(np.int16)))
    for a, b in zip(edges[:-1], edges[1:]):
        if kinds[a] == 2:  # a run of rows that differ from the row above
            if a:
                rows[a] += rows[a - 1]
            rows[a:b] = np.cumsum(rows[a:b], axis=0, dtype=np.uint8)
        elif kinds[a] > 2:
            for y in range(a, b):
                _sequential(rows, y, kinds[y] == 4)
    return rows


def _sequential(rows: np.ndarray, y: int, paeth: bool) -> None:
    """Average and Paeth rows, where each sample needs the one before it."""
    above = rows[y - 1].tolist() if y else [0] * rows.shape[1]
    out, left, corner = [], 0, 0
    for x, up in zip(rows[y].tolist(), above):
        if paeth:
            p = left + up - corner
            pa_, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
            guess = left if pa_ <= pb and pa_ <= pc else up if pb <= pc else corner
        else:
            guess = (left + up) // 2
        left, corner = (x + guess) & 255, up
        out.append(left)
    rows[y] = out


def decode_png(data: bytes) -> np.ndarray:
    head, body = None, []
    for kind, part in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlacing are read")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    return unfilter(raw.reshape(head[1], head[0] + 1))


def _averaged(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of integers averaged (or repeated) to n rows, in 1/256."""
    h = len(x)
    if h < n:
        return (x[np.arange(n) * h // n] << 8).astype(np.int64)
    cuts = np.arange(n) * h // n
    return (np.add.reduceat(x, cuts, axis=0, dtype=np.int64) << 8) // np.diff(np.r_[cuts, h])[:, None]


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits, the first always 0."""
    small = _averaged(image.astype(np.int64), GRID) >> 4
    small = _averaged(np.ascontiguousarray(small.T), GRID).T >> 8
    low = (COSINES @ small @ COSINES.T).ravel()
    bits = low > np.sort(low[1:])[31]
    bits[0] = False
    return np.packbits(bits).tobytes()


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                loads = [padded(t) for t in batch.column(1)[at : at + 500].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 500], pa.array([n for _, n in loads], pa.int64()), pa.array([encode_png(p) for p, _ in loads], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What reading the stored bytes gives: payload's size and digests, the media's, and hash (binary) and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows: list[list] = [[] for _ in range(7)]
                for stored in batch.column(2)[at : at + 500].to_pylist():
                    image = decode_png(stored)
                    payload, bits = image.tobytes(), cosine_hash(image)
                    for col, x in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), bits.hex(), bits)):
                        col.append(x)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "hash")
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 500], batch.column(1)[at : at + 500], *(pa.array(c, t) for c, t in zip(rows, types))], names=["doc_id", "n_bytes", *names])

    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, hash binary"
    return media.mapInArrow(run, out)


def op6_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = common.written(encode_media(common.documents(spark, sf_dir)), "media")
    return media_features(stored).drop("hash")
