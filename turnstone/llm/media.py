"""Media columns: texts as lossless 8-bit PNG images in a binary column, and hashes of the images.

The writer cuts the pixels in rows, filters each row (none, sub or up, whichever leaves the least
absolute sum), and deflates them in zlib chunks; each chunk carries its checksum.  The reader tests
signature, chunk order and checksums, inflates, and undoes all five filters with numpy.  The feature
is the sign pattern of the low frequencies of a cosine transform of the image, scaled to 32 x 32.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import bound_batches, keep

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed values: the PNG signature; pixels and bytes of a row
WIDTH, SAMPLES = 64, 3
ROW = WIDTH * SAMPLES
CHUNK_BYTES, LEVEL, SIDE, LOW = 1 << 20, 6, 32, 8
ENCODED = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes) -> bytes:
    """A PNG of 64 pixels of 3 samples in each row; the payload is a positive multiple of 192 bytes."""
    if not payload or len(payload) % ROW:
        raise ValueError(f"the payload must be a positive multiple of {ROW} bytes")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sub, up = rows.copy(), rows.copy()
    sub[:, SAMPLES:] -= rows[:, :-SAMPLES]
    up[1:] -= rows[:-1]
    ways = (rows, sub, up)
    cost = np.stack([np.abs(w.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for w in ways])
    best = cost.argmin(axis=0)
    out = np.empty((len(rows), ROW + 1), np.uint8)
    out[:, 0] = best
    for k, way in enumerate(ways):
        at = best == k
        out[at, 1:] = way[at]
    packed = zlib.compress(out.tobytes(), LEVEL)
    data = b"".join(_chunk(b"IDAT", packed[k : k + CHUNK_BYTES]) for k in range(0, len(packed), CHUNK_BYTES))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)) + data + _chunk(b"IEND", b"")


def _chunks(png: bytes):
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        (size,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if at + 12 + size > len(png) or struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        yield kind, data
        at += 12 + size


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def unfilter(filters: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undo the filters of all rows; ``step`` is the number of bytes of a pixel."""
    if len(filters) and filters.max() > 4:
        raise ValueError("unknown filter")
    out = rows.copy()
    height, width = rows.shape
    sub = np.flatnonzero(filters == 1)
    if len(sub):  # sums along the row, one for each sample of a pixel
        out[sub] = np.cumsum(rows[sub].reshape(len(sub), width // step, step), axis=1, dtype=np.uint8).reshape(len(sub), width)
    zero = np.zeros(width, np.uint8)
    y = 0
    while y < height:
        kind = filters[y]
        if kind == 2:  # a run of rows is a sum down the columns
            end = y + 1
            while end < height and filters[end] == 2:
                end += 1
            above = out[y - 1] if y else zero
            out[y:end] = np.cumsum(np.concatenate([above[None], rows[y:end]]), axis=0, dtype=np.uint8)[1:]
            y = end
            continue
        if kind >= 3:
            above = (out[y - 1] if y else zero).astype(np.int16)
            left, corner = np.zeros(step, np.int16), np.zeros(step, np.int16)
            for x in range(0, width, step):
                up = above[x : x + step]
                guess = (left + up) >> 1 if kind == 3 else _paeth(left, up, corner)
                left, corner = (rows[y, x : x + step] + guess) & 255, up
                out[y, x : x + step] = left
        y += 1
    return out


def decode_png(png: bytes) -> np.ndarray:
    """Samples of an 8-bit, not interlaced PNG: height x (width times samples)."""
    head, data, ended = None, [], False
    for kind, content in _chunks(png):
        if ended or (head is None) != (kind == b"IHDR"):
            raise ValueError("chunks are out of order")
        if kind == b"IHDR":
            width, height, depth, colour, compression, filtering, interlace = head = struct.unpack(">IIBBBBB", content)
            if depth != 8 or colour not in (0, 2, 4, 6) or compression or filtering or interlace:
                raise ValueError("only 8-bit grey or true colour, not interlaced")
            step = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
        elif kind == b"IDAT":
            data.append(content)
        elif kind == b"IEND":
            ended = True
    if not ended:
        raise ValueError("no end chunk")
    raw = zlib.decompress(b"".join(data))
    if len(raw) != height * (width * step + 1):
        raise ValueError("the pixel data has another size than the header says")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * step + 1)
    return unfilter(lines[:, 0], lines[:, 1:], step)


_K = np.arange(LOW)[:, None] * (2 * np.arange(SIDE)[None] + 1)
COSINES = np.cos(np.pi * _K / (2 * SIDE))


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest frequencies lie over their median; the constant term is left out of the median."""
    grey = samples.reshape(len(samples), WIDTH, -1).mean(axis=2)
    height = len(grey)
    columns = grey.reshape(height, SIDE, WIDTH // SIDE).mean(axis=2)
    if height >= SIDE:
        edges = np.arange(SIDE) * height // SIDE
        small = np.add.reduceat(columns, edges, axis=0) / np.diff(np.append(edges, height))[:, None]
    else:
        small = columns[np.arange(SIDE) * height // SIDE]
    low = np.round(COSINES @ small @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of UTF-8 bytes of the text, and the PNG of the padded bytes."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                sizes.append(len(raw))
                media.append(encode_png(raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" ")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ENCODED)


def media_features(media: DataFrame) -> DataFrame:
    """Read the stored bytes back and describe payload and image."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for png in batch.column(2).to_pylist():
                samples = decode_png(png)
                payload = samples.tobytes()
                for column, value in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples))):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each text as an image to a table of the shared folder, read that back, return the images' features.

    A null text counts as empty: one row of 192 spaces.  A null id stays null, repeated rows stay
    repeated, other columns are not read, an empty table gives an empty one.
    """
    return media_features(keep(encode_media(docs, id_col, text_col), "media"))
