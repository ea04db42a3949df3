"""PNG round trips, checksums, all filters, hashes."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from turnstone.llm import media


def test_round_trip_of_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stored = {r.doc_id: bytes(r.media) for r in media.encode_media(docs).collect()}
    for r in media.media_columns(docs).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest()) and len(r.feature) == 16


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " " * 192, 7), (None, "é" * 96, 7), (4, "x" * 200_000, 7), (4, "x" * 200_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, feature long")
    found = media.media_columns(docs).collect()
    assert len(found) == 6
    by = {r.doc_id: r for r in found}
    assert by[1].payload_sha256 == by[2].payload_sha256 == by[3].payload_sha256 and by[1].n_bytes == 0 and by[None].payload_bytes == 192
    assert media.media_columns(docs.limit(0)).count() == 0


def reference_filter(rows, kinds, step):
    """Filtering by the definition, sample by sample."""
    out = []
    for y, kind in enumerate(kinds):
        line = []
        for x in range(rows.shape[1]):
            a = int(rows[y, x - step]) if x >= step else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - step]) if y and x >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((int(rows[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out.append(line)
    return np.array(out, np.uint8)


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_all_filters_are_undone(step):
    rng = np.random.default_rng(step)
    rows = rng.integers(0, 256, (40, 12 * step), np.uint8)
    kinds = rng.integers(0, 5, 40)
    assert (media.unfilter(kinds.astype(np.uint8), reference_filter(rows, kinds, step), step) == rows).all()


def test_damage_is_noticed():
    png = media.encode_png(bytes(range(192)) * 3)
    assert media.decode_png(png).tobytes() == bytes(range(192)) * 3
    rnd = random.Random(1)
    for _ in range(60):
        at = rnd.randrange(len(png))
        with pytest.raises((ValueError, zlib.error, struct.error)):
            media.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    for bad in (png[:-4], png + b"x", b""):
        with pytest.raises((ValueError, struct.error)):
            media.decode_png(bad)


def test_near_images_have_near_hashes():
    text = ("the same text over and over, " * 200).encode()[: 192 * 30]  # padding would be the strongest edge of both
    bits = lambda raw: int(media.cosine_hash(np.frombuffer(raw, np.uint8).reshape(-1, 192)), 16)
    a, b, c = bits(text), bits(text[:900] + b"X" + text[901:]), bits(bytes(random.Random(3).randrange(256) for _ in range(192 * 30)))
    assert (a ^ b).bit_count() <= 10 < (a ^ c).bit_count()


def test_hash_equals_the_definition():
    """Means of a 32 x 32 grid, the discrete cosine transform summed term by term, and the median of the low frequencies."""
    rng = np.random.default_rng(5)
    for rows in (1, 7, media.SIDE, 45, 200):
        samples = rng.integers(0, 256, (rows, 192), np.uint8)
        cuts = [k * rows // media.SIDE for k in range(media.SIDE)]
        ends = [*cuts[1:], rows]
        wide = 192 // media.SIDE
        grid = [[float(np.mean([float(v) for y in range(a, max(b, a + 1)) for v in samples[y, x * wide : (x + 1) * wide]])) for x in range(media.SIDE)] for a, b in zip(cuts, ends)]
        cosine = lambda k, n: np.cos(np.pi * k * (2 * n + 1) / (2 * media.SIDE))
        low = [round(sum(cosine(u, y) * cosine(v, x) * grid[y][x] for y in range(media.SIDE) for x in range(media.SIDE)), 6) for u in range(media.LOW) for v in range(media.LOW)]
        middle = float(np.median(low[1:]))
        wanted = sum(1 << (63 - k) for k, c in enumerate(low) if c > middle)
        assert media.cosine_hash(samples) == f"{wanted:016x}"
