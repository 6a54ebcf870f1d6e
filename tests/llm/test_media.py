"""PNG round trips, damage, and hashes."""

import zlib

import numpy as np
import pytest

from spanloom.llm import media


def test_all_filters_round_trip():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (60, 64), dtype=np.uint8)
    for kinds in (rng.integers(0, 5, 60).astype(np.uint8), *[np.full(60, k, np.uint8) for k in range(5)]):
        assert (media.read_png(media.write_png(pixels.tobytes(), 64, kinds)) == pixels).all()


def test_damage_is_found():
    good = media.write_png(media.payload_of(b"some text" * 50))
    cases = [b"", b"x" + good[1:], good[:-5], good + b"x", good[:40] + bytes([good[40] ^ 1]) + good[41:]]
    header = media._chunk(b"IHDR", b"\0\0\0\x40\0\0\0\x01\x08\0\0\0\0")
    cases.append(media.SIGNATURE + header + media._chunk(b"IDAT", zlib.compress(b"\0" * 10)) + media._chunk(b"IEND", b""))
    cases.append(media.SIGNATURE + header + media._chunk(b"IDAT", zlib.compress(b"\7" + b"\0" * 64)) + media._chunk(b"IEND", b""))
    cases.append(media.SIGNATURE + header + header + media._chunk(b"IEND", b""))
    for data in cases:
        with pytest.raises(ValueError):
            media.read_png(data)


def test_other_readers_read_it():
    image = pytest.importorskip("PIL.Image")
    import io

    payload = media.payload_of(b"hello" * 100)
    assert image.open(io.BytesIO(media.write_png(payload))).tobytes() == payload


def test_hash_is_of_low_frequencies():
    rng = np.random.default_rng(2)
    waves = media._cosines(64, 8)
    picture = waves.T @ rng.normal(size=(8, 8)) @ waves
    smooth = (127 + 120 * picture / np.abs(picture).max()).astype(np.uint8)
    noisy = np.clip(smooth.astype(int) + rng.integers(-2, 3, (64, 64)), 0, 255).astype(np.uint8)
    count = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(a, b))
    assert count(media.cosine_hash(smooth), media.cosine_hash(noisy)) <= 6
    assert count(media.cosine_hash(smooth), media.cosine_hash(rng.integers(0, 256, (64, 64), dtype=np.uint8))) > 12


def test_frames(spark):
    rows = [(1, "a", "m"), (2, "a", "m"), (3, None, "m"), (4, "", "m"), (5, "é" * 40_000, "m"), (None, "x", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    encoded = media.encode(docs)
    back = {r.doc_id: r for r in media.decode(encoded).collect()}
    assert bytes(back[5].samples).rstrip(b"\0").decode() == "é" * 40_000 and back[5].error is None
    assert bytes(back[3].samples) == bytes(64) == bytes(back[4].samples)
    broken = spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")
    assert all(r.samples is None and r.error for r in media.decode(broken).collect())
    d = {r.doc_id: r for r in media.digest(docs).collect()}
    assert d[1].asDict() | {"doc_id": 2} == d[2].asDict()
    assert (d[4].n_bytes, d[4].payload_bytes, d[4].tail_crc32) == (0, 64, zlib.crc32(bytes(64)))
    assert media.digest(docs.where("false")).count() == 0
