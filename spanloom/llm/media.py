"""PNG images in binary columns, with perceptual hashes.

Bytes become the samples of an 8-bit greyscale PNG: signature, IHDR, IDAT
chunks holding one zlib stream, IEND. Reading checks the signature, each
chunk's CRC, the order and presence of chunks, the header and the length of the
inflated stream, then undoes the five row filters on numpy arrays. The hash is
the sign pattern of the 8x8 lowest-frequency cosine-transform coefficients of
the picture shrunk to 32x32 cells, against their median.

Defined cases: a null or empty text is one row of zero samples. A damaged file
raises ``ValueError`` in ``read_png``; the column operator ``decode`` gives null
samples and the message instead. Equal bytes give equal files and hashes. Rows
are independent and other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Bytes of an IDAT chunk at most, zlib level, and rows that are inflated and unfiltered at a time.
CHUNK, LEVEL = 1 << 16, 1
SIDE, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filter_rows(pixels: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Each row under its filter, preceded by the filter's number."""
    x = pixels.astype(np.int16)
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:], corner[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    out = np.empty((len(x), x.shape[1] + 1), np.uint8)
    out[:, 0] = kinds
    for kind in np.unique(kinds):
        r = kinds == kind
        if kind == 0:
            guess = 0
        elif kind == 1:
            guess = left[r]
        elif kind == 2:
            guess = up[r]
        elif kind == 3:
            guess = (left[r] + up[r]) >> 1
        else:
            guess = _paeth(left[r], up[r], corner[r])
        out[r, 1:] = (x[r] - guess).astype(np.uint8)
    return out


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def unfilter_rows(filtered: np.ndarray) -> np.ndarray:
    """Undo filters 0 to 4. Runs of rows of filter 0, 1 or 2 are done at once; 3 and 4 go along each row."""
    kinds, out = filtered[:, 0], filtered[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown row filter")
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [len(kinds)]])
    for low, high in zip(bounds[:-1], bounds[1:]):
        if low == high or (kind := kinds[low]) == 0:
            continue
        if kind == 1:
            out[low:high] = np.cumsum(out[low:high], axis=1, dtype=np.uint8)
        elif kind == 2:
            if low:
                out[low] += out[low - 1]
            out[low:high] = np.cumsum(out[low:high], axis=0, dtype=np.uint8)
        else:
            for y in range(low, high):
                up = out[y - 1].tolist() if y else [0] * out.shape[1]
                row, a, c = out[y].tolist(), 0, 0
                for x, b in enumerate(up):
                    if kind == 3:
                        guess = (a + b) >> 1
                    else:
                        p = a + b - c
                        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                        guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                    a, c = (row[x] + guess) & 255, b
                    row[x] = a
                out[y] = row
    return out


def choose_filters(pixels: np.ndarray) -> np.ndarray:
    """Per row, of None, Sub and Up the one with the least sum of absolute signed differences."""
    x = pixels.astype(np.int16)
    sub, up = x.copy(), x.copy()
    sub[:, 1:] -= x[:, :-1]
    up[1:] -= x[:-1]
    cost = [np.abs(d.astype(np.int8).astype(np.int16)).sum(axis=1) for d in (x, sub, up)]
    return np.argmin(cost, axis=0).astype(np.uint8)


def write_png(samples: bytes, width: int = WIDTH, kinds: np.ndarray | None = None) -> bytes:
    """The samples, a positive multiple of ``width``, as a greyscale PNG."""
    pixels = np.frombuffer(samples, np.uint8).reshape(-1, width)
    packed = zlib.compress(filter_rows(pixels, choose_filters(pixels) if kinds is None else kinds).tobytes(), LEVEL)
    header = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(pixels), 8, 0, 0, 0, 0))
    body = [_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)]
    return b"".join([SIGNATURE, header, *body, _chunk(b"IEND", b"")])


def read_png(data: bytes) -> np.ndarray:
    """Samples (height x width, uint8) of an 8-bit greyscale PNG without interlacing; ValueError if it is damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG signature")
    at, shape, ended, seen_other = 8, None, False, False
    stream: list[bytes] = []
    while not ended:
        if at + 12 > len(data):
            raise ValueError("cut off")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(data[at + 4 : at + 8 + n]):
            raise ValueError("wrong chunk checksum or length")
        at += 12 + n
        if (shape is None) != (kind == b"IHDR"):
            raise ValueError("IHDR must come first and once")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("wrong header")
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0] or not width or not height:
                raise ValueError("only 8-bit greyscale without interlacing is read")
            shape = (height, width)
        elif kind == b"IDAT":
            if seen_other:
                raise ValueError("IDAT chunks must be consecutive")
            stream.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError("unknown critical chunk")
        else:
            seen_other = bool(stream)
    if at != len(data):
        raise ValueError("bytes after IEND")
    size = shape[0] * (shape[1] + 1)
    inflater = zlib.decompressobj()
    try:
        raw = inflater.decompress(b"".join(stream), size + 1)
    except zlib.error as e:
        raise ValueError(f"zlib: {e}") from None
    if len(raw) != size or not inflater.eof or inflater.unused_data:
        raise ValueError("wrong length of the inflated stream")
    return unfilter_rows(np.frombuffer(raw, np.uint8).reshape(shape[0], shape[1] + 1))


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(k)[:, None] / (2 * n))


def _cells(n: int) -> np.ndarray:
    """Bounds of SIDE cells over n samples; a cell has one sample at least."""
    low = np.arange(SIDE) * n // SIDE
    return low, np.maximum(low + 1, (np.arange(SIDE) + 1) * n // SIDE)


_BASIS = _cosines(SIDE, LOW)


def shrink(pixels: np.ndarray) -> np.ndarray:
    """Means of SIDE x SIDE cells, from two running sums."""
    for axis in (0, 1):
        low, high = _cells(pixels.shape[axis])
        total = np.cumsum(pixels, axis=axis, dtype=np.float64)
        total = np.concatenate([np.zeros_like(total.take([0], axis)), total], axis=axis)
        width = (high - low).reshape((-1, 1) if axis == 0 else (1, -1))
        pixels = (total.take(high, axis) - total.take(low, axis)) / width
    return pixels


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the 8x8 lowest coefficients lie above the median of those without the constant."""
    low = np.round(_BASIS @ shrink(pixels) @ _BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(text: bytes | None) -> bytes:
    """The text's bytes with zeros up to a positive multiple of the row width."""
    text = text or b""
    return text.ljust(max(WIDTH, -(-len(text) // WIDTH) * WIDTH), b"\0")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, media (binary PNG), media_hash (binary, 8 bytes)."""

    def setup():
        def work(texts):
            media = [write_png(payload_of(t)) for t in texts]
            return [[len(t or b"") for t in texts], media, [cosine_hash(read_png(m)) for m in media]]

        return work

    return map_texts(docs, id_col, text_col, "n_bytes long, media binary, media_hash binary", setup)


def decode(images: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Per row: id, width, height, samples (binary), error. Null or damaged media give null samples and a message."""

    def one(data):
        try:
            if data is None:
                raise ValueError("null")
            pixels = read_png(data)
            return pixels.shape[1], pixels.shape[0], pixels.tobytes(), None
        except ValueError as e:
            return None, None, None, str(e)

    return map_texts(
        images, id_col, media_col, "width int, height int, samples binary, error string",
        lambda: lambda media: [list(c) for c in zip(*map(one, media))] or [[], [], [], []],
    )


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, read back and describe every text; only digests leave the worker."""

    def one(text):
        media = write_png(payload_of(text))
        pixels = read_png(media)
        back = pixels.tobytes()
        return (
            len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]),
            len(media), hashlib.sha256(media).hexdigest(), cosine_hash(pixels).hex(),
        )

    return map_texts(
        docs, id_col, text_col,
        "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
        lambda: lambda texts: [list(c) for c in zip(*map(one, texts))] or [[]] * 7,
    )


def op5(spark, sf_dir) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
