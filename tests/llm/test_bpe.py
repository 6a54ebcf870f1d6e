"""BPE against tiktoken, and round trips."""

import random

import numpy as np
import pytest
import tiktoken

from spanloom.llm import bpe


@pytest.fixture(scope="module")
def both():
    file, pattern = bpe.default_files()
    own = bpe.load(file, pattern)
    return own, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    out = ["", " ", "\n\n", "a", "I'll don't <|endoftext|>", "x" * 5000, "ab" * 900, "é" * 700, "😀" * 50, " " * 3000, "日本語のテキスト", "1234567 89"]
    out += ["".join(rng.choice("the ing\n éßñ,.!12") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    return out


def test_same_ids_as_the_library(both):
    own, library = both
    for text, packed in zip(texts(), own.encode_batch([t.encode() for t in texts()])):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(packed) == text.encode()


def test_long_and_short_ways_agree(both):
    own, _ = both
    rng = random.Random(4)
    pieces = ["".join(rng.choice("theinrsdo") for _ in range(n)).encode() for n in (1, 2, 3, 50, 700, 1024)]
    for p, ids in zip(pieces, own.encode_matrix(pieces)):
        assert ids.tolist() == own.encode_long(p).tolist()


def test_small_cache_changes_nothing(both, monkeypatch):
    own, _ = both
    data = [t.encode() for t in texts()]
    before = own.encode_batch(data)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    assert own.encode_batch(data) == before


def test_frames(spark, both):
    own, library = both
    rows = [(i, t, "n") for i, t in enumerate(texts())] + [(None, "null id", "n"), (995, "twice", "n"), (995, "twice", "n"), (999, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    files = bpe.default_files()
    encoded = bpe.encode(docs, *files)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"] and encoded.count() == len(rows)
    decoded = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(encoded, *files).collect()}
    assert all(decoded[i] == (t or "") for i, t, _ in rows)
    trip = {r.doc_id: r for r in bpe.round_trip(docs, *files).collect()}
    assert trip[999].n_tokens == 0 and trip[995].n_tokens == len(library.encode_ordinary("twice"))
    assert bpe.round_trip(docs.where("false"), *files).count() == 0
