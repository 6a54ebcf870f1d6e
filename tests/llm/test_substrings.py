"""Repeated windows against brute force, in any number of batches, and the index itself."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import substrings
from spanloom.llm.common import shared_path


def brute(rows, window):
    top = 2**63
    words = [(top if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, top), i)
    out = []
    for (i, w), (given, _) in zip(words, rows):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((given, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(words) for _ in range(rng.choice([13, 14, 60]))] for _ in range(5)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.choice([0, 5, 12, 13, 40, 400]))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        rows.append((i * 3, " \n\t"[rng.randint(0, 2)].join(w)))
    rows += [(10_000, rows[7][1]), (10_001, rows[7][1]), (10_002, None), (10_003, ""), (10_004, "é " * 30), (10_005, "same " * 50), (10_006, "same " * 50), (None, rows[8][1]), (6, rows[9][1]), (6, rows[9][1])]
    return rows


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    got = substrings.deduplicate(docs, "n_words long, n_removed long, kept_sha256 string", substrings._digest, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_against_brute_force(spark, batches):
    rows = corpus()
    assert run(spark, rows, batches=batches) == brute(rows, 13)


def test_other_window_and_empty(spark):
    rows = corpus(2, 20)
    assert run(spark, rows, batches=2, window=4) == brute(rows, 4)
    assert run(spark, rows[:1], batches=3) == brute(rows[:1], 13)
    assert substrings.kept_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_colliding_keys_are_told_apart():
    keys = np.array([5, 5, 5, 7, 7], np.uint64)
    checks = np.array([1, 2, 1, 3, 3], np.uint16)
    k, c, least, place = substrings._first_seen(keys, checks, np.array([9, 4, 8, 2, 3], np.int64))
    assert list(zip(k.tolist(), c.tolist(), least.tolist())) == [(5, 1, 8), (5, 2, 4), (7, 3, 2)]
    assert least[place].tolist() == [8, 4, 8, 2, 2]
    assert substrings._held(k, c, (np.array([5, 5, 7], np.uint64), np.array([0, 2, 9], np.uint16))).tolist() == [False, True, False]


def test_runs_are_immutable_and_compacted(spark):
    index = substrings.FingerprintIndex(spark, shared_path(spark, "index"), 4, fan_in=2)
    rows = corpus(3, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").where("doc_id is not null")
    levels = []
    for k, (low, high) in enumerate([(0, 30), (30, 60), (60, 90), (90, 99_999)]):
        batch = docs.where((F.col("doc_id") >= low) & (F.col("doc_id") < high))
        index.add(batch, "doc_id", "text", 2, "n long", lambda w, gone: (int(gone.sum()),)).count()
        levels.append([r[:3] for r in index.runs()])
    assert levels == [[(0, 0, 0)], [(0, 0, 0), (0, 1, 1)], [(1, 0, 1), (0, 2, 2)], [(1, 0, 1), (0, 2, 2), (0, 3, 3)]]
    index.compact()
    assert [r[:3] for r in index.runs()] == [(2, 0, 3)]
    assert substrings.FingerprintIndex(spark, index.path, 4).runs() == index.runs()


def test_packing():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (substrings.unpack_sorted(substrings.pack_sorted(keys)) == keys).all()
    assert len(substrings.unpack_sorted(substrings.pack_sorted(keys[:0]))) == 0
