"""Fingerprints, the bit-sliced kernel, and links against brute force."""

import random

import numpy as np
import pytest
import xxhash

from spanloom.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(p) for p in zip(words, words[1:])] if len(words) > 1 else words
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def near_prints(rng, groups, each, flips):
    out = []
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(each):
            x = base
            for b in rng.sample(range(64), rng.randint(0, flips)):
                x ^= 1 << b
            out.append(x)
    return np.array(out, np.uint64)


def brute(ids, prints, radius):
    n, parent = {}, {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in zip(ids, prints):
        near = np.flatnonzero(np.bitwise_count(prints ^ p) <= radius)
        n[i] = len(near) - 1
        for j in near:
            a, b = find(i), find(ids[j])
            parent[max(a, b)] = min(a, b)
    return {i: (n[i], find(i)) for i in ids}


def test_fingerprints():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 4, 50, 255, 256, 257, 600, 1300]:
        text = " \n\t".join(rng.choice(["The", "a", "é", "wörd", "x1"]) + str(rng.randint(0, 30)) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("radius", range(7))
def test_kernel(radius):
    v = near_prints(random.Random(radius), 12, 20, 9)
    left, right = simhash.near(v, simhash.planes_of(v), len(v), radius)
    wanted = np.argwhere(np.bitwise_count(v[:, None] ^ v[None, :]) <= radius)
    assert sorted(zip(left.tolist(), right.tolist())) == sorted(map(tuple, wanted.tolist()))


@pytest.mark.parametrize("tile,wanted", [(8192, 1024), (16, 1024), (8192, 4), (8192, 0.001)])
def test_links(spark, monkeypatch, tile, wanted):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "WANTED", wanted)
    v = near_prints(random.Random(9), 10, 30, 8)
    rows = [(i, int(x)) for i, x in enumerate(v.view(np.int64))]
    frame = spark.createDataFrame(rows, "doc_id long, fp long")
    linked = frame.join(simhash.link(frame), "fp").collect()
    assert {r.doc_id: (r.n_near, r.component_id) for r in linked} == brute([r[0] for r in rows], v, 6)


def test_documents(spark):
    rows = [(1, "a b c d"), (2, "A B C D"), (3, None), (4, ""), (5, " \n"), (6, "one"), (None, "a b c d"), (7, "x y " * 20_000)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    assert all(int(r.fingerprint, 16) == plain_fingerprint(dict(rows)[i]) and len(r.fingerprint) == 16 for i, r in got.items())
    assert (got[1].n_near, got[1].component_id, got[2].component_id) == (1, 1, 1)
    assert (got[3].n_near, got[5].component_id) == (2, 3)
    assert got[None].n_near is None and got[None].component_id is None
    twice = spark.createDataFrame([(1, "p q r"), (1, "p q r")], "doc_id long, text string")
    assert [(r.n_near, r.component_id) for r in simhash.near_duplicates(twice).collect()] == [(1, 1), (1, 1)]
    assert simhash.near_duplicates(docs.where("false")).count() == 0
