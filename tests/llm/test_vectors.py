"""Vector links against brute force, with grids, tiles and odd rows."""

import math

import numpy as np
import pytest

from spanloom.llm import vectors


def brute(rows, cosine=0.93):
    ok = [r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = [0] * len(rows)
    for i, r in enumerate(rows):
        for j, s in enumerate(rows):
            if i != j and ok[i] and ok[j] and r[2] == s[2] and len(r[1]) == len(s[1]):
                a, b = np.array(r[1]), np.array(s[1])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    n[i] += 1
                    p, q = find(r[0]), find(s[0])
                    parent[max(p, q)] = min(p, q)
    return sorted((r[0], k, find(r[0])) for r, k in zip(rows, n) if r[0] is not None)


def rows_of(spread):
    rng = np.random.default_rng(3)
    base = np.repeat(rng.normal(size=(70, 16)) * spread, 4, axis=0)
    base += rng.normal(size=base.shape) * 0.08
    rows = [(i, np.float32(v).astype(float).tolist(), i % 3 if i % 25 else None) for i, v in enumerate(base)]
    rows += [(900, [0.0] * 16, 1), (901, None, 1), (902, [1.0] * 15 + [None], 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] * 16, 1), (905, [], 1)]
    rows += [(906, rows[1][1], 1), (907, rows[1][1], 1), (908, [2 * x for x in rows[1][1]], 1), (909, [1.0, 2.0], 1), (910, [2.0, 4.0], 1), (911, [-0.0, 1.0], 2), (912, [0.0, 1.0], 2)]
    return rows


@pytest.mark.parametrize("spread,tile", [(np.ones(16), None), (np.ones(16), 20), (np.array([3.0] * 2 + [0.05] * 14), None), (np.array([3.0] * 2 + [0.05] * 14), 20)])
def test_links(spark, spread, tile):
    rows = rows_of(spread)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = vectors.near_duplicates(frame, tile=tile).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_null_ids_and_empty(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in vectors.near_duplicates(frame).collect())
    assert got == [(0, 0, 0, True), (3, 1, 3, True), (3, 1, 3, True)]
    assert vectors.near_duplicates(frame.where("false")).count() == 0


def test_grids_are_used():
    rng = np.random.default_rng(1)
    flat = rng.normal(size=(500, 64)) * np.array([1.0] * 3 + [0.02] * 61)
    plan = vectors.Plan(flat / np.linalg.norm(flat, axis=1, keepdims=True), 0.93, 4)
    assert plan.grids and len(plan.grids) + len(plan.open) == 4
    assert abs(sum(plan.budgets) - 0.14) < 1e-6
