"""Targets by plain water filling, quotas by plain Sainte-Lague, and the mix as a whole."""

import random

from pyspark.sql import functions as F

from spanloom.llm import mixing


def water(sizes):
    """Targets as the text of the contract says it: reshare the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def frame(spark, seed=1, n=400):
    rng = random.Random(seed)
    names = ["src0", "src1", "a", "ü", "B", None, "tiny"]
    rows = []
    for i in range(n):
        s = "src0" if rng.random() < 0.4 else rng.choice(names[:-1])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 80, 400])), s, 3))
    rows += [(n, "one two", "tiny", 1), (n + 1, None, "src1", 0), (n + 2, "", "empty", 0), (None, "a b", "src1", 0), (5, "again", "src1", 0), (5, "again", "src1", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")


def test_mix(spark):
    docs = frame(spark)
    got = mixing.mix(docs, shard_rows=50).collect()
    assert len(got) == docs.count()
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and 0 <= r.copies <= 2
    wanted = water(sizes)
    for s in sizes:
        assert abs(target[s] - wanted[s]) < 1e-6 * max(1, wanted[s])
        assert abs(taken[s] - target[s]) <= max(12, 0.02 * target[s]), s
    assert all(r.source_size == sizes[r.source] for r in got)


def test_tiny_sources_beside_a_large_one(spark):
    """The large source makes the mean target over 2.05M words, so that blocks of 2,048 words are in force."""
    tiny = {"t0300": 300, "t0500": 500, "t1000": 1000, "t1400": 1400, "t2500": 2500, "t5000": 5000}
    rows = [(1000 * k + i, " ".join(["w"] * 20), s) for k, (s, n) in enumerate(tiny.items()) for i in range(n // 20)]
    large = spark.range(10_000, 10_240).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 50_000).alias("text"), F.lit("big").alias("source"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(large)
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 7 and sum(r.target for r in got) / 7 > 2048 * mixing.SOURCE_BLOCKS
    for r in got:
        assert abs(r.taken - r.target) <= max(2, 0.005 * r.target), r


def test_reruns_agree(spark):
    docs = frame(spark, 2)
    key = lambda df: sorted((str(r.doc_id), r.size, r.taken, r.copies) for r in df.collect())
    assert key(mixing.mix(docs)) == key(mixing.mix(docs.repartition(7)))


def plain_quotas(votes, seats):
    out = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


def test_quotas_are_the_highest_quotients(spark):
    rng = random.Random(3)
    rows, wanted = [], {}
    for g in range(40):
        votes = [rng.choice([0, 1, 7, 100, rng.randint(1, 10_000)]) for _ in range(rng.randint(1, 8))]
        seats = rng.choice([0, 1, 3, 50, 500])
        for i, q in enumerate(plain_quotas(votes, seats) if sum(votes) else [0] * len(votes)):
            rows.append((g, i, votes[i], seats))
            wanted[g, i] = q
    parties = spark.createDataFrame(rows, "g long, i long, votes long, seats long")
    got = mixing._quotas(parties, "votes", "seats", ["g"], [F.col("i")], ["g", "i"], None).collect()
    assert {(r.g, r.i): r.quota for r in got} == wanted


def test_empty_table(spark):
    assert mixing.mix(frame(spark).where("false")).count() == 0


def test_native_plan(spark):
    plan = mixing.mix(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
