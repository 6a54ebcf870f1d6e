"""Steps of queries that must not grow faster than a sentence, or be done more than once."""

import random
import time

from pyspark.sql import functions as F

from spanloom.engine import Engine
from spanloom.operators import closure, results
from spanloom.plans import catalog
from spanloom.sources import adapters, views

DEPS = "array<struct<src:int,dst:int,label:string>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def long_sentence(spark, words, deps=()):
    row = ("d", "d_0", 0, len(words), words, list(deps))
    return Engine(spark.createDataFrame([row], f"doc_id string, sentence_id string, sentence_idx int, sentence_length long, word array<string>, deps {DEPS}"))


def captured(hits):
    return sorted((r.match_start, r.name, r.start, r.end) for r in results.capture_rows(hits).collect())


def test_captured_token_of_a_path_is_a_place(spark):
    """graph_captures: a captured token needs no scan of the sentence's rest for each token."""
    e = long_sentence(spark, list("abab"), [(0, 1, "x"), (2, 3, "x"), (2, 1, "y")])
    hits = e.hits("(?<o> (?<h> a)) >x (?<t> b)")
    assert "regexp" not in plan(hits)
    assert captured(hits) == [(s, n, s + k, s + k + 1) for s in (0, 2) for n, k in (("c0", 0), ("c1", 1), ("h", 0), ("o", 0), ("t", 1))]


def test_chained_steps_compute_each_step_once(spark):
    """graph_concat: the second step's pairs, and the places it begins at, were computed for every edge."""
    n = 1200
    chain = [(i, i + 1, "xy"[i % 2]) for i in range(n - 1)]
    began = time.time()
    found = results.match_rows(long_sentence(spark, ["a"] * n, chain).hits("a >x>y a")).count()
    assert found == (n - 1) // 2 and time.time() - began < 60


def test_captures_do_not_copy_the_rest_of_the_sentence(spark):
    """capture_single and all captures outside repetitions."""
    e = long_sentence(spark, list("abcabdb"))
    for query, wanted in {
        "(?<v> (?<w> a))": [(0, "v", 0, 1), (0, "w", 0, 1), (3, "v", 3, 4), (3, "w", 3, 4)],
        "a (?<x> b) (?<y> c)": [(0, "x", 1, 2), (0, "y", 2, 3)],
        "a []*? (?<y> [word=c | word=d])": [(0, "y", 2, 3), (3, "y", 5, 6)],
        "(?<x> a b?) (?<y> c | d b) ": [(0, "x", 0, 2), (0, "y", 2, 3), (3, "x", 3, 5), (3, "y", 5, 7)],
        "(a (?<p> b) | (?<q> b) (?<r> c?)) (?<z> [])": [(0, "p", 1, 2), (0, "z", 2, 3), (1, "q", 1, 2), (1, "r", 2, 3), (1, "z", 3, 4), (3, "p", 4, 5), (3, "z", 5, 6), (4, "q", 4, 5), (4, "z", 5, 6)],
        "(?<= (?<h> a)) b (?= (?<k> []))": [(1, "h", 0, 1), (1, "k", 2, 3), (4, "h", 3, 4), (4, "k", 5, 6)],
    }.items():
        hits = e.hits(query, "per_start")
        assert captured(hits) == wanted, query
        assert ("[\\s\\S]*" in plan(hits)) == ("?<=" in query), query


def test_many_greedy_matches_of_a_long_sentence(spark):
    """seq_noun_phrase, seq_rep_plus: each span was held against all spans kept before."""
    n = 12_000
    began = time.time()
    found = results.match_rows(long_sentence(spark, ["a", "b"] * (n // 2)).hits("a+")).count()
    assert found == n // 2 and time.time() - began < 60


def test_longer_span_drops_several_kept(spark):
    e = long_sentence(spark, list("abcabcdefg"))
    spans = lambda q: sorted((r.start, r.end) for r in results.match_rows(e.hits(q)).collect())
    assert spans("(a b | b c | c [] [] [] []*)") == [(0, 2), (2, 10)]
    assert spans("(a b | b c | c a b) []{0,0}") == [(0, 2), (2, 5)]
    assert spans("(a b | b c) []{0,0}") == [(0, 2), (1, 3), (3, 5), (4, 6)]


def test_derived_layers_are_computed_once_a_row(spark, tmp_path):
    """The tag was computed again for every test of a sentence."""
    spark.createDataFrame([(1, "The cat sings\nand Bob is running, 3 Gg !! éing")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    s = adapters.documents(spark, str(tmp_path))
    hits = Engine(s).hits("[tag=UP] >dep1 [tag=ING]")
    assert plan(hits).split("FileScan")[0].count("PUNCT") == 1
    assert [(r.tag, r.entity, r.lemma) for r in s.orderBy("sentence_idx").collect()] == [
        (["UP", "LOW", "LOW"], ["O"] * 3, ["the", "cat", "sings"]),
        (["LOW", "UP", "LOW", "ING", "CD", "UP", "PUNCT", "ING"], ["O", "B-CAP", "O", "O", "O", "B-CAP", "O", "O"], ["and", "bob", "is", "running", "3", "gg", "", "éing"]),
    ]
    assert s.orderBy("sentence_idx").collect()[1].deps[2] == (1, 3, "dep3")


def test_one_row_group_is_dealt_over_the_cores(spark, tmp_path):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.sha2(F.concat_ws("_", "doc_id", i), 256)))
    spark.range(64).select(F.col("id").alias("doc_id")).withColumn("text", text).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert adapters.documents(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 1


def test_searches_in_one_shuffle(spark):
    """graph_shortest, graph_has_path: each level was a job over all edges, which were made anew. Random graphs against plain search."""
    rng, graphs = random.Random(3), {}
    for g in range(30):
        n = rng.randint(1, 8)
        graphs[f"d{g}"] = n, [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 14))]
    key = "doc_id string, sentence_id string, sentence_idx int"
    tokens = spark.createDataFrame([(d, d, 0, p) for d, (n, _) in graphs.items() for p in range(n)], f"{key}, position int")
    edges = spark.createDataFrame([(d, d, 0, a, b) for d, (_, e) in graphs.items() for a, b in e], f"{key}, src int, dst int")
    wanted = {}
    for d, (n, e) in graphs.items():
        for s in range(n):
            level, paths = [s], {s: [s]}
            while level:
                steps = sorted((b, a) for a, b in e if a in level and b not in paths)
                fresh = {}
                for b, a in steps:
                    fresh.setdefault(b, paths[a] + [b])
                paths |= fresh
                level = list(fresh)
            wanted |= {(d, s, t): p for t, p in paths.items()}
    starts, targets = tokens.where("position % 2 = 0"), tokens.where("position > 1")
    got = {(r.doc_id, r.source, r.node): r.distance for r in closure.distances(starts, edges).collect()}
    assert got == {k: len(p) - 1 for k, p in wanted.items() if k[1] % 2 == 0}
    got = {(r.doc_id, r.source, r.node): r.path for r in closure.shortest_path(starts, targets, edges).collect()}
    assert got == {k: p for k, p in wanted.items() if k[1] % 2 == 0 and k[2] > 1}
    assert {(r.doc_id, r.source, r.node) for r in closure.has_path(starts, targets, edges).collect()} == set(got)
    got = {(r.doc_id, r.source, r.node) for r in closure.distances(starts, edges, 1).collect()}
    assert got == {k for k, p in wanted.items() if k[1] % 2 == 0 and len(p) <= 2}
    spark.sparkContext.setJobGroup("searches", "")
    closure.shortest_path(starts, targets, edges)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("searches")


def test_token_rows_read_the_layers_asked_for(spark, tmp_path):
    """rel_hop, rel_gap_lazy, rel_adjacent: rows of words alone computed every token's tag too, rows of tags carried the words."""
    spark.createDataFrame([(1, "the cat of the sea"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.QUERIES["rel_gap_lazy"](spark, str(tmp_path))
    assert "PUNCT" not in plan(rows) and "arrays_zip" not in plan(rows)
    assert [(r.match_start, r.match_end) for r in rows.collect()] == [(0, 3)]
    rows = views.tokens(adapters.documents(spark, str(tmp_path)), ["tag"])
    assert rows.columns == ["doc_id", "sentence_id", "sentence_idx", "position", "tag"] and rows.count() == 5
