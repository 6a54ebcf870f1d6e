"""Exact spans on the ten-sentence corpus and on small sentences."""

import pytest

from spanloom.engine import Engine
from spanloom.operators import results
from spanloom.sources import fixture

GOLDEN = {
    "[pos=VBZ] >nsubj [pos=NNP]": "simple 0 2, clausal 0 2, clausal 2 4",
    "[lemma=chase] >nsubj [pos=NN] >amod [pos=JJ]": "chase 1 4",
    "[lemma=chase] >nsubj [pos=NN] <amod [pos=JJ]": "",
    "[lemma=sleep] >prep [word=on] >pobj [word=mat]": "prep_chain 2 7",
    "[word=believes] >ccomp [word=knows] >dobj [word=truth]": "clausal 1 6",
    "[word=left] >advcl [word=arrived] >nsubj [word=Mary]": "adverbial 1 5",
    "[pos=NNS] >relcl [pos=VBP] >prep [word=at] >pobj [entity=B-ORG]": "relative 0 5",
    "[word=John] >> []": "coordination 0 2, coordination 0 3",
    "[word=Mary] << []": "ditransitive 1 3, coordination 0 3, clausal 2 4, adverbial 3 5",
    "[word=pizza] <dobj|nsubjpass []": "simple 1 3, coordination 3 5, passive 1 4",
    "[pos=/N.*/] <nsubj [pos=/V.*/] >dobj [pos=/N.*/]": "simple 0 3, chase 2 7, ditransitive 0 6, relative 0 7, coordination 0 5, nested_np 1 9, clausal 2 6",
    "([pos=/N.*/]) <nsubj ([pos=/V.*/]) >dobj ([pos=/N.*/])": "simple 0 3, chase 2 7, ditransitive 0 6, relative 0 7, coordination 0 5, nested_np 1 9, clausal 2 6",
    "[pos=JJ] [pos=NN]": "chase 1 3, chase 5 7, ditransitive 4 6, prep_chain 5 7",
    "[pos=DT]? [pos=JJ]* [pos=NN]+": "simple 2 3, chase 0 3, chase 4 7, ditransitive 3 6, prep_chain 0 2, prep_chain 4 7, prep_chain 8 10, coordination 4 5, coordination 6 7, passive 0 2, nested_np 0 2, nested_np 7 9, clausal 4 6",
    "[pos=DT] []*? [pos=NN]": "chase 0 3, chase 4 7, ditransitive 3 6, prep_chain 0 2, prep_chain 4 7, prep_chain 8 10, passive 0 2, nested_np 0 2, nested_np 3 9, nested_np 7 9, clausal 4 6",
    "[word=John] []* [word=Mary]": "ditransitive 0 3, coordination 0 3, clausal 0 3, adverbial 0 4",
    "[pos=NNP] (?= [pos=VBZ])": "simple 0 1, clausal 0 1, clausal 2 3",
    "(?<= [pos=DT]) [pos=NN]": "prep_chain 1 2, prep_chain 9 10, passive 1 2, nested_np 1 2, nested_np 8 9, clausal 5 6",
    "[word=/.*s/]": "simple 1 2, prep_chain 2 3, relative 0 1, relative 6 7, passive 2 3, nested_np 5 6, clausal 1 2, clausal 3 4",
    "[word=pizza~]": "simple 2 3, coordination 4 5, passive 1 2",
    "[entity=B-PERSON & pos=NNP]": "simple 0 1, ditransitive 0 1, ditransitive 2 3, coordination 0 1, coordination 2 3, passive 5 6, clausal 0 1, clausal 2 3, adverbial 0 1, adverbial 3 4",
    "[lemma=chase] >nsubj>det []": "chase 0 4",
    "[lemma=chase] >nsubj? [pos=/V.*|NN/]": "chase 2 4, chase 3 4",
    "[lemma=sleep] >>* [word=corner]": "prep_chain 2 10",
    "[lemma=sleep] >>+ [lemma=sleep]": "",
    "[word=Mary] [word=love] >dobj [word=pizza] [word=and]": "coordination 2 6",
    "John": "simple 0 1, ditransitive 0 1, coordination 0 1, passive 5 6, clausal 0 1, adverbial 0 1",
    "[pos=VBZ] (?! [pos=NN])": "prep_chain 2 3, clausal 1 2, clausal 3 4",
    "(?<! [pos=DT]) [pos=NN]": "simple 2 3, chase 2 3, chase 6 7, ditransitive 5 6, prep_chain 6 7, coordination 4 5, coordination 6 7",
    "([word=John] | [word=Mary]) ([pos=VBZ] | [pos=VBD])": "simple 0 2, ditransitive 0 2, clausal 0 2, clausal 2 4, adverbial 0 2, adverbial 3 5",
    "[tag=VBZ & !lemma=eat]": "prep_chain 2 3, clausal 1 2, clausal 3 4",
    "[word=eats] >nsubj [] | [word=gave] >iobj []": "simple 0 2, ditransitive 1 3",
}


def spans(hits):
    rows = results.match_rows(hits).select("doc_id", "start", "end").collect()
    return sorted((r.doc_id.removeprefix("doc_"), r.start, r.end) for r in rows)


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(fixture.sentences(spark).cache(), ["word", "pos"])


@pytest.mark.parametrize("query", GOLDEN)
def test_spans(engine, query):
    wanted = sorted((a, int(b), int(c)) for a, b, c in (x.split() for x in GOLDEN[query].split(", ") if x))
    assert spans(engine.hits(query)) == wanted


def small(spark, words, **layers):
    row = {"doc_id": "d", "sentence_id": "d_0", "sentence_idx": 0, "sentence_length": len(words), "word": words, **layers}
    kinds = ", ".join(["doc_id string, sentence_id string, sentence_idx int, sentence_length long, word array<string>", *(f"{k} array<string>" for k in layers)])
    return Engine(spark.createDataFrame([tuple(row.values())], kinds))


def test_greedy_and_lazy_gaps(spark):
    e = small(spark, list("abcabc"))
    assert spans(e.hits("a []* c")) == [("d", 0, 6)]
    assert spans(e.hits("a []*? c")) == [("d", 0, 3), ("d", 3, 6)]
    assert spans(e.hits("a []* c", overlap="per_start")) == [("d", 0, 6), ("d", 3, 6)]
    assert spans(e.hits("a []{,1} c")) == [("d", 0, 3), ("d", 3, 6)]
    assert spans(e.hits("a []{4}? c")) == [("d", 0, 6)]


def test_captures(spark):
    e = small(spark, list("abcabc"))
    rows = results.capture_rows(e.hits("(?<x> a) []*? (?<y> b (?<z> c))")).collect()
    assert sorted((r.match_start, r.name, r.start, r.end) for r in rows) == [(0, "x", 0, 1), (0, "y", 1, 3), (0, "z", 2, 3), (3, "x", 3, 4), (3, "y", 4, 6), (3, "z", 5, 6)]
    rows = results.capture_rows(e.hits("((?<l> a) | (?<r> b)) []")).collect()
    assert sorted((r.match_start, r.name) for r in rows) == [(0, "l"), (1, "r"), (3, "l"), (4, "r")]
    rows = results.capture_rows(e.hits("((?<last> [])){3}", overlap="per_start")).collect()
    assert sorted((r.match_start, r.start) for r in rows) == [(0, 2), (1, 3), (2, 4), (3, 5)]


def test_graph_captures(engine):
    rows = results.capture_rows(engine.hits("(?<s> [pos=NNP]) <nsubj [lemma=eat] >dobj (?<o> [pos=NN])")).collect()
    assert sorted((r.name, r.start, r.end) for r in rows) == [("c0", 0, 1), ("c1", 1, 2), ("c2", 2, 3), ("o", 2, 3), ("s", 0, 1)]


def test_missing_layers_nulls_and_empty(spark):
    frame = spark.createDataFrame(
        [("d", "d_0", 0, 2, ["a", None], None), ("d", "d_1", 1, 0, [], []), ("e", "e_0", 0, 2, ["a", "b"], ["X", "Y"])],
        "doc_id string, sentence_id string, sentence_idx int, sentence_length long, word array<string>, tag array<string>",
    )
    e = Engine(frame)
    assert spans(e.hits("[tag!=X]")) == [("d", 0, 1), ("d", 1, 2), ("e", 1, 2)]
    assert spans(e.hits("[!word=a]")) == [("d", 1, 2), ("e", 1, 2)]
    assert spans(e.hits("[] (?! [])")) == [("d", 1, 2), ("e", 1, 2)]
    assert spans(e.hits("[tag=Y]?")) == [("e", 1, 2)]
    with pytest.raises(ValueError):
        e.hits("[lemma=x]")
    with pytest.raises(ValueError):
        e.hits("a >x b")


def test_bare_assertions(engine):
    held = engine.hits("(?= [word=pizza])").select("doc_id", "score", "matches").collect()
    assert sorted(r.doc_id for r in held) == ["doc_coordination", "doc_passive", "doc_simple"]
    assert all(r.score == 1.0 and r.matches == [] for r in held)
    assert engine.hits("(?! [word=pizza])").count() == 10


def test_many_constraints_use_wide_symbols(spark):
    e = small(spark, list("abcdefgh"))
    assert spans(e.hits("a b c d e f (?<x> g) h")) == [("d", 0, 8)]
    with pytest.raises(ValueError):
        e.hits(" ".join(f"w{i}" for i in range(15)))


def test_no_python_and_no_shuffle(engine):
    for query in ("[pos=DT]? [pos=JJ]* [pos=NN]+", "[pos=/N.*/] <nsubj [pos=/V.*/] >dobj [pos=/N.*/]"):
        plan = engine.hits(query)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan
        assert "Exchange" not in plan.split("InMemoryRelation")[0]
