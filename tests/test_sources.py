"""Reading, validating and storing corpora."""

import gzip
import json

import pytest

from spanloom import functions as S
from spanloom.engine import Engine
from spanloom.operators import results
from spanloom.sources import fixture, reader, views
from spanloom.sources.schema import SchemaConfig, SchemaError, validate_schema

YAML = """
# comment
output_fields:
  - "word"
  - lemma

fields:
  - name: "word"
    type: "string"
    stored: true
  - name: lemma
    type: string
  - name: length
    type: u64
"""


def test_config():
    config = SchemaConfig.from_yaml(YAML)
    assert config.layers == ["word", "lemma"] and config.output_fields == ["word", "lemma"]
    with pytest.raises(SchemaError):
        SchemaConfig.from_dict({"fields": [{"name": "word", "type": "decimal"}]})
    with pytest.raises(SchemaError):
        SchemaConfig.from_dict({"fields": [{"name": "lemma", "type": "string"}]})


def test_reads_lines_objects_arrays_and_gzip(spark, tmp_path):
    docs = fixture.documents()
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, docs[:3])))
    (tmp_path / "one.json").write_text(json.dumps(docs[3], indent=2))
    (tmp_path / "array.json").write_text(json.dumps(docs[4:6]))
    (tmp_path / "packed.json").write_bytes(gzip.compress(json.dumps(docs[6]).encode()))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "other.txt").write_text("{}")
    found = reader.read_any(spark, str(tmp_path), "*.json")
    assert sorted(r.id for r in found.collect()) == sorted(d["id"] for d in docs[:7])
    good, failed = reader.read_checked(spark, str(tmp_path / "lines.json"))
    assert good.count() == 3 and failed.count() == 0
    good, failed = reader.read_checked(spark, str(tmp_path / "bad.json"))
    assert good.count() == 0 and failed.count() == 1
    whole, _ = reader.read_checked(spark, str(tmp_path / "array.json"), whole_files=True)
    assert whole.count() == 2


def test_sentences(spark):
    s = fixture.sentences(spark)
    validate_schema(s)
    with pytest.raises(SchemaError):
        validate_schema(s.drop("word"))
    row = s.where("doc_id = 'doc_simple'").first()
    assert (row.sentence_id, row.sentence_idx, row.sentence_length) == ("doc_simple_0", 0, 4)
    assert row.word == ["John", "eats", "pizza", "."] and row.roots == [1]
    assert [tuple(d) for d in row.deps] == [(1, 0, "nsubj"), (1, 2, "dobj"), (1, 3, "punct")]
    stats = Engine(s).stats().first()
    assert (stats.documents, stats.sentences, stats.tokens, stats.edges) == (10, 10, 69, 59)
    assert reader.validate(s, ["word", "pos"]).count() == 0
    assert views.edges(s).count() == 59 and views.tokens(s).count() == 69
    assert s.where("doc_id = 'doc_simple'").select(S.deps_string().alias("x")).first().x == "1:0:nsubj 1:2:dobj 1:3:punct"


def test_validation(spark):
    s = spark.createDataFrame(
        [("a", "a_0", 0, 3, ["x", "y", "z"], [(10, 0, "l")]), ("b", "b_0", 0, 3, ["x"], [(0, 99, "l")]), ("c", "c_0", 0, 1, ["x"], [])],
        "doc_id string, sentence_id string, sentence_idx int, sentence_length long, word array<string>, deps array<struct<src:int,dst:int,label:string>>",
    )
    rows = sorted((r.doc_id, r.problem, r.error) for r in reader.validate(s, ["word"]).collect())
    assert rows == [("a", "edge beyond the sentence", True), ("b", "edge beyond the sentence", True), ("b", "layer word has another length", False)]


def test_document_without_sentences(spark):
    rows = spark.createDataFrame([('{"id": "x", "sentences": []}',), ('{"id": "y"}',), ("[]",), ("oops",)], "json string")
    assert reader.to_sentences(reader.parse_json(rows, "json")).count() == 0


def test_store_append_and_query(spark, tmp_path):
    s, path = fixture.sentences(spark), str(tmp_path / "corpus")
    reader.write_corpus(s.where("doc_id = 'doc_simple'"), path)
    reader.write_corpus(s.where("doc_id <> 'doc_simple'"), path, "append")
    e = Engine(reader.open_corpus(spark, path))
    assert e.hits("[word=pizza]").count() == 3
    with pytest.raises(SchemaError):
        reader.write_corpus(s, path, "ignore")


def test_response_and_texts(spark):
    e = Engine(fixture.sentences(spark), ["word", "lemma"])
    answer = e.respond("[pos=NN]", 2)
    assert answer["result_count"] == 2 and answer["max_score"] == max(r["score"] for r in answer["results"])
    assert answer["results"][0]["sentence_index"] == 0 and answer["results"][0]["matches"]
    assert json.loads(results.as_json(answer, 2)) == answer
    assert "hits" in results.minimal(answer) and "document" in results.formatted(answer)
    with pytest.raises(ValueError):
        e.respond("  ")
    assert e.respond("[word=nowhere]")["max_score"] is None


def test_order_limit_merge(spark):
    e = Engine(fixture.sentences(spark))
    rows = e.query("[pos=/N.*/]").collect()
    assert [(-r.score, r.doc_id) for r in rows] == sorted((-r.score, r.doc_id) for r in rows)
    assert [r.doc_id for r in e.query("[pos=/N.*/]", 3).collect()] == [r.doc_id for r in rows[:3]]
    assert "TakeOrderedAndProject" in e.query("[pos=/N.*/]", 3)._jdf.queryExecution().executedPlan().toString()
    merged = results.merge(e.hits("[word=John]"), e.hits("[pos=NNP]"))
    assert merged.count() == len({r.doc_id for r in merged.collect()})


def test_match_text_bounds(spark):
    df = spark.createDataFrame([(["a", "b"], 0, 2), (["a", "b"], 1, 3), (["a"], 0, 0), ([], 0, 1)], "w array<string>, s int, e int")
    from pyspark.sql import functions as F

    assert [r.t for r in df.select(S.match_text(F.col("w"), F.col("s"), F.col("e")).alias("t")).collect()] == ["a b", None, None, None]


def test_stream(spark, tmp_path):
    from spanloom import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, fixture.documents())))
    hits = streaming.stream_hits(streaming.read_documents(spark, str(tmp_path / "in")), "[word=pizza]", SchemaConfig(["word", "pos"], ["word"]))
    q = hits.writeStream.format("memory").queryName("pizza").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pizza").count() == 3


def _document(name: str, keys: list[str]) -> str:
    parts = {"id": name, "metadata": [], "sentences": [{"numTokens": 1, "fields": [{"name": "word", "$type": "ai.lum.odinson.TokensField", "tokens": ["a"]}]}]}
    return json.dumps({k: parts[k] for k in keys})


def test_json_lines_with_keys_in_any_order(spark):
    orders = [["sentences", "id", "metadata"], ["metadata", "sentences", "id"], ["id", "sentences", "metadata"]]
    lines = [_document(f"d{i}", orders[i % 3]) for i in range(6)]
    pretty = json.dumps(json.loads(lines[0]), indent=1).replace("d0", "p")
    texts = ["\n".join(lines), "\r\n".join(lines[:2]).replace('"d', '"e') + "\n\n", "[" + ",\n".join(lines[3:5]).replace('"d', '"f') + "]", pretty, lines[0].replace("d0", "one")]
    texts += ["junk\n" + lines[1].replace("d1", "after"), "nothing", "[1", None, "", "{}"]
    good, bad = reader.parse_checked(spark.createDataFrame(list(enumerate(texts)), "n int, json string"), "json")
    assert sorted(r.id for r in good.collect()) == sorted([f"d{i}" for i in range(6)] + ["e0", "e1", "f3", "f4", "p", "one", "after"])
    assert sorted((r.n, r.json or "") for r in bad.collect()) == [(5, "junk"), (6, "nothing"), (7, "[1"), (8, ""), (9, ""), (10, "{}")]


def test_damaged_files_are_reported(spark, tmp_path):
    (tmp_path / "a.json").write_text(_document("good", ["metadata", "id", "sentences"]))
    (tmp_path / "b.json").write_bytes(b"\x1f\x8b damaged")
    (tmp_path / "c.json").write_text("{ broken")
    good, bad = reader.read_any_checked(spark, str(tmp_path))
    assert [r.id for r in good.collect()] == ["good"]
    assert sorted((r.path.rsplit("/", 1)[1], r.text) for r in bad.collect()) == [("b.json", None), ("c.json", "{ broken")]
