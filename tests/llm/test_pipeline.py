"""The pipeline stage by stage, and its queries' registration."""

import hashlib
import os
import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    vocabulary = {"en": "the house stands where river water meets stone walls under trees", "de": "das haus steht dort wo wasser auf steinerne mauern unter baeumen trifft"}
    rows = []
    for i in range(80):
        lang = rng.choice(["en", "de"])
        line = lambda: " ".join(rng.choice(vocabulary[lang].split()) + str(rng.randint(0, 99)) * (rng.random() < 0.3) for _ in range(rng.randint(5, 40)))
        rows.append((i, "\n".join(line() for _ in range(rng.randint(1, 5))), lang, f"s{i % 3}", 1))
    rows += [(100, rows[0][1], rows[0][2], "s0", 1), (101, rows[1][1] + "\nand one line that is all new here", rows[1][2], "s1", 1)]
    rows += [(102, None, "en", "s1", None), (103, "", "en", None, 0), (104, "12 34 !!", None, "s2", 8)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        steps[name] = out.collect()
        docs = spark.createDataFrame(steps[name], out.schema)
    ids = {k: [r.doc_id for r in v] for k, v in steps.items()}
    assert set(ids["language_id"]) == {r[0] for r in rows} - {102, 103, 104}
    assert 100 not in ids["line_dedup"]
    cut = next(r for r in steps["line_dedup"] if r.doc_id == 101)
    assert cut.text == "and one line that is all new here" and cut.n_chars == len(cut.text)
    assert len(ids["simhash_dedup"]) == len(set(ids["simhash_dedup"])) <= len(ids["line_dedup"])
    assert set(ids["mix_sources"]) <= set(ids["simhash_dedup"]) and max(map(ids["mix_sources"].count, ids["mix_sources"])) <= 2


def test_clashing_columns(spark, folder):
    """Columns named like those that stages add go through unchanged."""
    path, rows = folder
    extra = ["copies", "rows", "n_removed", "N_LINES", "component_id", "id", "_time", "_gone"]
    docs = spark.createDataFrame([(*r, *extra) for r in rows[:30]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() and [list(r) for r in docs.select(*extra).distinct().collect()] == [extra]


def test_run(spark, folder):
    path, _ = folder
    out = pipeline.run(spark, path)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 40
    texts = {r.doc_id: r.text for r in pipeline.line_dedup(spark, pipeline.language(spark, spark.read.parquet(f"{path}/documents.parquet"), path), path).collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out.collect())


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder[0]}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n[:3] == "op1" or n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "corpus_pipeline.py"))
