"""Language ID: accuracy on held-out rows, and defined cases."""

import random

from spanloom.llm import langid

WORDS = {"aa": "lorem ipsum dolor sitamet consectetur", "bb": "zwischen strasse haus gegenwart vielleicht", "cc": "quelque chose toujours maintenant peut"}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def corpus(spark, n=120):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, rng.randint(3, 200)), lang, "n") for i in range(n) for lang in [rng.choice("abc") * 2]]
    rows += [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "12 !? 34", "aa", None), (1003, text(rng, "bb", 30_000), "bb", None), (1004, text(rng, "cc", 40), None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_accuracy_and_cases(spark):
    docs = corpus(spark)
    dictionaries = langid.fit(docs.where(langid.fold_of() != 2))
    assert sorted(dictionaries) == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in langid.identify(docs, dictionaries).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(truth)
    assert all(got[i].lang_pred == truth[i] for i in truth if i < 1000)
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert got[1003].lang_pred == "bb" and got[1004].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.accepted(docs, dictionaries)
    assert kept.columns == docs.columns and kept.count() == sum(r.accepted for r in got.values())


def test_ids_and_labels_are_no_inputs(spark):
    docs = corpus(spark)
    dictionaries = langid.fit(docs)
    from pyspark.sql import functions as F

    other = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"), "score")
    assert sorted((r.lang_pred, r.score) for r in langid.identify(docs, dictionaries).collect()) == sorted((r.lang_pred, r.score) for r in langid.identify(other, dictionaries).collect())


def test_nothing_to_learn(spark):
    docs = corpus(spark).where("false")
    assert langid.fit(docs) == {}
    assert langid.identify(docs, {}).count() == 0
    assert langid.identify(corpus(spark), {}).where("lang_pred <> 'und'").count() == 0


def test_ties_and_one_language():
    c = langid.Classifier({"a": b"same words here", "b": b"same words here"})
    assert c.predict("same words") == ("a", 0.0, False)
    assert langid.Classifier({"a": b"x"}).predict("word") == ("a", 1.0, True)


def test_real_accuracy(spark):
    import os

    path = "/root/testdata/sf0.01"
    if os.path.exists(path):
        got = langid.op1(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id")
        held = got.where("held_out and lang is not null and n_chars > 100").collect()
        assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95


def test_label_of_one_repeated_text(spark):
    """A label whose rows are copies of one text is learned, whichever hash that text has."""
    for n in range(4):
        french = f"le petit chat numero {n} dort sur la grande chaise de la maison bleue"
        english = [f"the quick brown fox number {i} jumps over the lazy dog and runs away" for i in range(200)]
        rows = spark.range(5000).selectExpr(f"'{french}' as text", "'fr' as lang").unionByName(spark.createDataFrame([(t, "en") for t in english], "text string, lang string"))
        assert sorted(langid.fit(rows)) == ["en", "fr"]
        found = langid.Classifier(langid.fit(rows)).predict("la maison bleue du petit chat dort")
        assert found[0] == "fr"
