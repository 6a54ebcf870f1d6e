"""License phrases by brute force, and templates."""

import random
import re

import pytest

from spanloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scanner(templates=None):
    return licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES if templates is None else templates)


def test_base_against_brute_force():
    rng = random.Random(7)
    bits = ["CC", "by", "cc", "BY", "General", "public", "license", "ALL", "rights", "reserved", "é", "x1"]
    s = scanner()
    for _ in range(400):
        text = "".join(rng.choice(bits) + rng.choice([" ", "-", ", ", "\n", "é", ""]) for _ in range(rng.randint(0, 25)))
        words = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            for i in range(len(words)):
                if words[i : i + len(phrase.split())] == phrase.split():
                    places.append(i)
                    labels.add(label)
        assert s.scan(text.encode())[:5] == (len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels))


def matches(template, text):
    return [(a, b) for _, a, b in scanner({"t": template}).scan(text.encode())[5]]


def test_templates():
    assert matches("under the <<optional>>terms of the<</optional>> MIT License", "x Under the MIT license. y under the terms of the mit license") == [(1, 5), (6, 13)]
    assert matches("under the <<optional>>terms of the<</optional>> MIT License", "under the terms of mit license") == []
    assert matches("copyright <<var 1-3>> reserved", "copyright a b c reserved copyright reserved copyright a b c d reserved") == [(0, 5)]
    assert matches("a <<var 2-2>> b", "a x y b a x b") == [(0, 4)]
    assert matches("<<optional>>this <<var 1-2>> is<</optional>> mit", "this great work is mit and mit") == [(0, 5), (6, 7)]
    assert matches("a <<optional>>b <<optional>>c<</optional>> d<</optional>> e", "a e a b d e a b c d e a b e") == [(0, 2), (2, 6), (6, 11)]
    assert matches("a <<var 0-300>> b", "a " + "x " * 300 + "b") == [(0, 302)]
    assert matches("a <<var 0-300>> b", "a " + "x " * 301 + "b") == []


def test_malformed_templates():
    for bad in ("<<optional>>a", "a<</optional>>", "<<var 3-1>> a", "<<optional>>a<</optional>>", "<<var 1-2>>"):
        with pytest.raises(ValueError):
            scanner({"t": bad})


def test_frame(spark):
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 3.", "q"),
        (2, "Released under the MIT License.", "q"),
        (3, None, "q"),
        (4, "", "q"),
        (5, "All rights reserved. CC BY", "q"),
        (None, "cc by", "q"),
        (6, "word " * 50_000 + "cc by", "q"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[1].labels == "gpl,gpl-3.0-notice" and got[1].base_labels == "gpl" and got[1].score == 1.0
    assert got[2].labels == "mit-notice" and got[2].n_base == 0 and got[2].first_word is None
    assert (got[3].n_words, got[3].labels, got[3].score) == (0, "", 0.0) == (got[4].n_words, got[4].labels, got[4].score)
    assert (got[5].base_labels, got[5].first_word, got[5].last_word, got[5].score) == ("cc-by,reserved", 0, 3, 0.5)
    assert got[6].first_word == 50_000
    assert licenses.scan(docs.where("false")).count() == 0
