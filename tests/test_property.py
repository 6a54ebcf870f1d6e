"""Random patterns and sentences: coded regular expressions against plain enumeration, and joins against both."""

import random

from spanloom.engine import Engine
from spanloom.lang.ast import Anything, Choice, Equals, Look, Repeat, Token, sequence
from spanloom.operators import relational, results
from spanloom.sources import views

LETTERS = "abc"


def ends(p, words, at):
    """Ends of matches from a place, in order of preference."""
    match p:
        case Token(Anything()):
            return [at + 1] if at < len(words) else []
        case Token(Equals(_, v)):
            return [at + 1] if at < len(words) and words[at] == v else []
        case Choice(parts):
            return [e for q in parts for e in ends(q, words, at)]
        case Look(ahead, positive, inner):
            held = bool(ends(inner, words, at)) if ahead else at > 0 and at in ends(inner, words, at - 1)
            return [at] if held == positive else []
        case Repeat(inner, low, high, lazy):
            def go(place, n):
                more = [] if high is not None and n >= high else [f for e in ends(inner, words, place) if e > place for f in go(e, n + 1)]
                here = [place] if n >= low else []
                return here + more if lazy else more + here
            return go(at, 0)
    found = [at]
    for q in p.parts:
        found = [e for f in found for e in ends(q, words, f)]
    return found


def pattern(rng, depth=0):
    atom = lambda: Token(Anything() if rng.random() < 0.2 else Equals("word", rng.choice(LETTERS)))
    kind = rng.random()
    if depth > 2 or kind < 0.4:
        return atom()
    if kind < 0.6:
        return sequence(*[pattern(rng, depth + 1) for _ in range(rng.randint(2, 3))])
    if kind < 0.7:
        return Choice(tuple(pattern(rng, depth + 1) for _ in range(2)))
    if kind < 0.8:
        return sequence(pattern(rng, depth + 1), Look(True, rng.random() < 0.5, atom()))
    if kind < 0.85:
        return sequence(Look(False, rng.random() < 0.5, atom()), pattern(rng, depth + 1))
    low = rng.randint(0, 2)
    return Repeat(atom() if rng.random() < 0.7 else pattern(rng, 3), low, rng.choice([None, low, low + 2]), rng.random() < 0.5)


def select(spans):
    kept = []
    for s in spans:
        lapping = [k for k in kept if k[0] < s[1] and s[0] < k[1]]
        if any(k[1] - k[0] > s[1] - s[0] for k in lapping):
            continue
        kept = [k for k in kept if not (k in lapping and k[1] - k[0] < s[1] - s[0])] + [s]
    return sorted(kept)


def corpus(spark, rng, n):
    rows = []
    for i in range(n):
        words = [rng.choice(LETTERS) for _ in range(rng.randint(0, 9))]
        rows.append(("d", f"d_{i}", i, len(words), words))
    return rows, spark.createDataFrame(rows, "doc_id string, sentence_id string, sentence_idx int, sentence_length long, word array<string>").cache()


def test_random_patterns(spark):
    from spanloom.lang.ast import is_greedy

    rng = random.Random(5)
    rows, frame = corpus(spark, rng, 60)
    engine = Engine(frame)
    for _ in range(25):
        p = pattern(rng)
        wanted = []
        for _, sid, _, n, words in rows:
            spans = [(s, e[0]) for s in range(n) if (e := ends(p, words, s)) and e[0] > s]
            wanted += [(sid, *s) for s in (select(spans) if is_greedy(p) else spans)]
        if isinstance(p, Look):
            continue
        got = results.match_rows(engine.hits(p)).collect()
        assert sorted((r.sentence_id, r.start, r.end) for r in got) == sorted(wanted), p


def test_relational_forms_agree(spark):
    rng = random.Random(6)
    _, frame = corpus(spark, rng, 80)
    engine, tokens = Engine(frame), views.tokens(frame, ["word"])
    a, b = tokens.where("word = 'a'"), tokens.where("word = 'b'")
    key = lambda df: sorted((r.sentence_id, r.start, r.end) for r in df.collect())
    inrow = lambda q, **k: key(results.match_rows(engine.hits(q, **k)))
    assert key(relational.adjacent(a, b)) == inrow("a b")
    assert key(relational.gap(a, b, 1, 3, True)) == inrow("a []{1,3}? b")
    assert key(relational.gap(a, b, 0, None, False)) == inrow("a []* b", overlap="per_start")
    assert key(relational.runs(a)) == inrow("a+")
