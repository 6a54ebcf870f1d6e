"""Query texts and their trees."""

import pytest

from spanloom.lang.ast import All, Any, Anything, Capture, Choice, Contains, Edge, EitherStep, Equals, Look, Matches, Not, Path, PatternError, Repeat, RepeatStep, Sequence, Steps, Token
from spanloom.lang.parser import parse

W = lambda v: Token(Equals("word", v))
L = lambda v: Equals("label", v)
A, B, C = W("a"), W("b"), W("c")

TREES = {
    "hello": W("hello"),
    "/h.*o/": Token(Matches("word", "h.*o")),
    "[word=a]": A,
    "[]": Token(Anything()),
    "[*]": Token(Anything()),
    "[word='a b']": W("a b"),
    r"[word=/a\/b/]": Token(Matches("word", "a/b")),
    "[f_1!=v-1]": Token(Not(Equals("f_1", "v-1"))),
    "[f!=v~]": Token(Not(Contains("f", "v"))),
    "[!f=/v/]": Token(Not(Matches("f", "v"))),
    "[!(f=v | g=w)]": Token(Not(Any((Equals("f", "v"), Equals("g", "w"))))),
    "[a=1 & b=2 | c=3]": Token(Any((All((Equals("a", "1"), Equals("b", "2"))), Equals("c", "3")))),
    "[a=1 & (b=2 | !c=3)]": Token(All((Equals("a", "1"), Any((Equals("b", "2"), Not(Equals("c", "3"))))))),
    "a b c": Sequence((A, B, C)),
    "a (b c)": Sequence((A, B, C)),
    "a | b c": Choice((A, Sequence((B, C)))),
    "(a | b)+ c": Sequence((Repeat(Choice((A, B)), 1, None), C)),
    "a* b+ c?": Sequence((Repeat(A, 0, None), Repeat(B, 1, None), Repeat(C, 0, 1))),
    "a*? b+? c??": Sequence((Repeat(A, 0, None, True), Repeat(B, 1, None, True), Repeat(C, 0, 1, True))),
    "a{2} b{1,} c{,3}": Sequence((Repeat(A, 2, 2), Repeat(B, 1, None), Repeat(C, 0, 3))),
    "a{1,2}?": Repeat(A, 1, 2, True),
    "(?<x> a b)": Capture("x", Sequence((A, B))),
    "(?= a) b": Sequence((Look(True, True, A), B)),
    "b (?! a)": Sequence((B, Look(True, False, A))),
    "(?<= a) b": Sequence((Look(False, True, A), B)),
    "(?<! a) b": Sequence((Look(False, False, A), B)),
    "a >x b": Path(A, ((Edge("out", L("x")), B),)),
    "a <nsubj:pass b": Path(A, ((Edge("in", L("nsubj:pass")), B),)),
    "a >/n.*/ b": Path(A, ((Edge("out", Matches("label", "n.*")), B),)),
    "a >> b << c": Path(A, ((Edge("out"), B), (Edge("in"), C))),
    "a >x|y b": Path(A, ((EitherStep((Edge("out", L("x")), Edge("out", L("y")))), B),)),
    "a >x>y b": Path(A, ((Steps((Edge("out", L("x")), Edge("out", L("y")))), B),)),
    "a >x? b": Path(A, ((RepeatStep(Edge("out", L("x")), 0, 1), B),)),
    "a >x{1,2} b": Path(A, ((RepeatStep(Edge("out", L("x")), 1, 2), B),)),
    "a >>* b": Path(A, ((RepeatStep(Edge("out"), 0, None), B),)),
    "a b >x c a": Path(Sequence((A, B)), ((Edge("out", L("x")), Sequence((C, A))),)),
}


@pytest.mark.parametrize("text", TREES)
def test_tree(text):
    assert parse(text) == TREES[text]


@pytest.mark.parametrize("text", ["", "  ", "[word=a] ||", "[word=a", "word=a]", "(a", "a)", "[=a]", "[a=]", "a{}", "a{3,1}", "[a=/(/]", "a > b", "(?<x a)", "a >", "[a=/x/~]", "(?= a)*"])
def test_errors(text):
    with pytest.raises(PatternError):
        parse(text)


def test_default_field():
    assert parse("hello", "lemma") == Token(Equals("lemma", "hello"))


def test_anchors_add_nothing():
    assert Matches("w", "^the$").literal == "the"
    assert Matches("w", r"a\$").body == r"a\$"
    assert Matches("w", "t.e").literal is None
