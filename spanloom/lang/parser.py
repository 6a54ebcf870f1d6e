"""Query text to syntax tree, by recursive descent.

Trailing text is an error. Beyond the basic grammar it takes ``{n}``, ``{,n}``
from zero, ``!`` before any atom, sequences and alternation in parentheses,
quoted values, ``\\/`` in expressions, ``_ : . -`` in labels, and quantifiers
``? * + {n,m}`` on edge steps.
"""

from __future__ import annotations

import re

from .ast import (
    All,
    Any,
    Anything,
    Capture,
    Choice,
    Constraint,
    Contains,
    Edge,
    EitherStep,
    Equals,
    Look,
    Matches,
    Not,
    Path,
    Pattern,
    PatternError,
    Repeat,
    RepeatStep,
    Step,
    Steps,
    Token,
    sequence,
)

_SPACE = re.compile(r"[ \t\r\n]*")
_FIELD = re.compile(r"[A-Za-z0-9_]+")
_VALUE = re.compile(r"[A-Za-z0-9_-]+")
_LABEL = re.compile(r"[A-Za-z0-9_:.-]+")
_REGEX = re.compile(r"/((?:\\.|[^/\\\n])*)/")
_QUOTED = re.compile(r'"((?:\\.|[^"\\])*)"' + r"|'((?:\\.|[^'\\])*)'")
_BARE = re.compile(r"[A-Za-z0-9]+")
_BOUNDS = re.compile(r"\{\s*(\d*)\s*(?:(,)\s*(\d*)\s*)?\}")


class Parser:
    def __init__(self, text: str, default_field: str = "word"):
        self.text, self.at, self.default_field = text, 0, default_field

    # Basics

    def fail(self, wanted: str):
        raise PatternError(f"expected {wanted} at {self.at} in {self.text!r}")

    def skip(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def peek(self, *marks: str) -> str | None:
        self.skip()
        return next((m for m in marks if self.text.startswith(m, self.at)), None)

    def take(self, mark: str) -> bool:
        if self.peek(mark) is None:
            return False
        self.at += len(mark)
        return True

    def need(self, mark: str) -> None:
        if not self.take(mark):
            self.fail(repr(mark))

    def read(self, pattern: re.Pattern) -> re.Match | None:
        self.skip()
        if found := pattern.match(self.text, self.at):
            self.at = found.end()
        return found

    def regex(self) -> str | None:
        found = self.read(_REGEX)
        return found and found[1].replace("\\/", "/")

    # Patterns

    def parse(self) -> Pattern:
        if not self.text.strip():
            raise PatternError("the query is blank")
        found = self.choice()
        self.skip()
        if self.at < len(self.text):
            self.fail("the end")
        return found

    def choice(self) -> Pattern:
        parts = [self.chain()]
        while self.peek("|"):
            self.need("|")
            parts.append(self.chain())
        return parts[0] if len(parts) == 1 else Choice(tuple(parts))

    def chain(self) -> Pattern:
        """Adjacent patterns and edge steps. What follows a step up to the next one begins at its node."""
        parts, hops = [self.quantified()], []
        while True:
            if self.peek("<", ">"):
                step = self.step()
                hops.append((step, [self.quantified()]))
            elif self.starts_pattern():
                (hops[-1][1] if hops else parts).append(self.quantified())
            else:
                break
        source = sequence(*parts)
        return Path(source, tuple((s, sequence(*p)) for s, p in hops)) if hops else source

    def starts_pattern(self) -> bool:
        self.skip()
        return self.at < len(self.text) and (self.text[self.at] in "[(/" or self.text[self.at].isalnum())

    def quantified(self) -> Pattern:
        found = self.atom()
        if bounds := self.quantifier():
            low, high = bounds
            lazy = self.text.startswith("?", self.at)
            self.at += lazy
            if isinstance(found, Look):
                raise PatternError("an assertion can't be repeated")
            return Repeat(found, low, high, lazy)
        return found

    def quantifier(self) -> tuple[int, int | None] | None:
        for mark, bounds in (("*", (0, None)), ("+", (1, None)), ("?", (0, 1))):
            if self.take(mark):
                return bounds
        if self.peek("{"):
            if (found := self.read(_BOUNDS)) is None or not (found[1] or found[2]):
                self.fail("bounds like {1,3}")
            low = int(found[1] or 0)
            return low, low if found[2] is None else int(found[3]) if found[3] else None
        return None

    def atom(self) -> Pattern:
        mark = self.peek("(?<=", "(?<!", "(?=", "(?!", "(?<", "(", "[", "/")
        if mark in ("(?=", "(?!", "(?<=", "(?<!"):
            self.need(mark)
            inner = self.choice()
            self.need(")")
            return Look("<" not in mark, "=" in mark, inner)
        if mark == "(?<":
            self.need(mark)
            name = self.read(_FIELD) or self.fail("a capture name")
            self.need(">")
            inner = self.choice()
            self.need(")")
            return Capture(name[0], inner)
        if mark == "(":
            self.need(mark)
            inner = self.choice()
            self.need(")")
            return inner
        if mark == "[":
            self.need(mark)
            inner = Anything() if self.peek("]") else self.either()
            self.need("]")
            return Token(inner)
        if mark == "/":
            found = self.regex()
            return Token(Matches(self.default_field, found if found is not None else self.fail("/expression/")))
        word = self.read(_BARE) or self.fail("a pattern")
        return Token(Equals(self.default_field, word[0]))

    # Constraints

    def either(self) -> Constraint:
        parts = [self.both()]
        while self.take("|"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Any(tuple(parts))

    def both(self) -> Constraint:
        parts = [self.negated()]
        while self.take("&"):
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else All(tuple(parts))

    def negated(self) -> Constraint:
        if self.take("!"):
            return Not(self.negated())
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        if self.take("*"):
            return Anything()
        field = self.read(_FIELD) or self.fail("a field")
        unequal = self.take("!=")
        if not unequal:
            self.need("=")
        regex = self.regex()
        if regex is not None:
            found: Constraint = Matches(field[0], regex)
            if self.take("~"):
                raise PatternError("~ needs a plain value")
        else:
            value = self.value()
            found = Contains(field[0], value) if self.take("~") else Equals(field[0], value)
        return Not(found) if unequal else found

    def value(self) -> str:
        if quoted := self.read(_QUOTED):
            return re.sub(r"\\(.)", r"\1", quoted[1] if quoted[1] is not None else quoted[2])
        return (self.read(_VALUE) or self.fail("a value"))[0]

    # Edge steps

    def step(self) -> Step:
        if self.peek(">>", "<<"):
            direction = "out" if self.text[self.at] == ">" else "in"
            self.at += 2
            return self.step_quantifier(Edge(direction))
        parts = [self.labelled()]
        while self.peek("<", ">") and not self.peek("<<", ">>"):
            parts.append(self.labelled())
        return parts[0] if len(parts) == 1 else Steps(tuple(parts))

    def labelled(self) -> Step:
        direction = "out" if self.text[self.at] == ">" else "in"
        self.at += 1
        labels = [self.label()]
        while self.take("|"):
            labels.append(self.label())
        edges = tuple(Edge(direction, x) for x in labels)
        return self.step_quantifier(edges[0] if len(edges) == 1 else EitherStep(edges))

    def label(self) -> Equals | Matches:
        regex = self.regex()
        if regex is not None:
            found = Matches("label", regex)
            return found if found.literal is None else Equals("label", found.literal)
        return Equals("label", (self.read(_LABEL) or self.fail("a label"))[0])

    def step_quantifier(self, step: Step) -> Step:
        bounds = self.quantifier()
        return RepeatStep(step, *bounds) if bounds else step


def parse(text: str, default_field: str = "word") -> Pattern:
    return Parser(text, default_field).parse()
