"""Syntax tree of the pattern language; immutable, so parts can be compared and used as keys."""

from __future__ import annotations

import re
from dataclasses import dataclass


class PatternError(ValueError):
    """A query text or tree that can't be compiled."""


# Token constraints


@dataclass(frozen=True)
class Anything:
    """Any token."""


@dataclass(frozen=True)
class Equals:
    field: str
    value: str


@dataclass(frozen=True)
class Matches:
    """The whole token matches a regular expression; a leading ^ and a trailing $ add nothing."""

    field: str
    regex: str

    def __post_init__(self):
        try:
            re.compile(self.body)
        except re.error as e:
            raise PatternError(f"invalid regular expression /{self.regex}/: {e}") from None

    @property
    def body(self) -> str:
        text = self.regex[1:] if self.regex.startswith("^") else self.regex
        return text[:-1] if text.endswith("$") and not text.endswith("\\$") else text

    @property
    def literal(self) -> str | None:
        """The only word that matches, if the expression is plain text."""
        return None if re.search(r"[\\^$.|?*+()\[\]{}]", self.body) else self.body


@dataclass(frozen=True)
class Contains:
    """Case-insensitive substring."""

    field: str
    value: str


@dataclass(frozen=True)
class Not:
    inner: Constraint


@dataclass(frozen=True)
class All:
    parts: tuple[Constraint, ...]


@dataclass(frozen=True)
class Any:
    parts: tuple[Constraint, ...]


Constraint = Anything | Equals | Matches | Contains | Not | All | Any

# Edge steps


@dataclass(frozen=True)
class Edge:
    """One edge: ``out`` from head to dependent, ``in`` from dependent to head. No label: any."""

    direction: str
    label: Equals | Matches | None = None


@dataclass(frozen=True)
class Stay:
    """No movement."""


@dataclass(frozen=True)
class EitherStep:
    parts: tuple[Step, ...]


@dataclass(frozen=True)
class Steps:
    parts: tuple[Step, ...]


@dataclass(frozen=True)
class RepeatStep:
    """``low`` to ``high`` times, without bound if high is None; the nodes reached are a set unless it is 0 or 1 times."""

    inner: Step
    low: int
    high: int | None


Step = Edge | Stay | EitherStep | Steps | RepeatStep

# Patterns


@dataclass(frozen=True)
class Token:
    constraint: Constraint


@dataclass(frozen=True)
class Sequence:
    parts: tuple[Pattern, ...]


@dataclass(frozen=True)
class Choice:
    """The first alternative that fits is preferred."""

    parts: tuple[Pattern, ...]


@dataclass(frozen=True)
class Repeat:
    inner: Pattern
    low: int
    high: int | None
    lazy: bool = False

    def __post_init__(self):
        if self.high is not None and self.high < self.low:
            raise PatternError(f"wrong bounds {{{self.low},{self.high}}}")


@dataclass(frozen=True)
class Capture:
    name: str
    inner: Pattern


@dataclass(frozen=True)
class Look:
    """Assertion; ``ahead`` or behind, ``positive`` or negative."""

    ahead: bool
    positive: bool
    inner: Pattern


@dataclass(frozen=True)
class Path:
    """A source and hops, each an edge step and the pattern that begins at the node it arrives at."""

    source: Pattern
    hops: tuple[tuple[Step, Pattern], ...]


@dataclass(frozen=True)
class Mention:
    """A reference to earlier extractions; it has no syntax and doesn't compile."""

    label: str


Pattern = Token | Sequence | Choice | Repeat | Capture | Look | Path | Mention


def sequence(*parts: Pattern) -> Pattern:
    """A sequence without nesting; one part stays itself."""
    flat = [q for p in parts for q in (p.parts if isinstance(p, Sequence) else (p,))]
    return flat[0] if len(flat) == 1 else Sequence(tuple(flat))


def children(p: Pattern) -> tuple[Pattern, ...]:
    match p:
        case Sequence(parts) | Choice(parts):
            return parts
        case Repeat(inner) | Capture(_, inner) | Look(_, _, inner):
            return (inner,)
        case Path(source, hops):
            return (source, *(q for _, q in hops))
    return ()


def walk(p: Pattern):
    yield p
    for c in children(p):
        yield from walk(c)


def has_path(p: Pattern) -> bool:
    return any(isinstance(x, Path) for x in walk(p))


def is_greedy(p: Pattern) -> bool:
    """Whether any quantifier is greedy, which makes overlapping matches compete."""
    return any(isinstance(x, Repeat) and not x.lazy for x in walk(p))


def fields_of(c: Constraint) -> set[str]:
    match c:
        case Equals(f) | Matches(f) | Contains(f):
            return {f}
        case Not(inner):
            return fields_of(inner)
        case All(parts) | Any(parts):
            return set().union(*map(fields_of, parts)) if parts else set()
    return set()
