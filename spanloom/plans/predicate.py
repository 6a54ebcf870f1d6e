"""Token constraints as Boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.lang.ast import All, Any, Anything, Constraint, Contains, Equals, Matches, Not, PatternError, fields_of


class Layers:
    """Names of the token layers at hand. ``tag`` falls back to ``pos``."""

    def __init__(self, columns: list[str]):
        self.columns = set(columns)

    def name(self, field: str) -> str:
        if field in self.columns:
            return field
        if field == "tag" and "pos" in self.columns:
            return "pos"
        raise PatternError(f"unknown field {field!r}; there are {', '.join(sorted(self.columns))}")

    def check(self, c: Constraint) -> None:
        for f in fields_of(c):
            self.name(f)

    def layer(self, field: str) -> Column:
        name = self.name(field)
        if field == "tag" and name == "tag" and "pos" in self.columns:
            return F.coalesce(F.col("tag"), F.col("pos"))
        return F.col(name)


def value_test(c: Equals | Matches | Contains, value: Column) -> Column:
    """Test of one value; null where the value is."""
    match c:
        case Equals(_, wanted):
            return value == F.lit(wanted)
        case Matches():
            if c.literal is not None:
                return value == F.lit(c.literal)
            return value.rlike(rf"\A(?:{c.body})\z")
        case Contains(_, wanted):
            return F.lower(value).contains(F.lit(wanted.lower()))
    raise TypeError(c)


def token_test(c: Constraint, layers: Layers, place: Column) -> Column:
    """Whether the token at a place satisfies the constraint. A missing layer or token fails each plain test, so that its negation holds."""
    match c:
        case Anything():
            return F.lit(True)
        case Not(inner):
            return ~token_test(inner, layers, place)
        case All(parts):
            out = F.lit(True)
            for p in parts:
                out = out & token_test(p, layers, place)
            return out
        case Any(parts):
            out = F.lit(False)
            for p in parts:
                out = out | token_test(p, layers, place)
            return out
    return F.coalesce(value_test(c, F.get(layers.layer(c.field), place)), F.lit(False))


def sentence_test(c: Constraint, layers: Layers) -> Column | None:
    """A cheap necessary condition on the sentence: some token may satisfy the constraint. None: no restriction."""
    match c:
        case Equals(field, value):
            return F.array_contains(layers.layer(field), value)
        case Matches() if c.literal is not None:
            return F.array_contains(layers.layer(c.field), c.literal)
        case All(parts):
            tests = [t for p in parts if (t := sentence_test(p, layers)) is not None]
            return _fold(tests, lambda a, b: a & b) if tests else None
        case Any(parts) if parts:
            tests = [sentence_test(p, layers) for p in parts]
            return None if any(t is None for t in tests) else _fold(tests, lambda a, b: a | b)
    return None


def _fold(items, how):
    out = items[0]
    for x in items[1:]:
        out = how(out, x)
    return out
