"""Sequences as regular expressions over coded tokens.

Each token becomes one character whose code holds, as bits, which of the
pattern's constraints it satisfies; a constraint is then a character class, and
quantifiers, alternation and assertions are those of the regular-expression
engine, whose order of preference is the language's (greedy longest, lazy
shortest, first alternative first). A look-ahead that captures the pattern at every place finds
the preferred match of each start in one scan of the sentence. All of it is
built-in expressions over one row, so a sentence never leaves its partition.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.lang.ast import (
    Capture,
    Choice,
    Constraint,
    Look,
    Mention,
    Pattern,
    PatternError,
    Repeat,
    Sequence,
    Token,
    fields_of,
    has_path,
    is_greedy,
    walk,
)

from .predicate import Layers, sentence_test, token_test

#: Constraints of one pattern at most; their bits fit the block of code points from _WIDE on.
MOST_CONSTRAINTS = 14
_NARROW, _WIDE = 48, 0x4E00
MATCH = "struct<start:int,end:int,captures:array<struct<name:string,start:int,end:int>>>"


def materialise(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: a generator stops projections from being merged into it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


@dataclass
class Found:
    """Where a capture lies in a match: so many tokens and so long groups after its start, or, in a repetition, where a group of the rest of the sentence begins."""

    name: str
    offset: int = 0
    before: tuple[int, ...] = ()
    rest: int | None = None
    width: int | None = None
    text: int | None = None

    @property
    def groups(self) -> list[int]:
        return [g for g in (*self.before, self.rest, self.text) if g is not None]


def fixed_width(p: Pattern) -> int | None:
    """Tokens of every match of the pattern; None where matches differ."""
    match p:
        case Token():
            return 1
        case Look():
            return 0
        case Capture(_, inner):
            return fixed_width(inner)
        case Sequence(parts):
            widths = [fixed_width(x) for x in parts]
            return None if None in widths else sum(widths)
        case Choice(parts):
            widths = {fixed_width(x) for x in parts}
            return widths.pop() if len(widths) == 1 else None
        case Repeat(inner, low, high) if low == high:
            width = fixed_width(inner)
            return None if width is None else low * width
    return None


def lone(p: Pattern) -> tuple[Token, list[str]] | None:
    """The token and the names, from the outermost, of a token that is captured or not."""
    names = []
    while isinstance(p, Capture):
        names.append(p.name)
        p = p.inner
    return (p, names) if isinstance(p, Token) else None


def _captures(p: Pattern) -> bool:
    return any(isinstance(x, Capture) for x in walk(p))


@dataclass
class Coding:
    """The constraints of a pattern in the order of their bits."""

    constraints: list[Constraint]
    found: list[Found] = field(default_factory=list)
    #: Groups of the regular expression so far; the first is the whole match.
    count: int = 1

    @classmethod
    def of(cls, p: Pattern) -> Coding:
        found = list(dict.fromkeys(x.constraint for x in walk(p) if isinstance(x, Token)))
        if len(found) > MOST_CONSTRAINTS:
            raise PatternError(f"more than {MOST_CONSTRAINTS} different constraints in one sequence")
        return cls(found)

    @property
    def first(self) -> int:
        return _NARROW if len(self.constraints) <= 6 else _WIDE

    def symbols(self, layers: Layers, length: Column) -> Column:
        """One character a token."""

        def symbol(i: Column) -> Column:
            mask = F.lit(0)
            for bit, c in enumerate(self.constraints):
                mask = mask + F.when(token_test(c, layers, i), F.lit(1 << bit)).otherwise(F.lit(0))
            if self.first == _NARROW:
                return F.get(F.array(*[F.lit(chr(_NARROW + m)) for m in range(1 << len(self.constraints))]), mask)
            return F.decode(F.unhex(F.hex((mask + _WIDE).cast("long"))), "UTF-16BE")

        places = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(places, symbol), "")

    def klass(self, c: Constraint) -> str:
        """Character class of the codes that have the constraint's bit."""
        bit, out = 1 << self.constraints.index(c), []
        for low in range(bit, 1 << len(self.constraints), 2 * bit):
            a, b = self.first + low, self.first + low + bit - 1
            out.append(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}")
        return f"[{''.join(out)}]"

    def _group(self) -> int:
        self.count += 1
        return self.count

    def regex(self, p: Pattern, before: tuple[int, tuple[int, ...]] | None = (0, ()), sure: bool = True) -> str:
        """``before``: tokens and groups between the match's start and this part, None where that isn't known; ``sure``: every match takes this part once."""
        match p:
            case Token(c):
                return self.klass(c)
            case Sequence(parts):
                return self._sequence(parts, before, sure)
            case Choice(parts):
                return f"(?:{'|'.join(self.regex(x, before, False) for x in parts)})"
            case Repeat(inner, low, high, lazy):
                body = self.regex(inner, None, False)
                if not isinstance(inner, Token):
                    body = f"(?:{body})"
                return f"{body}{{{low},{'' if high is None else high}}}{'?' if lazy else ''}"
            case Look(ahead, positive, inner):
                return f"(?{'' if ahead else '<'}{'=' if positive else '!'}{self.regex(inner, before if ahead else None, False)})"
            case Capture(name, inner):
                return self._capture(name, inner, before, sure)
            case Mention():
                raise NotImplementedError("mentions are not implemented")
        raise PatternError("edge steps can't stand inside a group, an assertion or a repetition")

    def _sequence(self, parts, before: tuple[int, tuple[int, ...]] | None, sure: bool) -> str:
        out = []
        for k, part in enumerate(parts):
            width, later = fixed_width(part), before is not None and any(map(_captures, parts[k + 1 :]))
            # Parts of varying width before a capture get a group, whose length tells how far it is.
            number = self._group() if later and width is None else None
            body = self.regex(part, before, sure)
            out.append(body if number is None else f"({body})")
            if later:
                before = (before[0] + (width or 0), before[1] if number is None else (*before[1], number))
        return "".join(out)

    def _capture(self, name: str, inner: Pattern, before: tuple[int, tuple[int, ...]] | None, sure: bool) -> str:
        # In a repetition only the rest of the sentence tells where the capture begins.
        found = Found(name, *(before or ()), rest=self._group() if before is None else None)
        self.found.append(found)
        if sure and before is not None:
            found.width = fixed_width(inner)
        if found.width is None:
            found.text = self._group()
        body = self.regex(inner, before, sure)
        return (r"(?=([\s\S]*))" if before is None else "") + (body if found.text is None else f"({body})")


def _check_lookbehind(p: Pattern) -> None:
    for x in walk(p):
        if isinstance(x, Look) and not x.ahead and any(isinstance(y, Repeat) and y.high is None for y in walk(x.inner)):
            raise PatternError("an assertion on preceding tokens needs bounded repetitions")


def mandatory(p: Pattern) -> list[Constraint]:
    """Constraints that some token must satisfy wherever the pattern matches."""
    match p:
        case Token(c):
            return [c]
        case Sequence(parts):
            return [c for x in parts for c in mandatory(x)]
        case Repeat(inner, low) if low > 0:
            return mandatory(inner)
        case Capture(_, inner):
            return mandatory(inner)
        case Look(_, True, inner):
            return mandatory(inner)
    return []


def settle(df: DataFrame, p: Pattern, constraints: list[Constraint], layers: Layers) -> DataFrame:
    """Computes each layer that the pattern reads once a row, and drops sentences that lack a mandatory value.

    A derived layer would else be computed again for every test and for every token that looks a value up. A test
    comes as soon as its layers are there, so what it drops costs no further layer. Tests other than equality are
    left to the coding, which makes them once for each token.
    """

    def names(c: Constraint) -> set[str]:
        found = {layers.name(f) for f in fields_of(c)}
        return found | {"pos"} if "tag" in found and "pos" in layers.columns else found

    used = {n for x in walk(p) if isinstance(x, Token) for n in names(x.constraint)}
    tests = [(names(c), test) for c in dict.fromkeys(constraints) if (test := sentence_test(c, layers)) is not None]
    columns = [c for c in df.columns if c in used] + ["sentence_length"] + (["deps"] if has_path(p) else [])
    done = set()
    for name in columns:
        df = df.select(*[c for c in df.columns if c != name], F.explode(F.array(name)).alias(name))
        done.add(name)
        for needed, test in tests:
            if name in needed and needed <= done:
                df = df.where(test)
    return df


def all_starts(df: DataFrame, p: Pattern, layers: Layers, name: str) -> DataFrame:
    """Adds ``name``: the preferred non-empty match of every start, in order of starts."""
    coding = Coding.of(p)
    for c in coding.constraints:
        layers.check(c)
    _check_lookbehind(p)
    body = coding.regex(p)
    df = materialise(df, f"{name}_sym", coding.symbols(layers, F.col("sentence_length").cast("int")))
    sym, n = F.col(f"{name}_sym"), F.col("sentence_length").cast("int")
    scan = rf"(?=({body}))[\s\S]"
    marked = F.split(F.regexp_replace(sym, scan, "!"), "")
    parts = {"starts": F.filter(F.transform(marked, lambda c, i: F.when(c == "!", i).otherwise(F.lit(-1))), lambda i: i >= 0)}
    width = fixed_width(p)
    for g in sorted({g for x in coding.found for g in x.groups} | ({1} if width is None else set())):
        parts[f"g{g}"] = F.transform(F.regexp_extract_all(sym, F.lit(scan), F.lit(g)), lambda x: F.coalesce(F.length(x), F.lit(0)))
    df = materialise(df, f"{name}_raw", F.arrays_zip(*[v.alias(k) for k, v in parts.items()]))

    def long(x: Column) -> Column:
        return x["g1"] if width is None else F.lit(width)

    def capture(x: Column, c: Found) -> Column:
        start = n - x[f"g{c.rest}"] if c.rest is not None else x["starts"] + F.lit(c.offset)
        for g in c.before:
            start = start + x[f"g{g}"]
        return F.struct(F.lit(c.name).alias("name"), start.alias("start"), (start + (F.lit(c.width) if c.text is None else x[f"g{c.text}"])).alias("end"))

    def match(x: Column) -> Column:
        found = [capture(x, c) for c in coding.found]
        captures = F.filter(F.array(*found), lambda c: c["start"] < c["end"]) if found else F.array()
        return F.struct(x["starts"].alias("start"), (x["starts"] + long(x)).alias("end"), captures.alias("captures")).cast(MATCH)

    whole = F.transform(F.filter(f"{name}_raw", lambda x: long(x) > 0), match)
    return materialise(df, name, whole).drop(f"{name}_sym", f"{name}_raw")


def place(i: Column, names: list[str] = ()) -> Column:
    """The match of one token, captured under each of the names."""
    captures = F.array(*[F.struct(F.lit(x).alias("name"), i.alias("start"), (i + 1).alias("end")) for x in names])
    return F.struct(i.alias("start"), (i + 1).alias("end"), captures.alias("captures")).cast(MATCH)


def token_matches(df: DataFrame, p: Pattern, layers: Layers, name: str) -> DataFrame:
    """Adds ``name``: a match for each token that satisfies a lone constraint, captured or not. No coding is needed."""
    token, names = lone(p)
    layers.check(token.constraint)
    n = F.col("sentence_length").cast("int")
    places = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: token_test(token.constraint, layers, i))).otherwise(F.array().cast("array<int>"))
    return materialise(df, name, F.transform(places, lambda i: place(i, names)))


def select_greedy(spans: Column) -> Column:
    """Of two overlapping spans the longer survives; equal lengths both do. Spans come in order of starts.

    Kept spans that overlap have one length, so their ends rise too, and all that overlap the next span are as long as the last.
    """
    length = lambda s: s["end"] - s["start"]

    def add(kept: Column, s: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        joins = (F.size(kept) == 0) | (last["end"] <= s["start"]) | (length(last) == length(s))
        rest = F.filter(kept, lambda k: k["end"] <= s["start"])
        return F.when(joins, F.concat(kept, F.array(s))).when(length(last) > length(s), kept).otherwise(F.concat(rest, F.array(s)))

    return F.aggregate(spans, F.array().cast(f"array<{MATCH}>"), add)


def sequence_matches(df: DataFrame, p: Pattern, layers: Layers, name: str, overlap: str = "select") -> DataFrame:
    """Adds ``name``, the array of matches of a pattern without edge steps."""
    df = all_starts(df, p, layers, name)
    if overlap == "select" and is_greedy(p):
        df = materialise(df, f"{name}_all", select_greedy(F.col(name))).drop(name).withColumnRenamed(f"{name}_all", name)
    return df
