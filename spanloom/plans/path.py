"""Paths over edges, inside a row.

A path is segments joined by edge steps. A segment is a pattern without steps; a
step leaves the last token of one segment's match and arrives at the first of
the next. Edges are filtered once per step by label and by whether their ends
can belong to the neighbouring segments, then joined in order; all of this happens within
the sentence, so a path of any length needs no shuffle. Parallel edges give
separate paths; a node may occur several times on a path.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.lang.ast import Capture, Edge, EitherStep, Path, Pattern, PatternError, RepeatStep, Sequence, Stay, Step, Steps, has_path, sequence

from .predicate import Layers, token_test, value_test
from .symbols import MATCH, all_starts, lone, mandatory, materialise, place, settle, token_matches

_PAIRS = "array<struct<a:int,b:int>>"


def flatten(p: Pattern) -> tuple[list[Pattern], list[Step]]:
    """Segments and the steps between them."""
    if isinstance(p, Path):
        segments, steps = flatten(p.source)
        for step, target in p.hops:
            more, inner = flatten(target)
            segments, steps = segments + more, steps + [step] + inner
        return segments, steps
    if isinstance(p, Sequence) and has_path(p):
        segments, steps = flatten(p.parts[0])
        for part in p.parts[1:]:
            more, inner = flatten(part)
            segments = segments[:-1] + [sequence(segments[-1], more[0])] + more[1:]
            steps = steps + inner
        return segments, steps
    if has_path(p):
        raise PatternError("edge steps can't stand inside a repetition, an alternative or an assertion")
    return [p], []


def _label_test(label, value: Column) -> Column:
    return F.coalesce(value_test(label, value), F.lit(False))


def _labels(step: Step) -> list:
    """Tests of labels of which one holds for some edge wherever the step is taken; empty: no such test."""
    match step:
        case Edge(_, label) if label is not None:
            return [label]
        case EitherStep(parts):
            each = [_labels(p) for p in parts]
            return [x for found in each for x in found] if all(each) else []
        case Steps(parts):
            return next((found for p in parts if (found := _labels(p))), [])
        case RepeatStep(inner, low, _) if low > 0:
            return _labels(inner)
    return []


def _edges(step: Step) -> list[Edge]:
    """The edges of which a step takes one; empty for a step of any other kind."""
    match step:
        case Edge():
            return [step]
        case EitherStep(parts):
            each = [_edges(p) for p in parts]
            return [e for found in each for e in found] if all(each) else []
    return []


def _direct_pairs(edges: list[Edge], leaves: Column, arrives: Column, deps: Column) -> Column:
    """(from, to) of the edges from a place that fits to one that fits: one pass, places are looked up by number."""
    parts = []
    for e in edges:
        near, far = ("src", "dst") if e.direction == "out" else ("dst", "src")

        def fits(x: Column) -> Column:
            ends = F.get(leaves, x[near]) & F.get(arrives, x[far])
            return F.coalesce(ends if e.label is None else _label_test(e.label, x["label"]) & ends, F.lit(False))

        parts.append(F.transform(F.filter(deps, fits), lambda x: F.struct(x[near].alias("a"), x[far].alias("b"))).cast(_PAIRS))
    return F.concat(*parts)


def once(value: Column, use) -> Column:
    """What ``use`` makes of a value that is computed once: inside a lambda an expression is computed anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _compose(first: Column, step: Step, deps: Column) -> Column:
    """Pairs of a step after those of ``first``, each computed once."""

    def join(first: Column, second: Column) -> Column:
        return F.flatten(F.transform(first, lambda x: F.transform(F.filter(second, lambda y: y["a"] == x["b"]), lambda y: F.struct(x["a"].alias("a"), y["b"].alias("b"))))).cast(_PAIRS)

    def go(first: Column) -> Column:
        return once(F.array_distinct(F.transform(first, lambda x: x["b"])), lambda sources: once(step_pairs(step, sources, deps), lambda second: join(first, second)))

    return once(first, go)


def step_pairs(step: Step, sources: Column, deps: Column) -> Column:
    """(from, to) pairs of a step from the given distinct places. Edges to other places of the sentence only."""
    match step:
        case Stay():
            return F.transform(sources, lambda s: F.struct(s.alias("a"), s.alias("b"))).cast(_PAIRS)
        case Edge(direction, label):
            near, far = ("src", "dst") if direction == "out" else ("dst", "src")
            labelled = deps if label is None else F.filter(deps, lambda e: _label_test(label, e["label"]))
            leaving = F.filter(labelled, lambda e: F.array_contains(sources, e[near]))
            return F.transform(leaving, lambda e: F.struct(e[near].alias("a"), e[far].alias("b"))).cast(_PAIRS)
        case EitherStep(parts):
            return F.concat(*[step_pairs(p, sources, deps) for p in parts])
        case Steps(parts):
            out = step_pairs(parts[0], sources, deps)
            for p in parts[1:]:
                out = _compose(out, p, deps)
            return out
        case RepeatStep(inner, 0, 1):
            return F.concat(step_pairs(Stay(), sources, deps), step_pairs(inner, sources, deps))
        case RepeatStep(inner, low, high):
            return _closure(inner, low, high, sources, deps)
    raise TypeError(step)


def _closure(inner: Step, low: int, high: int | None, sources: Column, deps: Column) -> Column:
    """Nodes reached in low to high steps, as a set. Without a bound, the frontier ends when nothing new turns up."""
    state = f"struct<frontier:{_PAIRS},seen:{_PAIRS}>"
    stay = step_pairs(Stay(), sources, deps)

    def advance(frontier: Column) -> Column:
        return F.array_distinct(_compose(frontier, inner, deps))

    frontier = stay
    for _ in range(low):
        frontier = advance(frontier)
    begin = F.struct(frontier.alias("frontier"), frontier.alias("seen")).cast(state)
    most = F.size(deps) + 1 if high is None else F.lit(high - low)
    rounds = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))

    def turn(acc: Column, _: Column) -> Column:
        fresh = F.array_except(advance(acc["frontier"]), acc["seen"])
        after = once(fresh, lambda x: F.struct(x.alias("frontier"), F.concat(acc["seen"], x).alias("seen")).cast(state))
        return F.when(F.size(acc["frontier"]) == 0, acc).otherwise(after)

    return F.aggregate(rounds, begin, turn)["seen"]


def _extend_by_tokens(paths: Column, pairs: Column, names: list[str]) -> Column:
    """As ``_extend``, where each arrival is a span of its own."""

    def leave(x: Column) -> Column:
        return F.transform(F.filter(pairs, lambda e: e["a"] == x["at"]), lambda e: F.struct(e["b"].alias("at"), F.concat(x["spans"], F.array(place(e["b"], names))).alias("spans")))

    return F.flatten(F.transform(paths, leave))


def _extend(paths: Column, pairs: Column, target: Column) -> Column:
    """Each path once for each pair that leaves its place, with the target's span that begins at the arrival."""

    def leave(x: Column) -> Column:
        def go(e: Column) -> Column:
            found = F.get(F.filter(target, lambda s: s["start"] == e["b"]), F.lit(0))
            return once(found, lambda s: F.struct((s["end"] - 1).alias("at"), F.concat(x["spans"], F.array(s)).alias("spans")))

        return F.transform(F.filter(pairs, lambda e: e["a"] == x["at"]), go)

    return F.flatten(F.transform(paths, leave))


def path_matches(df: DataFrame, p: Pattern, layers: Layers, name: str) -> DataFrame:
    """Adds ``name``: one match a path, spanning its lowest to highest token, with captures c0, c1, ... in path order and the named ones."""
    if "deps" not in df.columns:
        raise PatternError("edge steps need the column deps")
    label = None
    if isinstance(p, Capture):
        label, p = p.name, p.inner
    segments, steps = flatten(p)
    df = settle(df, p, [c for s in segments for c in mandatory(s)], layers)
    if not all(isinstance(s, RepeatStep) and s.low == 0 or isinstance(s, Stay) for s in steps):
        df = df.where(F.size("deps") > 0)
    for step in steps:
        if labels := _labels(step):
            df = df.where(F.exists("deps", lambda e: reduce(or_, [_label_test(x, e["label"]) for x in labels])))
    # Between lone tokens an edge is tested at both ends by place, so only other segments need their spans listed.
    tokens = [lone(s) for s in segments]
    direct = [bool(_edges(step)) and tokens[k] is not None and tokens[k + 1] is not None for k, step in enumerate(steps)]
    helpers, n = [], F.col("sentence_length").cast("int")
    for k, s in enumerate(segments):
        around = direct[max(0, k - 1) : k + 1]
        if tokens[k] and any(around):
            constraint = tokens[k][0].constraint
            layers.check(constraint)
            helpers.append(f"{name}_t{k}")
            places = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: token_test(constraint, layers, i))).otherwise(F.array().cast("array<boolean>"))
            df = materialise(df, helpers[-1], places).where(F.array_contains(helpers[-1], True))
        if not all(around) or not around:
            helpers.append(f"{name}_s{k}")
            if tokens[k]:
                df = token_matches(df, s, layers, helpers[-1])
            else:
                df = all_starts(df, s, layers, helpers[-1])
            df = df.where(F.size(helpers[-1]) > 0)
    # Edges of direct steps first: they say cheaply whether there is any path.
    for k, step in enumerate(steps):
        if direct[k]:
            helpers.append(f"{name}_e{k}")
            df = materialise(df, helpers[-1], _direct_pairs(_edges(step), F.col(f"{name}_t{k}"), F.col(f"{name}_t{k + 1}"), F.col("deps")))
            df = df.where(F.size(helpers[-1]) > 0)
    # Paths so far: the place they have come to, and the spans on the way.
    def begin(s: Column) -> Column:
        return F.struct((s["end"] - 1).alias("at"), F.array(s).alias("spans"))

    if not (direct and direct[0]):
        df = materialise(df, f"{name}_p0", F.transform(f"{name}_s0", begin))
        helpers.append(f"{name}_p0")
    for k, step in enumerate(steps):
        before, pairs = f"{name}_p{k}", F.col(f"{name}_e{k}")
        helpers.append(f"{name}_p{k + 1}")
        if direct[k] and k == 0:
            after = F.transform(pairs, lambda e: F.struct(e["b"].alias("at"), F.array(place(e["a"], tokens[0][1]), place(e["b"], tokens[1][1])).alias("spans")))
        elif direct[k]:
            after = _extend_by_tokens(F.col(before), pairs, tokens[k + 1][1])
        else:
            target = F.col(f"{name}_s{k + 1}")
            helpers += [f"{name}_e{k}", f"{name}_f{k}", f"{name}_g{k}"]
            df = materialise(df, f"{name}_f{k}", F.array_distinct(F.transform(before, lambda x: x["at"])))
            df = materialise(df, f"{name}_g{k}", F.transform(target, lambda s: s["start"]))
            found = F.filter(step_pairs(step, F.col(f"{name}_f{k}"), F.col("deps")), lambda e: F.array_contains(f"{name}_g{k}", e["b"]))
            df = materialise(df, f"{name}_e{k}", found)
            after = _extend(F.col(before), pairs, target)
        df = materialise(df, f"{name}_p{k + 1}", after)
        df = df.where(F.size(f"{name}_p{k + 1}") > 0)

    def finish(x: Column) -> Column:
        spans = x["spans"]
        low, high = F.array_min(F.transform(spans, lambda s: s["start"])), F.array_max(F.transform(spans, lambda s: s["end"]))
        order = F.transform(spans, lambda s, i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("name"), s["start"].alias("start"), s["end"].alias("end")))
        named = F.flatten(F.transform(spans, lambda s: s["captures"]))
        whole = [F.array(F.struct(F.lit(label).alias("name"), low.alias("start"), high.alias("end")))] if label else []
        return F.struct(low.alias("start"), high.alias("end"), F.concat(order, named, *whole).alias("captures")).cast(MATCH)

    ordered = F.sort_array(F.transform(f"{name}_p{len(steps)}", finish))
    return materialise(df, name, ordered).drop(*helpers)
