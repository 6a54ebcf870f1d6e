"""Column functions on spans, sentences and edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_length(s: Column) -> Column:
    return s["end"] - s["start"]


def span_contains(s: Column, place: Column) -> Column:
    return (place >= s["start"]) & (place < s["end"])


def span_overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def sentence_text(word: str | Column = "word") -> Column:
    return F.array_join(word, " ")


def match_text(word: Column, start: Column, end: Column) -> Column:
    """Words of a span; null where it is empty or out of bounds."""
    inside = (start >= 0) & (start < end) & (end <= F.size(word))
    return F.when(inside, F.array_join(F.slice(word, start + 1, end - start), " "))


def deps_string(deps: str | Column = "deps") -> Column:
    """Edges as ``from:to:label``, separated by spaces."""
    return F.array_join(F.transform(deps, lambda e: F.concat_ws(":", e["src"].cast("string"), e["dst"].cast("string"), e["label"])), " ")


def outgoing(deps: Column, place: Column) -> Column:
    return F.filter(deps, lambda e: e["src"] == place)


def incoming(deps: Column, place: Column) -> Column:
    return F.filter(deps, lambda e: e["dst"] == place)
