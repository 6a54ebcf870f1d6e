"""License scanning: base phrases, and templates with optional and replaceable regions.

Texts are lower-cased in A-Z and cut into words of digits, a-z and characters
outside ASCII. A template is license wording with markup: ``<<optional>> ...
<</optional>>`` encloses words that may be left out, ``<<var LOW-HIGH>>`` stands
for LOW to HIGH words of any kind. Each template compiles to a position
automaton over words, run bit-parallel; a text carries the template's label
where the automaton accepts a run of consecutive words, so that mandatory wording
matches exactly. An automaton runs only where its anchor occurs, the longest stretch
of mandatory words.

Defined cases: a null or empty text has no words, no labels and score 0.
Several matches of one template count once in the labels and each in the spans.
Overlapping templates all count. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: Phrase -> label.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Label -> template.
TEMPLATES = {
    "mit-notice": "<<optional>>this <<var 1-4>> is<</optional>> <<optional>>released<</optional>> <<optional>>licensed<</optional>> under the <<optional>>terms of the<</optional>> MIT License",
    "apache-2.0-notice": "licensed under the Apache License <<optional>>,<</optional>> Version 2.0 <<optional>>(the License) you may not use <<var 1-6>> except in compliance with the License<</optional>>",
    "gpl-3.0-notice": "<<optional>>this <<var 1-4>> is<</optional>> licensed under the <<optional>>terms of the<</optional>> GNU General Public License <<optional>>as published by the Free Software Foundation<</optional>> <<optional>>either<</optional>> version 3 <<optional>>of the License<</optional>>",
    "gpl-2.0-notice": "<<optional>>this <<var 1-4>> is<</optional>> licensed under the <<optional>>terms of the<</optional>> GNU General Public License <<optional>>as published by the Free Software Foundation<</optional>> <<optional>>either<</optional>> version 2 <<optional>>of the License<</optional>>",
    "cc-by-nc-4.0-notice": "licensed under <<optional>>a Creative Commons Attribution NonCommercial<</optional>> CC BY-NC 4.0 <<optional>>International License<</optional>>",
    "cc-by-4.0-notice": "licensed under <<optional>>a Creative Commons Attribution<</optional>> CC BY 4.0 <<optional>>International License<</optional>>",
    "bsd-3-clause-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<var 0-400>> neither the name of <<var 1-12>> nor the names of <<optional>>its<</optional>> <<var 0-6>> contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mit-terms": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>>(the Software)<</optional>> to deal in the software without restriction",
    "copyright-notice": "copyright <<optional>>(c)<</optional>> <<var 1-12>> all rights reserved",
}

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARKUP = re.compile(r"<<(optional|/optional|var (\d+)-(\d+))>>|([^<]+|<)")


def words_of(text: bytes) -> list[bytes]:
    return _WORDS.findall(text.translate(_LOWER))


class Automaton:
    """Position automaton of a template. Bit i of a state set: word i of the template was just read."""

    def __init__(self, label: str, template: str):
        self.label, self.words, self.follow = label, [], []
        tree, stack = [], []
        for tag, low, high, plain in _MARKUP.findall(template):
            if tag == "optional":
                stack.append(tree)
                tree = []
            elif tag == "/optional":
                if not stack:
                    raise ValueError(f"{label}: an optional region isn't opened")
                tree, inner = stack.pop(), tree
                tree.append(inner)
            elif tag:
                if int(high) < int(low):
                    raise ValueError(f"{label}: wrong bounds")
                tree += [None] * int(low) + ([self._nested(int(high) - int(low))] if int(high) > int(low) else [])
            else:
                tree += words_of(plain.encode())
        if stack:
            raise ValueError(f"{label}: an optional region isn't closed")
        self.anchor = self._anchor(tree)
        if not self.anchor:
            raise ValueError(f"{label}: no mandatory wording")
        nullable, self.first, self.last = self._build(tree)
        if nullable:
            raise ValueError(f"{label}: it accepts no words at all")
        self.any = sum(1 << i for i, w in enumerate(self.words) if w is None)
        self.by_word = {w: self.any | sum(1 << i for i, x in enumerate(self.words) if x == w) for w in {*self.words} - {None}}

    @staticmethod
    def _nested(n: int) -> list:
        """Up to n words as (any (any (...)?)?)?: each position is followed by the next only."""
        out: list = [None]
        for _ in range(n - 1):
            out = [None, out]
        return out

    @staticmethod
    def _anchor(tree: list) -> list[bytes]:
        runs: list[list[bytes]] = [[]]
        for x in tree:
            if isinstance(x, bytes):
                runs[-1].append(x)
            else:
                runs.append([])
        return max(runs, key=lambda r: len(b" ".join(r)))

    def _build(self, tree: list) -> tuple[bool, int, int]:
        """Nullable, first and last positions of a sequence; fills follow. Recursion is as deep as regions nest."""
        nullable, first, last = True, 0, 0
        for x in tree:
            if isinstance(x, list):
                n, f, l = self._optional(x)
            else:
                f = l = 1 << len(self.words)
                n = False
                self.words.append(x)
                self.follow.append(0)
            self._link(last, f)
            first |= f if nullable else 0
            last = l | (last if n else 0)
            nullable &= n
        return nullable, first, last

    def _optional(self, tree: list) -> tuple[bool, int, int]:
        # A chain of optional words is laid out in a loop: it may be hundreds long.
        first = last = 0
        ends = 0
        while True:
            inner = tree[-1] if len(tree) == 2 and tree[0] is None and isinstance(tree[1], list) else None
            _, f, l = self._build(tree[:1] if inner else tree)
            if not first:
                first = f
            self._link(last, f)
            last = l
            ends |= l
            if inner is None:
                return True, first, ends
            tree = inner

    def _link(self, sources: int, to: int) -> None:
        while sources:
            i = (sources & -sources).bit_length() - 1
            self.follow[i] |= to
            sources &= sources - 1

    def match_at(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run of words from start, or -1."""
        states, end, at, follow = self.first, -1, start, self.follow
        while at < len(words):
            states &= self.by_word.get(words[at], self.any)
            if not states:
                break
            at += 1
            if states & self.last:
                end = at
            reach, rest = 0, states
            while rest:
                low = rest & -rest
                reach |= follow[low.bit_length() - 1]
                rest ^= low
            states = reach
        return end

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Longest matches from left to right, not overlapping. Starts are tried only if a first word fits."""
        out, at = [], 0
        open_start = bool(self.first & self.any)
        starts = {w for w, mask in self.by_word.items() if mask & self.first}
        while at < len(words):
            if (open_start or words[at] in starts) and (end := self.match_at(words, at)) > 0:
                out.append((at, end))
                at = end
            else:
                at += 1
        return out


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases.items()]
        self.automata = [Automaton(label, t) for label, t in templates.items()]
        gap, side = rb"[^0-9a-z\x80-\xff]+", (rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])")
        seek = lambda ws: re.compile(side[0] + b"(?=" + gap.join(map(re.escape, ws)) + side[1] + b")")
        self.phrase_seekers = [(max(ws, key=len), seek(ws), label) for ws, label in self.phrases]
        self.anchors = [(max(a.anchor, key=len), seek(a.anchor), a) for a in self.automata]

    def scan(self, text: bytes | None) -> tuple[int, int, int | None, int | None, list[str], list[tuple[str, int, int]]]:
        """n_words, n_base, first and last start, base labels, template matches (label, start, end in words)."""
        low = (text or b"").translate(_LOWER)
        inside = _IS_WORD[np.frombuffer(low, np.uint8)]
        begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        if len(inside) and inside[0]:
            begins = np.concatenate([[0], begins])
        places, labels = [], set()
        for key, seeker, label in self.phrase_seekers:
            if key in low and (found := [m.start() for m in seeker.finditer(low)]):
                labels.add(label)
                places += found
        at = np.searchsorted(begins, places)
        matches, words = [], None
        for key, seeker, automaton in self.anchors:
            if key in low and seeker.search(low):
                words = _WORDS.findall(low) if words is None else words
                matches += [(automaton.label, a, b) for a, b in automaton.spans(words)]
        lowest, highest = (int(at.min()), int(at.max())) if places else (None, None)
        return len(begins), len(places), lowest, highest, sorted(labels), sorted(matches, key=lambda m: (m[1], m[2], m[0]))


@lru_cache(maxsize=8)
def _scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(dict(phrases), dict(templates))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None,
) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Score: 1 where a template matches, 0.5 where only phrases do, else 0. Spans are
    template matches as structs (label, start, end) in words. A narrow map.
    """
    given = tuple((PHRASES if phrases is None else phrases).items()), tuple((TEMPLATES if templates is None else templates).items())

    def setup():
        scanner = _scanner(*given)

        def work(texts):
            out = []
            for text in texts:
                n, base, first, last, labels, matches = scanner.scan(text)
                both = sorted({*labels, *(m[0] for m in matches)})
                spans = [{"label": a, "start": b, "end": c} for a, b, c in matches]
                out.append((n, base, first, last, ",".join(labels), ",".join(both), 1.0 if matches else 0.5 if labels else 0.0, spans))
            return [list(c) for c in zip(*out)] or [[]] * 8

        return work

    return map_texts(
        docs, id_col, text_col,
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int>>",
        setup,
    )


def op3(spark, sf_dir) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
