"""Queries over a DataFrame of annotated sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.lang.ast import Choice, Look, Pattern, PatternError, has_path
from spanloom.lang.parser import parse
from spanloom.operators import results
from spanloom.operators.stats import corpus_stats
from spanloom.plans.path import path_matches
from spanloom.plans.predicate import Layers
from spanloom.plans.symbols import MATCH, lone, mandatory, sequence_matches, settle, token_matches
from spanloom.sources.schema import KEYS, SchemaConfig, token_layers

class Engine:
    """Compiles query texts to DataFrames of scored sentences with matched spans.

    ``sentences`` has the key columns ``doc_id, sentence_id, sentence_idx``, the
    column ``sentence_length``, token layers (``ARRAY<STRING>``) and, for edge steps, ``deps``.
    """

    def __init__(
        self,
        sentences: DataFrame,
        output_fields: list[str] | None = None,
        default_field: str = "word",
        config: SchemaConfig | None = None,
    ):
        missing = {*KEYS, "sentence_length"} - set(sentences.columns)
        if missing:
            raise PatternError(f"the sentences lack {', '.join(sorted(missing))}")
        self.sentences, self.default_field = sentences, default_field
        self.layers = Layers(token_layers(sentences))
        wanted = output_fields if output_fields is not None else config.output_fields if config else ["word"]
        self.output_fields = [f for f in wanted if f in sentences.columns]

    def compile(self, query: str | Pattern) -> Pattern:
        return parse(query, self.default_field) if isinstance(query, str) else query

    def hits(self, query: str | Pattern, overlap: str = "select") -> DataFrame:
        """All hits, unordered: keys, score, matches, output fields. One row a sentence."""
        p = self.compile(query)
        if isinstance(p, Look):
            return self._assertion(p)
        out = self._matched(p, overlap)
        kept = out.where(F.size("matches") > 0)
        return kept.select(*KEYS, results.score(F.col("matches")).alias("score"), "matches", *self.output_fields)

    def _matched(self, p: Pattern, overlap: str) -> DataFrame:
        needed = self.sentences
        if isinstance(p, Choice) and has_path(p):
            parts = [self._matched(x, overlap).select(*KEYS, "matches", *self.output_fields) for x in p.parts]
            both = parts[0]
            for x in parts[1:]:
                both = both.unionByName(x)
            rest = [F.first(c).alias(c) for c in self.output_fields]
            return both.groupBy(*KEYS).agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"), *rest)
        if has_path(p):
            return path_matches(needed, p, self.layers, "matches")
        settled = settle(needed, p, mandatory(p), self.layers)
        if lone(p):
            return token_matches(settled, p, self.layers, "matches")
        return sequence_matches(settled, p, self.layers, "matches", overlap)

    def _assertion(self, p: Look) -> DataFrame:
        """A bare assertion filters sentences and has no spans: a positive one keeps those that hold its pattern."""
        none = F.array().cast(f"array<{MATCH}>")
        kept = self.sentences
        if p.positive:
            inner = Engine(self.sentences, self.output_fields, self.default_field)
            found = inner._matched(p.inner, "per_start")
            kept = found.where(F.size("matches") > 0).drop("matches")
        return kept.select(*KEYS, F.lit(1.0).alias("score"), none.alias("matches"), *self.output_fields)

    def query(self, query: str | Pattern, limit: int | None = None, overlap: str = "select") -> DataFrame:
        """Hits by falling score, then by key; the best ``limit`` of them."""
        return results.top(self.hits(query, overlap), limit)

    def respond(self, query: str, limit: int = 10) -> dict:
        """The response of the query service as a dict."""
        return results.response(self, query, limit)

    def stats(self) -> DataFrame:
        return corpus_stats(self.sentences)
