"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_stats(sentences: DataFrame) -> DataFrame:
    """One row: documents, sentences, tokens, edges."""
    return sentences.agg(
        F.countDistinct("doc_id").alias("documents"),
        F.count("*").alias("sentences"),
        F.coalesce(F.sum(F.size("word")), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.sum(F.size("deps")), F.lit(0)).cast("long").alias("edges"),
    )


def field_names(sentences: DataFrame) -> list[str]:
    return sentences.schema.fieldNames()
