"""Queries over streams of documents.

From sentences to hits everything is local to a row, so a query runs unchanged
on a stream; the order and limit of results stay with batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.engine import Engine
from spanloom.sources.reader import to_sentences
from spanloom.sources.schema import DOCUMENT, SchemaConfig


def read_documents(spark: SparkSession, path: str, pattern: str = "*.json*", files_per_trigger: int | None = None) -> DataFrame:
    """JSON lines that arrive in a folder, as a stream of documents."""
    reader = spark.readStream.schema(DOCUMENT).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def stream_hits(documents: DataFrame, query: str, config: SchemaConfig | None = None) -> DataFrame:
    """Hits of a query over a stream of documents."""
    return Engine(to_sentences(documents, config), config=config).hits(query)


def stream_unique(hits: DataFrame, arrived: str, delay: str) -> DataFrame:
    """Each sentence once within the watermark, for inputs that may deliver a document twice."""
    return hits.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["doc_id", "sentence_id"])
