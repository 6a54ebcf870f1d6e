"""Tokens and edges as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import token_layers


def tokens(sentences: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """(doc_id, sentence_id, sentence_idx, pos, one column a layer). Only the layers asked for are read."""
    layers = layers or token_layers(sentences)
    if len(layers) == 1:
        return sentences.select("doc_id", "sentence_id", "sentence_idx", F.posexplode(layers[0]).alias("position", layers[0]))
    zipped = F.arrays_zip(*[F.col(x) for x in layers])
    rows = sentences.select("doc_id", "sentence_id", "sentence_idx", F.posexplode(zipped).alias("position", "t"))
    return rows.select("doc_id", "sentence_id", "sentence_idx", F.col("position").alias("pos_"), "t.*").withColumnRenamed("pos_", "position")


def edges(sentences: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, sentence_idx, src, dst, label)."""
    return sentences.select("doc_id", "sentence_id", "sentence_idx", F.inline("deps"))


def label_vocabulary(sentences: DataFrame) -> DataFrame:
    """(label, label_id): ids from 0 in order of labels, for distinct labels of the corpus."""
    from pyspark.sql import Window

    return edges(sentences).select("label").distinct().withColumn("label_id", F.row_number().over(Window.orderBy("label")) - 1)
