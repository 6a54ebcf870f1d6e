"""Reading and storing corpora.

Input documents come as JSON lines, single objects or arrays, plain or gzipped.
Sentences are stored as Parquet, one row each.
"""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import DEPS, DOCUMENT, SchemaConfig, SchemaError


def read_jsonl(spark: SparkSession, paths, pattern: str = "*.json*") -> DataFrame:
    """One document a line; splittable unless gzipped. Lines that don't parse are left out, see ``read_checked``."""
    good, _ = read_checked(spark, paths, pattern)
    return good


def _reader(spark: SparkSession, pattern: str, whole: bool):
    schema = T.StructType([*DOCUMENT.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("pathGlobFilter", pattern).option("multiLine", whole).option("ignoreCorruptFiles", True)


def read_checked(spark: SparkSession, paths, pattern: str = "*.json*", whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, failed records with their file). ``whole_files``: each file is one object or array, over any number of lines."""
    rows = _reader(spark, pattern, whole_files).json(paths).withColumn("file", F.input_file_name())
    failed = F.col("_corrupt_record").isNotNull() | F.col("id").isNull()
    return rows.where(~failed).select(*DOCUMENT.names), rows.where(failed).select("file", "_corrupt_record")


def read_any(spark: SparkSession, path: str, pattern: str = "*.json*") -> DataFrame:
    """Files of any of the forms, gzip by its magic bytes. What doesn't parse is left out, see ``read_any_checked``."""
    return read_any_checked(spark, path, pattern)[0]


def read_any_checked(spark: SparkSession, path: str, pattern: str = "*.json*") -> tuple[DataFrame, DataFrame]:
    """(documents, failures: path and text), of files of any of the forms. A damaged gzip file fails as a whole, its text is null.

    Each file goes through one task as a whole, so use it for files of moderate size.
    """

    def text_of(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for data in batch.column("content").to_pylist():
                try:
                    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                    out.append(data.decode("utf-8", "replace"))
                except (OSError, EOFError, zlib.error):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], names=["path", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return parse_checked(files.mapInArrow(text_of, "path string, text string"), "text")


def parse_json(df: DataFrame, column: str) -> DataFrame:
    """Documents in a text column: an object, an array, or lines of objects. What doesn't parse gives none."""
    return parse_checked(df, column)[0]


def parse_checked(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of a text column. A failure has the other columns and the text, or the line, that gave no document with an id.

    A text is an array if it begins with a bracket. It is lines of objects, with keys in any order, if it has
    several lines and one of the first two is a whole object; else it is one object over any number of lines.
    """
    others = [c for c in df.columns if c != column]
    text = F.col(column)
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    whole = lambda x: F.coalesce(F.from_json(x, DOCUMENT)["id"].isNotNull(), F.lit(False))
    several = (F.size(lines) > 1) & (whole(F.get(lines, F.lit(0))) | whole(F.get(lines, F.lit(1))))
    record = lambda d, source: F.struct(d.alias("d"), source.alias("source"))
    by_line = F.transform(lines, lambda x: record(F.from_json(x, DOCUMENT), x))
    many = F.from_json(text, T.ArrayType(DOCUMENT))
    in_array = F.when(many.isNull(), F.array(record(F.lit(None).cast(DOCUMENT), text))).otherwise(F.transform(many, lambda d: record(d, F.to_json(d))))
    found = F.when(F.substring(F.ltrim(text), 1, 1) == "[", in_array).when(several, by_line).otherwise(F.array(record(F.from_json(text, DOCUMENT), text)))
    rows = df.select(*others, F.explode(found).alias("r"))
    failed = rows.where("r.d is null or r.d.id is null").select(*others, F.col("r.source").alias(column))
    return rows.where("r.d.id is not null").select("r.d.*"), failed


def layer(fields: Column, name: str) -> Column:
    tokens = F.filter(fields, lambda f: (f["name"] == name) & f["$type"].endswith("TokensField"))
    return F.get(tokens, F.lit(0))["tokens"]


def to_sentences(documents: DataFrame, config: SchemaConfig | None = None, graph: str = "dependencies") -> DataFrame:
    """One row a sentence with its layers, edges and roots. Layers that the configuration lacks are left out; no shuffle."""
    config = config or SchemaConfig()
    each = documents.select(F.col("id").alias("doc_id"), F.posexplode("sentences").alias("sentence_idx", "s"))
    fields = F.col("s.fields")
    edges = F.get(F.filter(fields, lambda f: (f["name"] == graph) & f["$type"].endswith("GraphField")), F.lit(0))
    deps = F.transform(edges["edges"], lambda e: F.struct(F.get(e, F.lit(0)).cast("int").alias("src"), F.get(e, F.lit(1)).cast("int").alias("dst"), F.get(e, F.lit(2)).alias("label")))
    return each.select(
        "doc_id",
        F.concat_ws("_", "doc_id", "sentence_idx").alias("sentence_id"),
        "sentence_idx",
        F.col("s.numTokens").cast("long").alias("sentence_length"),
        *[layer(fields, name).alias(name) for name in config.layers],
        F.coalesce(deps, F.array()).cast(DEPS).alias("deps"),
        F.coalesce(edges["roots"], F.array().cast("array<int>")).alias("roots"),
    )


def validate(sentences: DataFrame, layers: list[str]) -> DataFrame:
    """(doc_id, sentence_id, problem, error): edges beyond the sentence are errors, layers of another length warnings."""
    n = F.col("sentence_length")
    outside = F.exists("deps", lambda e: (e["src"] >= n) | (e["dst"] >= n) | (e["src"] < 0) | (e["dst"] < 0))
    found = [F.when(outside, F.struct(F.lit("edge beyond the sentence").alias("problem"), F.lit(True).alias("error")))]
    for name in layers:
        found.append(F.when(F.size(name) != n, F.struct(F.lit(f"layer {name} has another length").alias("problem"), F.lit(False).alias("error"))))
    return sentences.select("doc_id", "sentence_id", F.explode(F.array_compact(F.array(*found))).alias("p")).select("doc_id", "sentence_id", "p.*")


def write_corpus(sentences: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store sentences; ``mode='append'`` adds to a corpus. Readers see whole commits."""
    if mode not in ("append", "overwrite", "errorifexists"):
        raise SchemaError(f"unknown mode {mode!r}")
    sentences.write.mode(mode).parquet(path)


def open_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_gzip_json(documents: DataFrame, path: str) -> None:
    documents.write.option("compression", "gzip").json(path)


def glob_of(pattern: str) -> str:
    """File patterns ``*``, ``prefix*suffix`` or an exact name, as a path filter."""
    if pattern.count("*") > 1:
        raise SchemaError("a file pattern may hold one *")
    return pattern
