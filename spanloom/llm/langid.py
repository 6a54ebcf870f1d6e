"""Language identification by compression.

Each language has a raw-content zstandard dictionary cut from training texts. A
text is folded to lower-case letters, split into blocks so that the dictionary
counts throughout a long text, and every block is compressed with each
dictionary; the language whose frames are smallest in sum wins. The prediction
is rejected when the margin to the runner-up is narrow.

Defined cases: a null text, an empty text or a text without a letter gives
``und`` with score 0 and is rejected. Equal sums go to the language that comes
first in code-point order, with score 0. With an empty training set everything
is ``und``. Only the id, text and label columns are read.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import give_back, map_texts, slices

UNKNOWN = "und"
#: Bounds of the fitting sample: texts a language, bytes taken of each, bytes of a dictionary.
SAMPLE_TEXTS, SAMPLE_BYTES, DICT_BYTES = 400, 1024, 112 * 1024
#: The labels learned at most; further ones (the rarest) raise an error.
MAX_LANGUAGES = 256
#: Short texts take a higher level: their sizes differ by few bytes.
LEVEL, SHORT_LEVEL, BLOCK, SHORT = 5, 12, 4096, 200
#: A prediction is rejected when 1 - best/second is below this.
MIN_MARGIN = 0.002

#: Put before short pieces: a run that compresses, else zstandard stores them as they are.
_PAD = bytes(96)
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def fold(text: str) -> bytes:
    """Lower-case text with runs of ASCII non-letters as single spaces; empty without a letter."""
    if not any(map(str.isalpha, text)):
        return b""
    return b" %b " % b" ".join(text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split())


def fit(
    train: DataFrame,
    text_col: str = "text",
    label_col: str = "lang",
    sample_texts: int = SAMPLE_TEXTS,
    sample_bytes: int = SAMPLE_BYTES,
    dict_bytes: int = DICT_BYTES,
) -> dict[str, bytes]:
    """Dictionaries by language from a bounded sample: the texts of lowest hash, each distinct text once.

    The driver gets at most ``sample_texts`` pieces of ``sample_bytes`` characters a language.
    """
    rows = train.select(F.col(label_col).cast("string").alias("_l"), F.col(text_col).alias("_t")).where(
        "_l is not null and _t is not null"
    )
    # Distinct texts, as copies pass the threshold together: of few distinct texts all are taken, however often they occur.
    hashed = rows.withColumn("_h", F.xxhash64("_t", F.lit(17)))
    counts = {r["_l"]: r["n"] for r in hashed.groupBy("_l").agg(F.approx_count_distinct("_h").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    if not counts:
        return {}
    # Hash threshold by label: some four times the sample passes, the rest never reaches the sort.
    share = F.element_at(
        F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4.0 * sample_texts / max(n, 1)))]), F.col("_l")
    )
    unit = (F.shiftrightunsigned(F.col("_h"), 11) / F.lit(float(1 << 53))).cast("double")
    picked = (
        hashed.where(unit < share)
        .groupBy("_l", "_h")
        .agg(F.min(F.substring("_t", 1, sample_bytes)).alias("_t"))
        .withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy("_h")))
        .where(F.col("_r") <= sample_texts)
        .collect()
    )
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in picked:
        parts.setdefault(r["_l"], []).append((r["_r"], fold(r["_t"])))
    return {k: b"".join(x for _, x in sorted(v))[-dict_bytes:] or b" " for k, v in sorted(parts.items())}


class Classifier:
    """Sums of compressed sizes under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN):
        self.labels, self.min_margin = sorted(dictionaries), min_margin
        self.compressors, self.short = ([self._compressor(dictionaries[k], level) for k in self.labels] for level in (LEVEL, SHORT_LEVEL))

    @staticmethod
    def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
        parameters = zstandard.ZstdCompressionParameters.from_level(
            level,
            source_size=BLOCK,
            dict_size=len(dictionary),
            write_content_size=0,
            write_checksum=0,
            write_dict_id=0,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(dict_data=raw, compression_params=parameters)

    def sizes(self, folded: bytes) -> list[int]:
        """Of the whole text; a short one also counts with each first word left out, as sizes are whole bytes."""
        if len(folded) > SHORT:
            pieces, compressors = [folded[i : i + BLOCK] for i in range(0, len(folded), BLOCK)], self.compressors
        else:
            pieces, compressors = [_PAD + folded[m:] for m in range(len(folded) - 1) if folded[m] == 32], self.short
        return [sum(len(c.compress(p)) for p in pieces) for c in compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        folded = fold(text) if text else b""
        if not folded or not self.labels:
            return UNKNOWN, 0.0, False
        order = sorted(zip(self.sizes(folded), self.labels))
        if len(order) == 1:
            return order[0][1], 1.0, True
        if order[0][0] >= (1.0 - self.min_margin) * order[1][0]:  # narrow: the sizes under all compressors decide
            pieces = [folded[m : m + BLOCK] for m in range(0, len(folded), BLOCK)] + [_PAD + folded[m : m + 64] for m in range(0, len(folded), 64)]
            finer = [size + sum(len(c.compress(p)) for p in pieces for c in (a, b)) for size, a, b in zip(self.sizes(folded), self.compressors, self.short)]
            order = sorted(zip(finer, self.labels))
        score = 1.0 - order[0][0] / order[1][0]
        return order[0][1], score, score >= self.min_margin


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN
) -> DataFrame:
    """Per row: id, lang_pred, score, accepted. A narrow map; the dictionaries travel with the tasks."""

    def setup():
        classifier = Classifier(dictionaries, min_margin)

        def work(texts):
            found = [classifier.predict(t.decode("utf-8", "replace") if t is not None else None) for t in texts]
            return [list(c) for c in zip(*found)] or [[], [], []]

        return work

    return map_texts(docs, id_col, text_col, "lang_pred string, score double, accepted boolean", setup)


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows whose prediction is accepted, with all their columns. A narrow filter over whole rows."""
    position = docs.columns.index(text_col)

    def run(batches):
        classifier = Classifier(dictionaries, min_margin)
        for part in slices(batches):
            texts = part.column(position).to_pylist()
            yield part.filter(pa.array([classifier.predict(t)[2] for t in texts], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def fold_of(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def op1(spark, sf_dir) -> DataFrame:
    """Fit on the rows whose fold is not 2, predict every row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = fit(docs.where(fold_of() != 2))
    held = F.coalesce(fold_of() == 2, F.lit(False))
    return identify(docs, dictionaries).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
