"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as runs of characters other than space and \x09-\x0D; the same set that bytes.split() cuts at.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set (local tests)."""
    sc = spark.sparkContext
    if (held := sc.getCheckpointDir()) is not None:
        return held
    if (named := sc.getConf().get("spark.checkpoint.dir", "")) != "":
        sc.setCheckpointDir(named)
    else:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while (name := f"_{name}") in taken:
        pass
    return name


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def as_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text column."""
    return F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary")


#: Rows of a batch that a worker unpacks at a time.
SLICE = 1000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of SLICE rows, so that a worker holds few unpacked texts."""
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE):
            yield batch.slice(low, SLICE)


def give_back() -> None:
    """Return a worker's free memory to the system: idle workers stay beside the next stage's tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    schema: str,
    setup: Callable[[], Callable[[list[bytes | None]], list[list]]],
) -> DataFrame:
    """Narrow map over whole texts: no shuffle, one Arrow batch in memory at a time.

    ``setup()`` runs once a task and returns a function from a batch of UTF-8
    texts (None for null) to the output columns in ``schema`` order, without the
    id. The id column keeps its type and comes first. Other columns of ``df``
    are pruned, so names that clash don't matter.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    source = df.select(F.col(id_col).alias("_id"), as_bytes(text_col).alias("_text"))
    added = StructType.fromDDL(schema)
    full = StructType([source.schema["_id"], *added.fields])
    arrow_types = [f.type for f in to_arrow_schema(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for part in slices(batches):
            columns = work(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, type=t) for c, t in zip(columns, arrow_types))],
                names=full.names,
            )
        give_back()

    return source.mapInArrow(run, full).withColumnRenamed("_id", id_col)
