"""Sentences from plain tables, with synthetic layers and graphs. Made for tests and benchmarks; not an analysis of language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import DEPS


def _no_empty(pieces: Column) -> Column:
    return F.array_remove(pieces, "")


def _between(t: Column, first: str, last: str) -> Column:
    """Whether a text begins with a character of an ASCII range. Texts compare by bytes, so nothing is cut off to look at it."""
    return (t >= first) & (t < chr(ord(last) + 1))


def synthetic(rows: DataFrame) -> DataFrame:
    """Adds layers and the synthetic tree to rows (doc_id, sentence_idx, word): token p >= 1 hangs on (p - 1) div 2 under ``dep{p mod 4}``."""
    # Each layer comes from the words alone, so that a query computes the layers it reads and no others.
    lemma_of = lambda t: F.rtrim(F.lower(t), F.lit(".,;:!?"))
    # The words once a row: every layer is made from them, and a filter on a layer would cut the line again.
    rows = rows.select("doc_id", "sentence_idx", F.explode(F.array("word")).alias("word")).where(F.size("word") > 0)

    def tag(t: Column) -> Column:
        # The first character decides most tokens; expressions are left to those that begin with neither digit nor letter, the lemma to those with a g.
        return (
            F.when(_between(t, "0", "9"), "CD")
            .when(_between(t, "A", "Z"), "UP")
            .when(~_between(t, "a", "z") & t.rlike(r"\A[\x00-\x7F]*\z") & ~t.rlike("[A-Za-z0-9]"), "PUNCT")
            .when((t.contains("g") | t.contains("G")) & lemma_of(t).endswith("ing"), "ING")
            .otherwise("LOW")
        )

    entity = F.transform("word", lambda t, i: F.when((i > 0) & _between(t, "A", "Z"), "B-CAP").otherwise("O"))
    n, labels = F.size("word"), F.array(*[F.lit(f"dep{k}") for k in range(4)])
    tree = F.when(
        n > 1,
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda p: F.struct(F.shiftright(p - 1, 1).alias("src"), p.alias("dst"), F.get(labels, p % 4).alias("label")),
        ),
    ).otherwise(F.array().cast(DEPS))
    return rows.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat_ws("_", F.col("doc_id").cast("string"), F.col("sentence_idx").cast("string")).alias("sentence_id"),
        F.col("sentence_idx").cast("int").alias("sentence_idx"),
        n.cast("long").alias("sentence_length"),
        "word",
        F.transform("word", lambda t: F.lower(t)).alias("norm"),
        F.transform("word", lemma_of).alias("lemma"),
        F.transform("word", tag).alias("tag"),
        entity.alias("entity"),
        tree.cast(DEPS).alias("deps"),
        F.array(F.lit(0)).alias("roots"),
    )


def _spread(table: DataFrame, key: str, *others: str) -> DataFrame:
    """Rows dealt over the cores by key. A file is read by as many tasks as it has row groups, often one, and what follows costs far more than this shuffle."""
    return table.select(key, *others).repartition(key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each line with a token; tokens are what spaces separate."""
    table = _spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    table = table.select("doc_id", F.posexplode(F.split("text", "\n")).alias("sentence_idx", "line"))
    return synthetic(table.select("doc_id", "sentence_idx", _no_empty(F.split("line", " ")).alias("word")))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each turn."""
    table = _spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "text")
    words = _no_empty(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "))
    return synthetic(table.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sentence_idx"), words.alias("word")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each user: event types in order of time; edges lead to the next event."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    ordered = table.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    words = F.transform("e", lambda x: x["event_type"])
    n = F.size("e")
    chain = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda p: F.struct(p.alias("src"), (p + 1).alias("dst"), F.lit("next").alias("label")))).otherwise(F.array().cast(DEPS))
    return ordered.select(
        F.col("user_id").cast("string").alias("doc_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("_0")).alias("sentence_id"),
        F.lit(0).alias("sentence_idx"),
        n.cast("long").alias("sentence_length"),
        words.alias("word"),
        chain.cast(DEPS).alias("deps"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star for each order with items: the status in the middle, return flags around it."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("i")
    )
    heads = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    flags = F.transform("i", lambda x: x["l_returnflag"])
    words = F.concat(F.array("o_orderstatus"), flags)
    star = F.transform("i", lambda x, k: F.struct(F.lit(0).alias("src"), (k + 1).alias("dst"), F.lower(x["l_returnflag"]).alias("label")))
    return heads.join(items, heads["o_orderkey"] == items["l_orderkey"]).select(
        F.col("o_orderkey").cast("string").alias("doc_id"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("_0")).alias("sentence_id"),
        F.lit(0).alias("sentence_idx"),
        F.size(words).cast("long").alias("sentence_length"),
        words.alias("word"),
        star.cast(DEPS).alias("deps"),
    )
