"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes are words. Targets: sources share ``share`` times all sizes by weight,
none above ``most`` times its own size (the excess is shared again by weight; in closed
form, the level at which the capped sum equals the total). The N words of the total are
apportioned: sources get integer quotas by the N highest quotients
target / (2k + 1). Each source is cut into equal blocks of its own, of a thousandth of
its target and ``BLOCK`` words at most, so that small sources are cut finely beside any other; its quota
in blocks is apportioned in the same way over its shards (documents by seeded hash). In a shard the documents lie in seeded
order on a line of words that is cut into blocks; every block is taken as often
as the quota allows evenly, and the rest are the blocks of lowest seeded hash. A
document's share is the sum of its overlaps with taken blocks.

Only contested seats are ranked: with C parties and N seats the divisor lies
within 1 +- C/(2N) of total/N, which fixes all seats but some 2C of them. Shards
bound the rows that one window sorts; they follow the source's row count, so a
source with a third of all rows is spread as well. Everything is DataFrame
operations.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; documents of size 0 and sources of size 0 have taken 0. Repeated rows
and ids count separately. An empty table gives an empty result. Only id, text
and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

SHARE, MOST = 1.5, 2
#: Words of a block at most, blocks in each source's target at least (or its single words), and documents of a shard.
BLOCK, SOURCE_BLOCKS, SHARD_ROWS = 2048, 1000, 20_000


def weights(position: Column) -> Column:
    """3, 1, 2, repeating, by position from 0."""
    return F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (position % 3 + 1).cast("int")).cast("double")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, rows) plus target. One row a source; the windows run over sources, not documents."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = sources.withColumn("weight", weights(F.row_number().over(order) - 1))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = Window.orderBy("full_at", F.col("source").isNull(), F.col("source").cast("binary"))
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    after = ranked.rowsBetween(0, Window.unboundedFollowing)
    # In order of the level at which a source is full: the level if all before are full and the rest are not.
    levels = (
        weighed.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("left", F.greatest(F.lit(0.0), F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))))
        .withColumn("level", F.col("left") / F.sum("weight").over(after))
        # The level rises while sources are full and is right at the first that isn't.
        .withColumn("settled", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything))
    )
    target = F.when(F.col("settled").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("settled.level") * F.col("weight")))
    return levels.select("source", "source_size", "rows", target.alias("target"))


def sainte_lague(parties: DataFrame, votes: str, seats: str, group: list[str], order: list[Column], most: str | None = None) -> DataFrame:
    """parties plus ``quota``: ``seats`` (constant in a group) go to the highest quotients votes / (2k + 1).

    Ties go by ``order``. Groups without votes or seats get quota 0. ``most``: a column no quota may pass;
    the bound must leave room for all seats, else fewer are given.
    """
    all_of = Window.partitionBy(*group)
    sure = (
        parties.withColumn("_n", F.count("*").over(all_of))
        .withColumn("_v", F.sum(votes).over(all_of))
        .withColumn("_ideal", F.when((F.col("_v") > 0) & (F.col(seats) > 0), F.col(votes) * F.col(seats) / F.col("_v")).otherwise(0.0))
        .withColumn("_slack", F.when(F.col(seats) > 0, F.col("_n") / (2.0 * F.col(seats))).otherwise(0.0))
        .withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_ideal") * (1 - F.col("_slack")) - 0.5)).cast("long"))
        .withColumn("_high", (F.floor(F.col("_ideal") * (1 + F.col("_slack")) + 0.5) + 1).cast("long"))
    )
    if most is not None:
        sure = sure.withColumn("_high", F.least("_high", F.col(most).cast("long"))).withColumn("_low", F.least("_low", "_high"))
    sure = sure.withColumn("_open", F.col(seats) - F.sum("_low").over(all_of))
    contested = (
        sure.where((F.col("_high") > F.col("_low")) & (F.col("_ideal") > 0))
        .withColumn("_k", F.explode(F.sequence("_low", F.col("_high") - 1)))
        .withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
        .withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_q"), *order, "_k")))
        .where(F.col("_r") <= F.col("_open"))
    )
    return sure, contested


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = SHARE,
    most: float = MOST,
    block: int = BLOCK,
    shard_rows: int = SHARD_ROWS,
    seed: int = 7,
) -> DataFrame:
    """Per row: id, source, size, source_size, target, taken (words, repeats counted), copies (whole times, 0 to ``most``)."""
    sized = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)).cast("long"), F.lit(0)).alias("size"),
        F.xxhash64(F.col(id_col), F.lit(seed)).alias("_h"),
        F.xxhash64(F.col(text_col), F.lit(seed)).alias("_h2"),
    )
    sized = cut(sized)
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), share, most)
    sources = cut(sources.withColumn("_sid", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))))
    # Quotas of words by source, in blocks that follow the source's own target.
    all_sources = Window.partitionBy("_all")
    by_source = sources.withColumn("_all", F.lit(1)).withColumn("_seats", F.floor(F.sum("target").over(all_sources) + 0.5).cast("long"))
    by_source = _quotas(by_source, "target", "_seats", ["_all"], [F.col("_sid")], ["_sid"], most_blocks=None)
    by_source = by_source.withColumn("_block", F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.col("target") / SOURCE_BLOCKS))).cast("long"))
    source_quota = F.floor(F.col("quota") / F.col("_block") + 0.5).cast("long")
    by_source = cut(by_source.select("_sid", "source", "source_size", "rows", "target", "_block", source_quota.alias("source_quota")))
    # Shards by seeded hash, as many as the source's rows need.
    shards = F.greatest(F.lit(1), F.ceil(F.col("rows") / shard_rows)).cast("long")
    placed = sized.join(by_source, sized["source"].eqNullSafe(by_source["source"])).drop(by_source["source"])
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64("_h", "_h2"), shards))
    cells = placed.groupBy("_sid", "_shard", "_block", "source_quota").agg(F.sum("size").alias("words"))
    cells = cells.withColumn("n_blocks", F.ceil(F.col("words") / F.col("_block")).cast("long"))
    cells = _quotas(cells, "words", "source_quota", ["_sid"], [F.col("_shard")], ["_sid", "_shard"], most_blocks=most)
    cells = cells.select("_sid", "_shard", "_block", "n_blocks", "quota")
    # Blocks taken: each floor(quota / n) times, and the rest by lowest seeded hash.
    blocks = cells.where("n_blocks > 0").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    lottery = Window.partitionBy("_sid", "_shard").orderBy(F.xxhash64("_sid", "_shard", "_b", F.lit(seed)), "_b")
    extra = F.row_number().over(lottery) <= F.col("quota") % F.col("n_blocks")
    blocks = blocks.withColumn("times", F.floor(F.col("quota") / F.col("n_blocks")).cast("long") + extra.cast("long"))
    # Documents on the shard's line of words, and their overlaps with blocks.
    line = Window.partitionBy("_sid", "_shard").orderBy("_h", "_h2", "_id").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("_end", F.sum("size").over(line)).withColumn("_begin", F.col("_end") - F.col("size"))
    # Words taken up to each block's begin, so that a document meets its first and last block only.
    so_far = Window.partitionBy("_sid", "_shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum(F.col("times") * F.col("_block")).over(so_far), F.lit(0)))
    blocks = blocks.select("_sid", "_shard", F.col("_b"), "times", "_before")

    first = blocks.select("_sid", "_shard", F.col("_b").alias("_b1"), F.col("times").alias("_t1"), F.col("_before").alias("_p1"))
    last = blocks.select("_sid", "_shard", F.col("_b").alias("_b2"), F.col("times").alias("_t2"), F.col("_before").alias("_p2"))
    laid = laid.withColumn("_b1", F.floor(F.col("_begin") / F.col("_block")).cast("long"))
    # A line that ends on a block's edge has no block there: the last word's block serves.
    laid = laid.withColumn("_b2", F.when(F.col("size") > 0, F.floor((F.col("_end") - 1) / F.col("_block"))).otherwise(F.col("_b1")).cast("long"))
    # Blocks grow with the corpus, so they are never broadcast.
    taken = laid.join(first.hint("merge"), ["_sid", "_shard", "_b1"], "left").join(last.hint("merge"), ["_sid", "_shard", "_b2"], "left")
    upto = lambda p, t, at, b: F.col(p) + F.col(t) * (F.col(at) - F.col(b) * F.col("_block"))
    amount = F.when(F.col("size") > 0, upto("_p2", "_t2", "_end", "_b2") - upto("_p1", "_t1", "_begin", "_b1")).otherwise(F.lit(0))
    # Whole copies: the share rounded by a seeded draw, so that its expectation is kept.
    draw = F.pmod(F.xxhash64("_id", "_h2", F.lit(seed + 1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    taken = taken.withColumn("_taken", F.coalesce(amount, F.lit(0)).cast("long")).withColumn(
        "copies", F.when(F.col("size") > 0, F.floor(F.col("_taken") / F.col("size") + draw)).otherwise(0).cast("long")
    )
    return taken.select(
        F.col("_id").alias(id_col),
        "source",
        "size",
        "source_size",
        "target",
        F.col("_taken").alias("taken"),
        "copies",
    )


def _quotas(parties: DataFrame, votes: str, seats: str, group, order, keys: list[str], most_blocks) -> DataFrame:
    most = None
    if most_blocks is not None:
        parties, most = parties.withColumn("_most", F.col("n_blocks") * int(most_blocks)), "_most"
    sure, contested = sainte_lague(parties, votes, seats, group, order, most)
    won = contested.groupBy(*keys).agg(F.count("*").alias("_won"))
    return sure.join(won, keys, "left").withColumn("quota", (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long"))


def op6(spark, sf_dir) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", "copies")
