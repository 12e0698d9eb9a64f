"""Sharding by jump consistent hashing, in DataFrame expressions only.

The shard of a row follows from its key and the number of shards alone; there is no ring table.
When a shard is appended, a row either stays or moves into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import col, staged

# Multiplier of the 64-bit linear congruential generator of the published algorithm.
MULTIPLIER = 2862933555777941757
MASK = 0xFFFFFFFF


def _product(x: Column, factor: int) -> tuple[Column, Column]:
    """Low and high 32 bits of a 32-bit ``x`` times a 32-bit constant, without ever passing 63 bits."""
    low, high = x * F.lit(factor & 0xFFFF), x * F.lit(factor >> 16)
    total = low + high.bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16)
    return total.bitwiseAND(F.lit(MASK)), F.shiftright(total, 32) + F.shiftright(high, 16)


def key_bits(df: DataFrame, keys: list[str]) -> Column:
    """64 bits of the stable key: an integer key as it is, anything else hashed; null is key 0."""
    kinds = dict(df.dtypes)
    if len(keys) == 1 and kinds[keys[0]] in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(col(keys[0]).cast("long"), F.lit(0))
    return F.xxhash64(*[col(k) for k in keys])


def jump_shard(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard of a 64-bit ``key`` among ``shards`` and among one more.

    Both follow from one walk: each jump goes to a later shard, so the last stop below
    ``shards`` and the last stop below ``shards + 1`` are read off the same sequence.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    zero = F.lit(0).cast("long")
    start = F.struct(
        zero.alias("stop"),
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(MASK)).alias("low"),
        zero.alias("shard"),
        zero.alias("grown"),
    )

    def jump(at: Column, _: Column) -> Column:
        low, carry = _product(at["low"], MULTIPLIER & MASK)
        cross_high, _unused = _product(at["high"], MULTIPLIER & MASK)
        cross_low, _unused = _product(at["low"], MULTIPLIER >> 32)
        low = low + F.lit(1)
        high = (carry + F.shiftright(low, 32) + cross_high + cross_low).bitwiseAND(F.lit(MASK))
        ratio = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + F.lit(1)).cast("double")
        moved = F.struct(
            ((at["stop"] + F.lit(1)).cast("double") * ratio).cast("long").alias("stop"),
            high.alias("high"),
            low.bitwiseAND(F.lit(MASK)).alias("low"),
            F.when(at["stop"] < shards, at["stop"]).otherwise(at["shard"]).alias("shard"),
            at["stop"].alias("grown"),
        )
        return F.when(at["stop"] > shards, at).otherwise(moved)

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(shards + 1)), start, jump)
    return F.transform(F.array(walked), lambda w: F.struct(w["shard"].cast("int").alias("shard"), w["grown"].cast("int").alias("grown")))[0]


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1 (a null text has none), ``slot`` numbers the rows of a
    shard from 0 without gaps, ``grown_shard`` is the shard with one more shard. Repeated keys
    share a shard and get slots of their own; null keys count as key 0. Other columns of
    ``docs``, whatever their names, are not read. Empty in, empty out.

    Slots need no shard in one task: rows are numbered inside each (input partition, shard), and
    a running sum over those counts gives where each such block begins.
    """
    stops = jump_shard(key_bits(docs, [key]), shards)
    body = F.coalesce(col(text), F.lit(""))
    rows = staged(
        docs.select(
            col(key).alias("doc_id"),
            (F.octet_length(body).cast("long") + F.lit(1)).alias("size"),
            F.crc32(body).alias("text_crc32"),
            stops.alias("at"),
        ).select(
            "doc_id", "size", "text_crc32", F.col("at.shard").alias("shard"), F.col("at.grown").alias("grown_shard"),
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth"),
        )
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        rows.groupBy("part", "shard").count()
        .select("part", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    )
    inside = F.row_number().over(Window.partitionBy("part", "shard").orderBy("nth"))
    return (
        rows.withColumn("inside", inside)
        .join(begins, ["part", "shard"])
        .select(
            F.col("doc_id").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("begin") + F.col("inside") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
