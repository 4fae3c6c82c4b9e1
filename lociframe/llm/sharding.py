"""Operator 3: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.llm.common import durable, pick

#: Rows that one numbering group may hold on average.
ROWS_PER_GROUP = 100_000
#: Numbering groups a shard is cut into at least.
LEAST_GROUPS = 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the best draw for ``key``: the least -ln(u) / weight, u a uniform hash of key and shard.

    A shard's draws depend on the key and on that shard alone. So a further shard takes only the keys for which
    its draw is the best, and a shard that goes gives up only its own keys. A key goes to shard s with
    probability weight_s / sum of weights. Shards of weight 0 take nothing. Null keys are one key like any other.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, one at least positive")
    text = key.cast("string")
    draws = [
        F.struct(
            (-F.log((F.shiftrightunsigned(F.xxhash64(text, F.lit(f"shard-{s}")), 11) + F.lit(0.5)) / F.lit(2.0**53)) / F.lit(float(w))).alias("draw"),
            F.lit(s).alias("shard"),
        )
        for s, w in enumerate(weights)
        if w > 0
    ]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def shard_documents(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float | None = 1.0) -> DataFrame:
    """Put every row into a shard and number the rows of each shard from 0 without gaps.

    Returns ``key``, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard: the shard
    once a further shard of ``grown_weight`` has come (null if that is None).

    Null text counts as empty: size 8, CRC 0. Rows with equal or null keys go to one shard, each with a slot of
    its own. An empty table gives an empty one. Other columns of ``docs`` are left out.

    One pass over the texts; what follows reads the narrow result. Slots come from two steps, so that no shard is
    numbered by one task: row numbers inside hashed groups of the shard, plus the sizes of the groups before
    (a table of shards times groups). Groups are dealt by a row hash that takes in the row's place in the
    narrow table, so rows that share a key, a text or both spread over the groups too.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("_text"), F.lit(""))
    narrow = (
        pick(docs, key, text)
        .toDF(key, "_text")
        .select(
            F.col(f"`{key}`"),
            (F.octet_length(body).cast("long") + 8).alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            rendezvous(F.col(f"`{key}`"), weights).alias("shard"),
            (F.lit(None).cast("int") if grown_weight is None else rendezvous(F.col(f"`{key}`"), [*weights, grown_weight])).alias("grown_shard"),
            F.monotonically_increasing_id().alias("_at"),
        )
    )
    kept = durable(narrow, "shards")
    groups = max(LEAST_GROUPS, -(-kept.count() // (ROWS_PER_GROUP * len(weights))))
    kept = kept.withColumn("_group", F.pmod(F.xxhash64("_at", F.lit("slot")), F.lit(groups)).cast("int"))
    sizes = kept.groupBy("shard", "_group").agg(F.count("*").alias("_n"))
    before = sizes.select(
        F.col("shard"),
        F.col("_group"),
        F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy("shard", "_group").orderBy(F.col(f"`{key}`"), "text_crc32", "_at")
    return (
        kept.withColumn("_row", F.row_number().over(inside))
        .join(before, ["shard", "_group"])
        .select(
            F.col(f"`{key}`"),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )


#: Production parameters: 24 shards of equal weight.
SHARDS = 24


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * SHARDS)
