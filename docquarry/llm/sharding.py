"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a pseudo-random number for a key; with weights the draw is
-ln(u)/weight, and the shard with the smallest draw owns the record.  The owner
depends on the key and the set of shards only, so a new shard takes records from
the others but never moves one between them.

Null keys count as one key of their own and all go to one shard; null texts have
no bytes.  Rows with equal keys share a shard.  Slots number a shard's rows
without gaps from 0, by bucket of a hash, then by key, checksum and size; rows
equal in all of these are interchangeable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task numbers, on average.
ROWS_PER_BUCKET = 100_000


def draw(key: Column, shard: int, weight: float = 1.0, seed: int = 42) -> Column:
    """The shard's draw for a key: exponential with the weight as its rate."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(shard), key), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float], seed: int = 42) -> Column:
    """The owning shard among len(weights) shards; ties go to the lower number."""
    if not weights or min(weights) <= 0:
        raise ValueError("at least one shard, and positive weights, are needed")
    best = F.least(*(F.struct(draw(key, i, w, seed).alias("d"), F.lit(i).alias("s")) for i, w in enumerate(weights))) if len(weights) > 1 else F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("s"))
    return best["s"]


def assign_shards(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", grown_weight: float = 1.0, rows_per_bucket: int = ROWS_PER_BUCKET, seed: int = 42) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard).

    The texts are read twice, once for the number of rows in every bucket, and
    never shuffled: what is exchanged is one slim row for each row.
    """
    n = len(weights)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("\0null"))
    slim = docs.select(F.col(id_col).alias("id"), key.alias("key"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    best = reduce(lambda a, b: F.least(a, b), [F.struct(draw(F.col("key"), i, w, seed).alias("d"), F.lit(i).alias("s")) for i, w in enumerate(weights)])
    slim = slim.withColumn("best", best)
    grown = F.when(draw(F.col("key"), n, grown_weight, seed) < F.col("best.d"), F.lit(n)).otherwise(F.col("best.s"))
    buckets = max(1, -(-docs.count() // (rows_per_bucket * n)))
    # rows of one key spread over the buckets by their text
    bucket = F.pmod(F.xxhash64("key", "text_crc32", "size", F.lit(seed + 1)), F.lit(buckets)).cast("int")
    slim = slim.select("id", "key", "size", "text_crc32", F.col("best.s").alias("shard"), grown.alias("grown_shard"), bucket.alias("bucket"))
    # one row for each of shards x buckets: their number is known beforehand
    counts = slim.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size")
    numbered = slim.withColumn("at", F.row_number().over(within) - 1).join(offsets, ["shard", "bucket"])
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"), "grown_shard")
