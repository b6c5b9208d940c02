"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass one scatters records with seeded hashes: the shard by highest random weight over
(key, shard number), so that one more shard takes rows only into itself, and within a shard
a bucket of about `bucket_bytes`; the scattered records are written. Pass two shuffles each
bucket by a Fisher-Yates permutation of its positions (Spark's `shuffle`, seeded), gives each
record its slot, and write_shards() writes the shards in the order of slots.

Only the permutation, a few bytes a record, is held in memory; the records of a bucket pass
through Spark's external sort. The hash of the bucket takes in the record's place in its
partition, so neither one key with many texts nor one text many times over fills a bucket;
as pass one is written, a task run again can't disagree with what others have read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.common import written


def shard_of(key: Column, n_shards: int, seed: int = 17) -> Column:
    """Highest random weight: the shard whose hash with the key is the largest."""
    bits = max(1, n_shards.bit_length())
    ranked = [F.xxhash64(F.lit(seed), key, F.lit(s)).bitwiseAND(F.lit(-(1 << bits))).bitwiseOR(F.lit(s)) for s in range(n_shards)]
    best = F.greatest(*ranked) if n_shards > 1 else F.lit(0)
    return best.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def shard(docs: DataFrame, n_shards: int = 16, *, key: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = 32 << 20, least_buckets: int = 8) -> DataFrame:
    """docs with shard (int), slot (long, gapless from 0 in each shard) and grown_shard (int, with one shard more).

    Null keys share a shard; a null text counts as empty; very long texts only make their bucket
    longer; equal rows get slots of their own, in no set order among themselves; an empty table
    gives no rows; input columns named like the added ones are replaced.
    """
    docs = docs.drop("shard", "slot", "grown_shard")
    k, t = F.col(key), F.col(text)
    own = shard_of(k, n_shards, seed)
    sizes = docs.groupBy(own.alias("s")).agg(F.sum(F.coalesce(F.octet_length(t), F.lit(0)) + 64).alias("n")).collect()  # one row a shard
    buckets = [least_buckets] * n_shards
    for r in sizes:
        buckets[r.s] = max(least_buckets, math.ceil(r.n / bucket_bytes))
    scattered = docs.withColumns({"shard": own, "grown_shard": shard_of(k, n_shards + 1, seed), "__order": F.xxhash64(F.lit(seed + 1), k, t, F.monotonically_increasing_id())})
    n_buckets = F.element_at(F.array(*map(F.lit, buckets)), F.col("shard") + 1)
    scattered = written(scattered.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 2), "__order"), n_buckets).cast("int")), "scattered")
    in_shard = Window.partitionBy("shard").orderBy("__bucket")
    counts = scattered.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).cast("int").alias("__n"))
    moves = written(counts.select(
        "shard", "__bucket",
        F.coalesce(F.sum("__n").over(in_shard.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"),
        F.shuffle(F.sequence(F.lit(0), F.col("__n") - 1), F.lit(seed)).alias("__moves"),
    ), "moves")
    placed = scattered.withColumn("__at", F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("__order")))
    return placed.join(moves, ["shard", "__bucket"]).select(
        *docs.columns, "shard", (F.col("__first") + F.element_at("__moves", F.col("__at"))).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """Writes the shards as Parquet, one folder each, and reads them again.

    Each file holds whole buckets in the order of their slots; buckets lie together already, so nothing is shuffled anew.
    """
    sharded.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path).select(*sharded.columns)
