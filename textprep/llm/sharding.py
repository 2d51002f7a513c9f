"""Sharding by weighted rendezvous hashing (law ``key``).

Each (record key, shard) pair gets a uniform hash u and the cost ``-ln(u) / weight``; the
record goes to the cheapest shard, so a shard gets records in proportion to its weight,
and one more shard takes records only into itself.  All of it is column expressions; no
row moves to find its shard.

Cases: a null key hashes as a null (one shard takes them all); a null text has size 16
and crc 0; repeated rows share a shard and get different slots; an empty table gives an
empty result; further columns are kept by ``rendezvous_shards``, whatever their names (one
named like an output is replaced), and ignored by ``slots``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textprep.llm.common import bounded_broadcast, explode_count, fresh_name, hash53, pinned

SLOT_BUCKET_ROWS = 4096  # mean rows that one window group orders


def shard_cost(key: Column, shard: Column, weight: Column) -> Column:
    u = (hash53(key, shard) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.ln(u) / weight


def rendezvous_shards(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard",
                      grown_weight: float | None = None, grown: str = "grown_shard") -> DataFrame:
    """``df`` with the shard (0-based) of each row; with ``grown_weight`` also its shard
    if one more shard of that weight existed.  Ties go to the smaller shard number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    k = F.col(key)
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    costs = F.transform(shards, lambda s: F.struct(shard_cost(k, s["shard"], s["weight"]).alias("cost"), s["shard"].alias("shard")))
    best = fresh_name("_best", [*df.columns, shard, grown, key])
    out = df.withColumn(best, F.array_min(costs)).withColumn(shard, F.col(f"{best}.shard"))
    if grown_weight is not None:
        n = F.lit(len(weights))
        out = out.withColumn(grown, F.when(shard_cost(k, n, F.lit(float(grown_weight))) < F.col(f"{best}.cost"), n).otherwise(F.col(shard)))
    return out.drop(best)


def slots(rows: DataFrame, shard: str, identity: Sequence[str], slot: str = "slot") -> DataFrame:
    """The rows' ``shard`` and ``identity`` columns with a gapless 0-based slot in each shard.

    Equal rows are counted first and get a run of slots, so a record repeated any number
    of times is one row of the ordering.  Each shard is cut into hash buckets of a few
    thousand rows; a bucket starts where the ones before it end."""
    cols = [shard, *identity]
    counted = pinned(rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_m")), "slots")
    per_shard = counted.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    n_buckets = max(1, math.ceil((per_shard["n"] or 0) / SLOT_BUCKET_ROWS))
    keyed = counted.withColumn("_bucket", F.pmod(F.xxhash64(*identity), F.lit(n_buckets)))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = pinned(
        keyed.groupBy(shard, "_bucket").agg(F.sum("_m").alias("_sum"))
        .select(F.col(shard), "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")), "slot-starts")
    within = Window.partitionBy(shard, "_bucket").orderBy(*identity).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_first", F.coalesce(F.sum("_m").over(within), F.lit(0))).join(
        bounded_broadcast(starts, 100_000), [shard, "_bucket"])
    return explode_count(placed, "_m", "_i").select(
        *cols, (F.col("_start") + F.col("_first") + F.col("_i")).cast("bigint").alias(slot))
