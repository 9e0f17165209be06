"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard scores each key; the highest score takes it. The score is w / -ln(u), u in (0, 1)
from a hash of key and shard, so a shard takes keys in proportion to its weight and a new
shard takes rows only into itself. With equal weights u itself is compared, which orders
alike and needs no logarithm. All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges of the key for numbering slots; a range's rows of one shard are sorted in one task.
RANGES = 128
#: Keys that ranges of text keys are taken from.
SAMPLE = 10_000


def hashed(key: Column, shard: int) -> Column:
    """52 bits of the MD5 digest of "key:shard"."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("long")


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard that takes the key. A null key counts as the empty string; of equal scores the higher shard wins."""
    if not weights or any(not w > 0 for w in weights.values()):
        raise ValueError("shards need weights over 0")
    text = F.coalesce(key.cast("string"), F.lit(""))
    equal = len(set(weights.values())) == 1

    def score(shard: int, weight: float) -> Column:
        u = hashed(text, shard)
        return u if equal else F.lit(float(weight)) / -F.log((u + F.lit(0.5)) / F.lit(float(1 << 52)))

    scored = [F.struct(score(k, w).alias("score"), F.lit(k).alias("shard")) for k, w in sorted(weights.items())]
    return F.array_max(F.array(*scored))["shard"]


def range_of(key: Column, bounds: list) -> Column:
    """The number of bounds below the key, by a binary tree of comparisons; null keys are in range -1."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key <= F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(key.isNull(), F.lit(-1)).otherwise(tree(0, len(bounds)))


def slots(df: DataFrame, shard: str, key: str, ties: list[str], ranges: int = RANGES) -> DataFrame:
    """df with slot: each row's place in its shard, gapless from 0, by key (nulls first) and ties.

    Rows are counted by shard and key range first (partial sums, key column alone); a row's slot is
    its rank inside its range plus the rows of the ranges before, so no task sorts a whole shard. Keys of
    types without quantiles, such as text, are cut at those of a bounded sample (the SAMPLE keys of least hash); they only tell how even ranges are.
    """
    if isinstance(df.schema[key].dataType, T.NumericType):
        cuts = df.agg(F.percentile_approx(F.col(key), [i / ranges for i in range(1, ranges)], 10_000).alias("q")).first()["q"]
    else:
        some = sorted(r[0] for r in df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key)).limit(SAMPLE).collect())
        cuts = [some[len(some) * i // ranges] for i in range(1, ranges)] if some else []
    ranged = df.withColumn("__range", range_of(F.col(key), sorted(set(cuts or []))))
    before = Window.partitionBy(shard).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(shard, "__range").count().select(shard, "__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(shard, "__range").orderBy(F.col(key).asc_nulls_first(), *ties)
    return ranged.join(counts, [shard, "__range"]).withColumn("slot", F.row_number().over(inside) - 1 + F.col("__base")).drop("__range", "__base")


def assign(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", weights: Mapping[int, float] | None = None, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one more shard of the mean weight).

    size is the text's UTF-8 bytes plus 1 (null: 1, with the checksum of nothing). Rows of equal
    keys share a shard; the key is a row's identity, so rows that repeat it whole take slots of
    their own next to each other. Null keys form one key. An empty table gives no rows.
    """
    held = dict(weights or {i: 1.0 for i in range(n_shards)})
    if sorted(held) != list(range(n_shards)):
        raise ValueError("weights must name the shards 0 to n_shards - 1")
    grown = held | {n_shards: sum(held.values()) / n_shards}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(F.col(id_col), held).alias("shard"), rendezvous(F.col(id_col), grown).alias("grown_shard"),
    )
    return slots(rows, "shard", "doc_id", ["size", "text_crc32"], ranges)
