"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SMALL, Work


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every greater neighbour of a node is linked to the node's least neighbour (itself included). Small: the node and its lesser neighbours are."""
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    own = least.select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).where("u <> v").distinct()


def components(edges: DataFrame, work: Work, name: str, rounds: int = 50) -> DataFrame:
    """node, component (least node of its component) of every node with an edge; edges has u and v (long).

    Each round is two joins on the node, with partially aggregated minima, and is written to the
    shared folder; a round that changes nothing ends the loop. What the driver sees is two numbers a round.
    At most SMALL edges are one partition, so that their rounds need no exchange.
    """
    at_once = False

    def kept(df: DataFrame, i: int) -> DataFrame:
        out = work.write(df, f"{name}-{i}")
        return out.coalesce(1) if at_once else out

    now = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), 0)
    mark = lambda df: tuple(df.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)")).first())
    seen = mark(now)
    at_once = seen[0] <= SMALL  # stars never add edges beyond the first ones and their nodes
    now = now.coalesce(1) if at_once else now
    for i in range(1, rounds + 1):
        if not seen[0]:
            break
        large = _stars(now, True)
        now = kept(_stars(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False), i)
        work.drop(f"{name}-{i - 1}")
        before, seen = seen, mark(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
