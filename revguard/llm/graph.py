"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revguard.llm.common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), root being the component's smallest node.

    Each round hangs every node's larger neighbours onto its smallest one, then
    every node's smaller neighbours, until nothing moves: a number of rounds that
    is logarithmic in the nodes, with joins and minima by node only.  Minima are
    summed up before the shuffle and the join on a hub's many edges is one that
    Spark splits.  Each round is checkpointed, so a lost executor costs one
    round.  Nulls and loops are dropped; an empty table gives an empty result.
    """
    u, v = F.col("u"), F.col("v")
    e = cut_lineage(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    mark = _mark(e)
    while True:
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        large = cut_lineage(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = cut_lineage(small)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(u.alias("node"), v.alias("root")).unionByName(e.select(v.alias("node"), v.alias("root"))).distinct()


def _mark(e: DataFrame) -> tuple:
    """A fingerprint of the edge set: equal when a round has changed nothing."""
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())
