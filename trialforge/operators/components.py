"""Connected components of graphs whose nodes and edges lie in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut


def edges_mark(e: DataFrame) -> tuple:
    """What tells a set of edges from another: their number, and their whole hashes as a 128-bit sum and by xor; no number of
    edges overflows them."""
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of any orderable type, structs too -> (node, root): root is the smallest node of node's component; roots
    have no row.

    Alternating large-star and small-star rounds. Each round ends in a table in the shared folder; the number of rounds
    grows with the logarithm of the longest path. Null or self edges are left out; an empty input gives no rows."""

    e = edges.where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = edges_mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(lower.withColumnRenamed("m", "v")).distinct())
        after = edges_mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
