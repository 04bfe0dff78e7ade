"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialise import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node passes its least neighbour (itself included) to its larger neighbours, or to its smaller ones and itself."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # small star: edges run from the larger node u to the smaller node v
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38, 0)))")).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that an edge touches; the component is named by its least node.

    Null ends and loops are ignored. Each round is one table in the shared folder; rounds grow with the
    logarithm of a component's width, and a hub's edges are summed before they are shuffled.
    """
    a, b = F.col(src), F.col(dst)
    now = materialise(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = _digest(now)
    while seen[0]:
        after = materialise(_star(_star(now, large=True), large=False))
        digest = _digest(after)
        discard(now)
        now = after
        if digest == seen:
            break
        seen = digest
    # a settled table has one edge from each other node to its component's least node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
