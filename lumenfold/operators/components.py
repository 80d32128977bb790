"""Connected components by alternating large-star and small-star, for the library's own grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each vertex, larger (or smaller) than it, to the smallest of its neighbourhood."""
    turned = edges.select(F.col("b").alias("v"), F.col("a").alias("u"))
    near = edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
    # For the large star both directions; for the small star each edge from its larger end.
    near = near.unionByName(turned) if large else edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    least = near.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
    joined = near.join(least, "v")
    if large:
        out = joined.where("u > v").select(F.col("u").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, component): every vertex of an edge with the smallest vertex of its component.

    edges: columns a and b; loops, repeats and null ends change nothing. Ends when a round leaves the stars as they are.
    """
    good = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct()
    now, n = scratch.save_counted(good.select("a", "b"), "edges")
    seen = None
    while n:
        before = now
        now, n = scratch.save_counted(_star(_star(now, True), False), "edges")
        mark = now.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()["h"]
        scratch.drop(before)
        if (n, mark) == seen:
            break
        seen = (n, mark)
    return now.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())
