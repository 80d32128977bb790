"""Running sums and ranks over a total order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import Scratch


def running_sum(df: DataFrame, order: list[Column | str], value: Column, out: str, scratch: Scratch) -> DataFrame:
    """Add `out`: the sum of value over the rows ahead in ascending order; rows equal in all of it follow each other in any order.

    Rows are range-partitioned and written, sums run inside the ranges, and a table with a row for each range gives what is ahead of it.
    An empty table stays empty.
    """
    keys = {f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    at = scratch.save(df.withColumns({**keys, "_v": value.cast("long")}).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = at.groupBy("_part").agg(F.sum("_v").alias("_s"))
    ahead = sums.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_ahead"))
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = at.withColumn("_in", inside).join(F.broadcast(ahead), "_part")  # as many rows as ranges
    return d.withColumn(out, F.col("_ahead") + F.col("_in")).drop(*keys, "_v", "_part", "_in", "_ahead")


def numbered(df: DataFrame, order: list[Column | str], out: str, scratch: Scratch) -> DataFrame:
    """Add `out`: dense numbers from 1 in ascending order."""
    return running_sum(df, order, F.lit(1), out, scratch).withColumn(out, F.col(out) + 1)
