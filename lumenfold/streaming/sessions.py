"""Sessions of events: bursts of a stream by gap, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, keys: list[str], ts: str, gap: str, watermark: str | None = None) -> DataFrame:
    """One row per key and session: first and last time and count. Events exactly a gap apart are one session.

    Works on a table and on a stream; a stream drops events later than the watermark.
    """
    t = F.col(ts).cast("timestamp")
    d = events.withColumn("_t", t)
    if watermark:
        d = d.withWatermark("_t", watermark)
    s = d.groupBy(*keys, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n"), F.min("_t").alias("start_ts"), F.max("_t").alias("end_ts"))
    return s.drop("w")
