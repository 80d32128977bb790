"""Reading repeated deliveries: per key and field the latest value that is not null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_values(df: DataFrame, key: str, fields: list[str], ts: str = "scanned_at") -> DataFrame:
    """One row per key; each field has its value of the latest ts among the key's rows where it is not null.

    One aggregation with map-side partials, so a key delivered any number of times costs no more than its rows.
    Cases: a null key is no key and gives no row; of equal ts the larger value wins; a null ts is older than any;
    a field that is null in all rows stays null; an empty table gives an empty table; other columns are dropped.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[latest(f, ts).alias(f) for f in fields])


def latest(field: str, ts: str) -> Column:
    """Aggregate: the greatest (is not null, ts, value), and of it the value."""
    return F.max(F.when(F.col(field).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(field).alias("v"))))["v"]
