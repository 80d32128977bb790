"""Best representative of each duplicate group: field-by-field survivorship and the choice of a keeper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def survivor(field: str, ts: str | Column | None = None, priority: Column | None = None) -> Column:
    """Aggregate: the value of the greatest (is not null, source priority, timestamp, value).

    Ties of priority and timestamp go to the larger value; null if the field is null in every row; a null priority or
    timestamp is below any other.
    """
    stamp = F.lit(0) if ts is None else F.col(ts) if isinstance(ts, str) else ts
    trust = F.lit(0) if priority is None else priority
    return F.max(F.struct(F.col(field).isNotNull().alias("set"), trust.alias("trust"), stamp.alias("at"), F.col(field).alias("value")))["value"].alias(field)


def survive(df: DataFrame, keys: list[str], fields: list[str], ts: str | None = None, priority: Column | None = None) -> DataFrame:
    """One row per key with the surviving value of each field, all in a single aggregation.

    Partial maxima are formed before the shuffle, so a key with a third of all rows is no burden. Rows with a null in a
    key form no group; an empty table gives an empty table; other columns, whatever their names, are dropped.
    """
    whole = [F.col(k).isNotNull() for k in keys]
    kept = df
    for c in whole:
        kept = kept.where(c)
    return kept.groupBy(*keys).agg(*[survivor(f, ts, priority) for f in fields])


def pixels(width: str = "width", height: str = "height", stored_w: str = "stored_w", stored_h: str = "stored_h") -> Column:
    """width x height, or the stored sizes if one of them is null or not positive, else 0."""
    area = lambda w, h: F.when((F.col(w) > 0) & (F.col(h) > 0), F.col(w).cast("long") * F.col(h))
    return F.coalesce(area(width, height), area(stored_w, stored_h), F.lit(0).cast("long"))


def located(lat: str = "exif_lat", lon: str = "exif_lon") -> Column:
    """1 if both coordinates are set and not 0/0, else 0."""
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.when(known & ~((F.col(lat) == 0) & (F.col(lon) == 0)), 1).otherwise(0)


def keepers(members: DataFrame, favorites: DataFrame, group: str = "group_item_id", key: str = "item_id") -> DataFrame:
    """(group, keeper_<key>): the member first by pixels, camera, position, favorite, file size, then smallest key.

    members: group, key and the repaired fields; favorites: the keys that are favorited. One left join and one
    aggregation of a composite struct. A null or negative size counts as 0, a null camera flag as 0.
    """
    liked = favorites.select(F.col(key)).distinct().withColumn("_liked", F.lit(1))
    rank = F.struct(
        pixels().alias("pixels"),
        F.when(F.col("has_camera_exif") == 1, 1).otherwise(0).alias("camera"),
        located().alias("position"),
        F.coalesce("_liked", F.lit(0)).alias("liked"),
        F.greatest(F.coalesce("file_size", F.lit(0)), F.lit(0)).cast("long").alias("size"),
        (-F.col(key)).alias("first"),
    )
    return members.join(liked, key, "left").groupBy(group).agg((-F.max(rank)["first"]).alias(f"keeper_{key}"))
