"""The UTC instants of the photo library's three timestamp fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.deliveries import latest_values
from lumenfold.operators.timestamps import with_instants


def photo_instants(items_raw: DataFrame, exports: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per item_id: the instant of exif_dt as epoch_s (null if none), and the asked repaired fields."""
    want = list(dict.fromkeys(["exif_dt", "exif_offset", "export_id", *(fields or [])]))
    items = latest_values(items_raw, "item_id", want)
    homes = exports.groupBy("export_id").agg(F.min("home_tz").alias("home_tz"))
    return with_instants(items.join(homes, "export_id", "left"), "exif_dt", "home_tz", "exif_offset").select("item_id", *(fields or []), "epoch_s", "epoch_s_how")


def library_instants(items_raw: DataFrame, sidecars_raw: DataFrame, exports: DataFrame) -> DataFrame:
    """(field, row_id, epoch_s, epoch_s_how) for every value of exif_dt, taken_ts and creation_ts; null epoch_s if it denotes nothing.

    The three fields share one pass of parsing and one as-of join.
    """
    items = latest_values(items_raw, "item_id", ["exif_dt", "exif_offset", "export_id"])
    sidecars = latest_values(sidecars_raw, "sidecar_id", ["taken_ts", "creation_ts", "export_id"])
    pair = lambda name: F.struct(F.lit(name).alias("field"), F.col(name).alias("value"))
    values = items.select(F.lit("exif_dt").alias("field"), F.col("item_id").alias("row_id"), F.col("exif_dt").alias("value"), "exif_offset", "export_id").unionByName(
        sidecars.select(F.inline(F.array(pair("taken_ts"), pair("creation_ts"))), F.col("sidecar_id").alias("row_id"), F.lit(None).cast("string").alias("exif_offset"), "export_id")
    )
    homes = exports.groupBy("export_id").agg(F.min("home_tz").alias("home_tz"))
    return with_instants(values.where(F.col("value").isNotNull()).join(homes, "export_id", "left"), "value", "home_tz", "exif_offset").select("field", "row_id", "epoch_s", "epoch_s_how")
