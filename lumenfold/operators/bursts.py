"""Bursts told by file names or by time and likeness, ranked by sharpness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.bits import hamming
from lumenfold.functions.localtime import subsec
from lumenfold.functions.names import burst_key
from lumenfold.session import Scratch

# Shares of dark and bright pixels from which a frame is badly exposed, and the score of a frame too many.
DARK_MAX, BRIGHT_MAX, EXTRA = 0.5, 0.2, 0.8


def filename_bursts(items: DataFrame) -> DataFrame:
    """(burst, item_id): frames of one folder whose names share a burst's key, from two on."""
    keyed = items.select("item_id", "folder", burst_key(F.col("filename")).alias("key")).where("key is not null")
    many = keyed.groupBy("folder", "key").agg(F.count("*").alias("n"), F.min("item_id").alias("burst")).where("n > 1")
    return keyed.join(many, ["folder", "key"]).select("burst", "item_id")


def time_bursts(items: DataFrame, scratch: Scratch, window_s: float = 3.0, max_bits: int = 10) -> DataFrame:
    """(burst, item_id): chains of consecutive frames close in time and likeness, named by their smallest item.

    items: item_id, item_uid, taken_ts, exif_subsec, phash64, model, and optionally dup_group; those with null time or hash take no
    part. The order is over the whole library: a foreign frame in between breaks a chain. A null model is like any; copies of one
    dup_group are not linked. Rows are range-partitioned by time and compared with the one before, at a border with the last of the
    range before, so a library with a photo every second is spread over tasks as any other.
    """
    t = F.col("taken_ts") + F.coalesce(subsec(F.col("exif_subsec")), F.lit(0.0))
    group = F.col("dup_group") if "dup_group" in items.columns else F.lit(None).cast("long")
    frame = F.struct(t.alias("t"), F.coalesce("item_uid", F.lit("")).alias("uid"), "item_id", "phash64", "model", group.alias("g"))
    seq = items.where("taken_ts is not null and phash64 is not null").select(frame.alias("f"))
    at = scratch.save(seq.repartitionByRange("f.t", "f.uid", "f.item_id").withColumn("part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("part").orderBy("f.t", "f.uid", "f.item_id")
    # One row for each range.
    tails = at.groupBy("part").agg(F.max("f").alias("tail")).select("part", F.lag("tail").over(Window.orderBy("part")).alias("before"))
    d = at.join(F.broadcast(tails), "part").withColumn("p", F.coalesce(F.lag("f").over(w), F.col("before")))
    alike = F.coalesce(F.col("p.model") == F.col("f.model"), F.lit(True))
    same_group = F.coalesce(F.col("p.g") == F.col("f.g"), F.lit(False))
    close = F.coalesce((F.col("f.t") - F.col("p.t") <= window_s) & (hamming(F.col("p.phash64"), F.col("f.phash64")) <= max_bits), F.lit(False))
    d = scratch.save(d.select("part", "f", F.when(close & alike & ~same_group, 0).otherwise(1).alias("opens")), "linked")
    opened = d.groupBy("part").agg(F.sum("opens").alias("n"))
    ahead = opened.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    chain = F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("ahead")
    chains = d.join(F.broadcast(ahead), "part").select("f.item_id", chain.alias("chain"))
    many = chains.groupBy("chain").agg(F.count("*").alias("n"), F.min("item_id").alias("burst")).where("n > 1")
    return chains.join(many, "chain").select("burst", "item_id")


def ranked(members: DataFrame, items: DataFrame) -> DataFrame:
    """(burst, item_id, rank, quality, is_best): the sharpest well-exposed frame first, the others by sharpness, pixels and uid."""
    lap = F.coalesce("lap_var", F.lit(0.0))
    px = F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0))
    good = (F.coalesce("frac_dark", F.lit(0.0)) < DARK_MAX) & (F.coalesce("frac_bright", F.lit(0.0)) < BRIGHT_MAX)
    d = members.join(items.select("item_id", "item_uid", lap.alias("lap"), px.alias("px"), good.alias("good")), "item_id")
    order = [F.col("lap").desc(), F.col("px").desc(), F.coalesce("item_uid", F.lit(""))]
    d = d.withColumn("choice", F.row_number().over(Window.partitionBy("burst").orderBy(F.col("good").desc(), *order)))
    rank = F.row_number().over(Window.partitionBy("burst").orderBy((F.col("choice") != 1).cast("int"), *order)) - 1
    return d.withColumn("rank", rank).select("burst", "item_id", "rank", F.col("lap").alias("quality"), (F.col("choice") == 1).cast("int").alias("is_best"))


def burst_summary(members: DataFrame, items: DataFrame) -> DataFrame:
    """One row per burst: size, first and last second, and duration with fractions."""
    t = F.col("taken_ts") + F.coalesce(subsec(F.col("exif_subsec")), F.lit(0.0))
    d = members.join(items.select("item_id", "taken_ts", t.alias("t")), "item_id")
    return d.groupBy("burst").agg(F.count("*").alias("size"), F.min("taken_ts").alias("start_ts"), F.max("taken_ts").alias("end_ts"), F.coalesce(F.max("t") - F.min("t"), F.lit(0.0)).alias("duration_s"))


def burst_extras(rank: DataFrame) -> DataFrame:
    """(item_id, score, ratio): every frame but the best, with how many times sharper the best is (null if it has no sharpness)."""
    best = rank.where("is_best = 1").select("burst", F.col("quality").alias("best_quality"), F.col("item_id").alias("best_item_id"))
    d = rank.where("is_best = 0").join(best, "burst")
    return d.select("item_id", "best_item_id", F.lit(EXTRA).alias("score"), F.when(F.col("quality") > 0, F.col("best_quality") / F.col("quality")).alias("ratio"))


def extra_reasons(extras: DataFrame, summary: DataFrame, rank: DataFrame) -> DataFrame:
    """(item_id, score, reason): how many frames in how many seconds, and how much sharper the best one is."""
    from lumenfold.functions.text import fixed

    d = extras.join(rank.select("item_id", "burst"), "item_id").join(summary.select("burst", "size", "duration_s"), "burst")
    sharper = F.when(F.col("ratio").isNotNull(), F.concat(fixed(F.col("ratio"), 1), F.lit("x sharper"))).otherwise("sharper")
    reason = F.concat(F.lit("burst of "), F.col("size").cast("string"), F.lit(" in "), fixed(F.col("duration_s"), 1), F.lit(" s; #"), F.col("best_item_id").cast("string"), F.lit(" is "), sharper)
    return d.select("item_id", "score", reason.alias("reason"))
