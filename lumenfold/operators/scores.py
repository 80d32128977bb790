"""Scores of low-value pictures in a long table of item, category, score and reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.names import is_screenshot_name, messaging_app
from lumenfold.functions.text import casefold, round_share
from lumenfold.operators.ordering import running_sum
from lumenfold.session import Scratch

# Sizes of screens, folder and app names, limits.
PHONE_SHORT = (720, 750, 828, 1080, 1125, 1170, 1179, 1242, 1284, 1290, 1320, 1440)
PHONE_RATIO = (1.6, 2.4)
TABLET_SHORT = (1536, 1620, 1640, 1668, 2048)
TABLET_RATIO = (1.3, 1.45)
APP_FOLDERS = (("whatsapp", "WhatsApp"), ("telegram", "Telegram"), ("messenger", "Messenger"), ("signal", "Signal"), ("instagram", "Instagram"), ("snapchat", "Snapchat"), ("facebook", "Facebook"), ("reddit", "Reddit"), ("discord", "Discord"), ("download", "Downloads"))
CATEGORIES = ("screenshot", "messaging", "tiny", "pocket", "blur", "dark", "overexposed", "burst_extra", "dup_extra")
BLUR_GATE, DARK_GATE, OVER_BRIGHT_GATE, OVER_MEAN_GATE = 50.0, 25.0, 0.5, 215.0
DAMP, GATE_FLOOR, MIN_STORED, SHOW_MIN, MIN_REFERENCE = 0.3, 0.5, 0.05, 0.5, 20


def _dims() -> tuple[Column, Column]:
    return F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))


def _scored(score: Column | float, reason: Column | str) -> Column:
    s, r = (x if isinstance(x, Column) else F.lit(x) for x in (score, reason))
    return F.struct(s.cast("double").alias("score"), r.alias("reason"))


def screen_shaped() -> Column:
    w, h = _dims()
    short, long_ = F.least(w, h), F.greatest(w, h)
    ratio = long_ / F.when(short > 0, short)
    return F.coalesce((short.isin(*PHONE_SHORT) & ratio.between(*PHONE_RATIO)) | (short.isin(*TABLET_SHORT) & ratio.between(*TABLET_RATIO)), F.lit(False))


def screenshot() -> Column:
    w, h = _dims()
    size = F.concat_ws("x", w, h)
    origin = casefold(F.col("origin_folder"))
    graphic = (F.upper("format") == "PNG") | (F.coalesce("flat_frac", F.lit(0.0)) >= 0.35)
    screen = (F.coalesce("has_camera_exif", F.lit(0)) == 0) & screen_shaped()
    return (
        F.when(is_screenshot_name(F.col("filename")), _scored(0.95, "screenshot file name"))
        .when(origin.contains("screenshot") | origin.contains("screen shot"), _scored(0.95, "from a Screenshots folder"))
        .when(screen & graphic, _scored(0.8, F.concat(F.lit("screen-sized "), size, F.lit(" graphic, no camera data"))))
        .when(screen, _scored(0.65, F.concat(F.lit("screen-sized "), size, F.lit(", no camera data"))))
    )


def messaging() -> Column:
    app = messaging_app(F.col("filename"))
    name = F.coalesce(*[F.when(app == k, v) for k, v in APP_FOLDERS])
    origin = casefold(F.col("origin_folder"))
    folder = F.coalesce(*[F.when(origin.contains(k), v) for k, v in APP_FOLDERS])
    return F.when(app.isNotNull(), _scored(0.9, F.concat(F.lit("saved from "), name, F.lit(" (file name)")))).when(folder.isNotNull(), _scored(0.9, F.concat(F.lit("from a "), folder, F.lit(" folder"))))


def tiny() -> Column:
    w, h = _dims()
    long_, size = F.greatest(w, h), F.concat_ws("x", w, h)
    return F.when((long_ > 0) & (long_ < 480), _scored(1.0, F.concat(F.lit("tiny: "), size))).when((long_ > 0) & (long_ < 800), _scored(0.6, F.concat(F.lit("small: "), size)))


def pocket() -> Column:
    percent = F.concat(F.rint(F.col("flat_frac") * 100).cast("int").cast("string"), F.lit("% of the frame is one flat tone"))
    return F.when(F.col("has_camera_exif") == 1, F.when((F.col("luma_mean") < 25) & (F.col("luma_std") < 12), _scored(0.8, "black frame (pocket or lens cap?)")).when(F.col("flat_frac") > 0.6, _scored(0.7, percent)).when(F.col("lap_var") < 20, _scored(0.6, "almost no detail")))


def is_graphic(screenshot_score: Column, luma_std: Column, has_sig: Column) -> Column:
    """Not a photo: a likely screenshot, no signature, a featureless one, or one flat tone."""
    return (F.coalesce(screenshot_score, F.lit(0.0)) >= 0.8) | ~has_sig | F.coalesce(luma_std < 8, F.lit(False)) | (F.coalesce("flat_frac", F.lit(0.0)) >= 0.35)


def category_scores(items: DataFrame) -> DataFrame:
    """(item_id, category, score, reason) of the rules that look at one row; one pass, no shuffle."""
    rules = (("screenshot", screenshot()), ("messaging", messaging()), ("tiny", tiny()), ("pocket", pocket()))
    long = items.select("item_id", F.inline(F.array(*[F.struct(F.lit(n).alias("category"), c.alias("s")) for n, c in rules])))
    return long.where("s is not null").select("item_id", "category", "s.score", "s.reason")


def reference_rows(items: DataFrame) -> DataFrame:
    """Camera photos that aren't graphic; if under 20, all that aren't graphic; if none, all. One aggregate decides."""
    graphic, camera = F.coalesce("is_graphic", F.lit(False)), F.coalesce("has_camera_exif", F.lit(0)) == 1
    n = items.agg(F.count_if(camera & ~graphic).alias("camera"), F.count_if(~graphic).alias("plain")).first()
    return items.where(camera & ~graphic if n["camera"] >= MIN_REFERENCE else ~graphic if n["plain"] else F.lit(True))


def ecdf(reference: DataFrame, value: str, scratch: Scratch) -> DataFrame:
    """(x, below, above): of every distinct reference value the share strictly below and strictly above it; nulls are left out."""
    counts = reference.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    return _shares(counts, scratch)


def _shares(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, below, above) of distinct values with their counts, some of which may be 0. Ranges follow the values, however they are spread."""
    d = running_sum(counts, ["x"], F.col("n"), "under", scratch)
    total = counts.agg(F.sum("n").alias("n")).first()["n"]  # one number
    if not total:
        return counts.select("x", F.lit(0.0).alias("below"), F.lit(0.0).alias("above"))
    return d.select("x", (F.col("under") / float(total)).alias("below"), ((F.lit(float(total)) - F.col("under") - F.col("n")) / float(total)).alias("above"))


def with_shares(items: DataFrame, reference: DataFrame, value: str, out: str, scratch: Scratch, below: bool = False) -> DataFrame:
    """Add `out`: the share of reference values strictly above (or below) each value, also of values not in the reference.

    An as-of lookup: values and reference are summed over common distinct values.
    """
    tag = items.where(F.col(value).isNotNull()).select(F.col(value).alias("x"), F.lit(0).alias("ref")).distinct()
    refs = reference.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("ref"))
    both = scratch.save(tag.unionByName(refs).groupBy("x").agg(F.sum("ref").alias("n")), "values")
    looked = _shares(both, scratch).select(F.col("x").alias(value), F.col("below" if below else "above").alias(out))
    return items.join(looked, value, "left")


def _gated(share: Column, gate: Column) -> Column:
    return F.when(gate, F.greatest(share, F.lit(GATE_FLOOR))).otherwise(share * DAMP)


def _whole(c: Column) -> Column:
    """A number in whole units as text, halves to the even one."""
    return F.rint(c).cast("long").cast("string")


def _percent(share: Column) -> Column:
    return F.concat(_whole(share * 100), F.lit("%"))


def distribution_scores(items: DataFrame, scratch: Scratch) -> DataFrame:
    """(item_id, category, score, reason) of blur, dark and overexposed against the library's own distribution.

    items: item_id, is_graphic, shot (screenshot score), lap_var, luma_mean, frac_bright, has_camera_exif. Nulls have no score, nor have
    likely screenshots.
    """
    over = F.greatest(F.col("frac_bright"), F.col("luma_mean") / 255.0)
    d = scratch.save(items.withColumn("over", F.when(F.col("frac_bright").isNotNull() & F.col("luma_mean").isNotNull(), over)), "measures")
    ref = reference_rows(d)
    for value, out, below in (("lap_var", "p_lap", False), ("luma_mean", "p_mean", False), ("over", "p_over", True)):
        d = with_shares(d, ref, value, out, scratch, below)
    lap, mean, bright = F.col("lap_var"), F.col("luma_mean"), F.col("frac_bright")
    rules = (
        ("blur", _gated(F.col("p_lap"), lap < BLUR_GATE), F.concat(F.lit("sharpness "), _whole(lap), F.lit(": blurrier than "), _percent(F.col("p_lap")), F.lit(" of camera photos"))),
        ("dark", _gated(F.col("p_mean"), mean < DARK_GATE), F.concat(F.lit("brightness "), _whole(mean), F.lit("/255: darker than "), _percent(F.col("p_mean")), F.lit(" of camera photos"))),
        ("overexposed", F.when(F.col("over").isNotNull(), _gated(F.col("p_over"), (bright > OVER_BRIGHT_GATE) | (mean > OVER_MEAN_GATE))), F.concat(_percent(bright), F.lit(" blown-out pixels, brightness "), _whole(mean), F.lit("/255"))),
    )
    long = d.where(F.coalesce("shot", F.lit(0.0)) < 0.8).select("item_id", F.inline(F.array(*[F.struct(F.lit(n).alias("category"), c.alias("score"), r.alias("reason")) for n, c, r in rules])))
    return long.where(F.col("score") >= MIN_STORED).select("item_id", "category", round_share(F.col("score")).alias("score"), "reason")


def stored(*parts: DataFrame) -> DataFrame:
    """The long union of score tables, kept from the least score on and rounded."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.where(F.col("score") >= MIN_STORED).withColumn("score", round_share(F.col("score")))


def category_counts(scores: DataFrame, min_score: float = SHOW_MIN) -> DataFrame:
    """(category, n) with a zero for categories that don't occur."""
    spark = scores.sparkSession
    every = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    n = scores.where(F.col("score") >= min_score).groupBy("category").agg(F.count("*").alias("n"))
    return every.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_flags(scores: DataFrame, k: int = 5) -> DataFrame:
    """(item_id, place, category, score): the k highest scores of an item, by score, then category."""
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "category")
    return scores.where("score > 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("item_id", "place", "category", "score")


def combined(scores: DataFrame) -> DataFrame:
    return scores.groupBy("item_id").agg(F.max("score").alias("score"))
