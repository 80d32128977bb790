"""From deliveries to an index: pairs, records, items, analysis, snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.documents import unix_field
from lumenfold.functions.localtime import exif_wall, subsec, with_local_fields
from lumenfold.functions.pixels import SIG_BYTES, sig_luma_std
from lumenfold.operators import bursts as B
from lumenfold.operators import scores as S
from lumenfold.operators.collapse import assign_items, merged, unindexed, with_item_ids, with_uids
from lumenfold.operators.deliveries import latest_values
from lumenfold.operators.groups import GroupParams, find_groups
from lumenfold.operators.ordering import numbered
from lumenfold.operators.pairing import pair, unpaired
from lumenfold.plans.lookups import library_stats
from lumenfold.session import Scratch
from lumenfold.sources.snapshots import read_table, write_snapshot

PHOTO = ["zipkey", "zip_name", "export_id", "member_idx", "member", "folder", "folder_kind", "filename", "ext", "format", "file_size", "sha256", "width", "height", "phash64", "exif_dt", "exif_offset", "exif_subsec", "exif_dt_any", "make", "model", "has_camera_exif", "exif_lat", "exif_lon", "lap_var", "luma_mean", "luma_std", "frac_dark", "frac_bright", "flat_frac", "err"]
SIDECAR = ["item_id", "export_id", "folder", "folder_kind", "json_name", "title", "taken_ts", "lat", "lon", "url", "origin_folder", "from_shared_album", "from_partner", "favorited", "archived", "trashed", "err"]


def location() -> dict[str, F.Column]:
    """The first pair of coordinates that is whole: the sidecar's, its copy of the file's, the file's own."""
    pair = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).alias("lat"), F.col(b).alias("lon")))
    p = F.coalesce(pair("sc_lat", "sc_lon"), pair("sc_lat_exif", "sc_lon_exif"), pair("exif_lat", "exif_lon"))
    return {"lat": p["lat"], "lon": p["lon"]}


def owned_sidecars(photos: DataFrame, sidecars: DataFrame, scratch: Scratch, max_year: int | None = None) -> DataFrame:
    """(item_id, sidecar_id, rule): the sidecar of each photo that has one, by names, titles and times.

    A photo for which those find none keeps the sidecar it was delivered with (of several, the one of the smallest id), unless
    another photo has it by them.
    """
    media = photos.select(F.col("item_id").alias("media_key"), "export_id", "folder", "filename", exif_wall(F.col("exif_dt"), max_year).alias("exif_ts")).where("filename is not null")
    s = sidecars.select(F.col("sidecar_id").alias("sidecar_key"), "item_id", "export_id", "folder", "json_name", "title", unix_field(F.col("taken_ts")).alias("taken_ts"))
    pairs = scratch.save(pair(media, s.drop("item_id").where("json_name is not null"), scratch).where("sidecar_key is not null"), "pairs")
    named = pairs.select(F.col("media_key").alias("item_id"), F.col("sidecar_key").alias("sidecar_id"), "rule")
    delivered = unpaired(s.where("item_id is not null"), pairs).groupBy("item_id").agg(F.min("sidecar_key").alias("sidecar_id")).withColumn("rule", F.lit("delivered"))
    return named.unionByName(delivered.join(named.select("item_id"), "item_id", "left_anti"))


def records(photos: DataFrame, sidecars: DataFrame, owned: DataFrame, exports: DataFrame, max_year: int | None = None) -> DataFrame:
    """One row per photo that could be read and isn't trashed, with its sidecar's fields beside it and its local time.

    owned: item_id, sidecar_id, one row per photo with a sidecar; flags of none are 0.
    """
    s = owned.join(sidecars.select("sidecar_id", F.struct(*[c for c in sidecars.columns if c != "item_id"]).alias("s")), "sidecar_id").select("item_id", "s")
    homes = exports.groupBy("export_id").agg(F.min("home_tz").alias("home_tz"))
    d = photos.where("err is null").withColumnRenamed("item_id", "photo_id").join(s.withColumnRenamed("item_id", "photo_id"), "photo_id", "left").join(homes, "export_id", "left")
    flag = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(0)).cast("int")
    d = d.withColumns({"url": F.col("s.url"), "origin_folder": F.col("s.origin_folder"), "sc_lat": F.col("s.lat"), "sc_lon": F.col("s.lon"), **{f"sc_{c}": F.col(f"s.{c}") if c in sidecars.columns else F.lit(None).cast("double") for c in ("lat_exif", "lon_exif")}, "sc_taken_ts": unix_field(F.col("s.taken_ts")), "favorited": flag("favorited"), "archived": flag("archived"), "shared": flag("from_shared_album"), "partner": flag("from_partner"), "trashed": flag("trashed")})
    d = d.where("trashed = 0").withColumns(location())
    zone = F.coalesce("home_tz", F.lit("UTC"))
    return with_local_fields(d, "exif_dt", "exif_offset", "exif_dt_any", "sc_taken_ts", "folder", zone, max_year).drop("s", "home_tz", "sc_lat", "sc_lon", "sc_lat_exif", "sc_lon_exif")


def library_items(recs: DataFrame, sidecars: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(items, aliases): records collapsed to library items with uids and dense ids, and the other records of each."""
    assigned = scratch.save(assign_items(recs.where("sha256 is not null")), "assigned")
    whole = merged(assigned, sidecars).drop("url")
    flags = [c for c in whole.columns if c in ("favorited", "shared", "partner", "archived")]
    primary = assigned.where("is_primary").drop(*flags, "is_primary", "reason").join(whole, "item_key")
    items = scratch.save(with_item_ids(with_uids(primary), scratch), "items")
    aliases = assigned.where(~F.col("is_primary")).join(items.select("item_key", "item_id"), "item_key").select("item_id", "zipkey", "member", "reason")
    return items, aliases


def without_row(photos: DataFrame, sidecars: DataFrame, owned: DataFrame, exports: DataFrame, items: DataFrame) -> DataFrame:
    """(kind, day): library items that have no row in the index: photos of year folders that could not be read and aren't trashed."""
    s = owned.join(sidecars.select("sidecar_id", "url", "taken_ts", F.coalesce("trashed", F.lit(0)).alias("trashed")), "sidecar_id").drop("sidecar_id", "rule")
    homes = exports.groupBy("export_id").agg(F.min("home_tz").alias("home_tz"))
    d = photos.where("(err is not null or sha256 is null) and folder_kind = 'year'").join(s, "item_id", "left").where("coalesce(trashed, 0) = 0").join(homes, "export_id", "left")
    media = d.select(F.lit("image").alias("kind"), "url", "filename", "file_size", unix_field(F.col("taken_ts")).alias("taken_ts"), F.coalesce("home_tz", F.lit("UTC")).alias("home_tz"))
    return unindexed(media, items.select("url"), F.col("home_tz"))


def analyse(items: DataFrame, scratch: Scratch, p: GroupParams | None = None) -> dict[str, DataFrame]:
    """Groups, bursts and scores: a function of index columns only.

    The screenshot score decides what is graphic, that what is grouped, the groups what can be a burst, and all of it the scores.
    Where no item has a signature, near matches are verified by hash, aspect and capture alone: one signature stands for all, and
    the members' signature distances are null. A hash of 0 (a blank frame) then matches nothing.
    """
    signed = "sig" in items.columns and not items.where("sig is not null").isEmpty()
    if not signed:
        items = items.withColumn("sig", F.when(F.col("phash64") != 0, F.lit(bytearray(SIG_BYTES))))
    d = items.withColumn("shot", S.screenshot()["score"])
    # Without any signatures their rules can't tell a graphic.
    d = d.withColumn("is_graphic", S.is_graphic(F.col("shot"), sig_luma_std("sig"), F.coalesce(F.length("sig") == SIG_BYTES, F.lit(False))) if signed else S.is_graphic(F.col("shot"), F.lit(None).cast("double"), F.lit(True)))
    d = scratch.save(d.withColumns({"capture_s": exif_wall(F.col("exif_dt")), "subsec": subsec(F.col("exif_subsec"))}), "flagged")
    found = find_groups(d, scratch, p)
    groups = scratch.save(numbered(found["groups"], ["seed_item_id"], "group_id", scratch), "groups")
    members = found["members"].join(groups.select("seed_item_id", "group_id"), "seed_item_id").drop("seed_item_id")
    if not signed:
        d, members = d.drop("sig"), members.withColumns({c: F.lit(None).cast(t) for c, t in members.dtypes if c.startswith("sig_")})
    members = scratch.save(members, "members")
    inside = members.select("item_id", F.col("group_id").alias("dup_group"), "is_keeper")
    by_name = scratch.save(B.filename_bursts(d), "by-name")
    seq = d.where(~F.col("is_graphic")).join(by_name.select("item_id"), "item_id", "left_anti").join(inside, "item_id", "left").where("is_keeper is null or is_keeper = 1")
    frames = scratch.save(by_name.withColumn("source", F.lit("filename")).unionByName(B.time_bursts(seq, scratch).withColumn("source", F.lit("time"))), "frames")
    rank = scratch.save(B.ranked(frames.select(F.concat_ws("-", "source", "burst").alias("burst"), "item_id"), d), "ranked")
    summary = scratch.save(B.burst_summary(rank.select("burst", "item_id"), d), "bursts")
    extras = B.extra_reasons(B.burst_extras(rank), summary, rank).select("item_id", F.lit("burst_extra").alias("category"), "score", "reason")
    keeper = groups.select("group_id", "deletable", F.col("seed_item_id").alias("keeper")).join(d.select(F.col("item_id").alias("keeper"), F.col("url").alias("keeper_url")), "keeper")
    dup = members.where("is_keeper = 0").join(keeper, "group_id").join(d.select("item_id", "url"), "item_id")
    sure = (F.col("deletable") == 1) & F.col("url").isNotNull() & F.col("keeper_url").isNotNull() & (F.col("url") != F.col("keeper_url"))
    number = F.col("keeper").cast("string")
    reason = F.when(sure, F.concat(F.lit("duplicate of #"), number)).otherwise(F.concat(F.lit("possible duplicate of #"), number, F.lit(" (may be the same item)")))
    dup = dup.select("item_id", F.lit("dup_extra").alias("category"), F.when(sure, 1.0).otherwise(0.6).alias("score"), reason.alias("reason"))
    scores = S.stored(S.category_scores(d), S.distribution_scores(d, scratch), extras, dup)
    out = {"items": d.drop("capture_s", "subsec"), "dup_groups": groups, "dup_members": members, "burst_members": rank, "bursts": summary, "scores": scores}
    return {**out, "bucket_skips": found["skips"]} if "skips" in found else out


def _cfg(p: GroupParams | None) -> dict:
    p = p or GroupParams()
    return {"distance": p.distance, "bucket_cap": p.bucket_cap}


# Columns that a scan without EXIF reading lacks, by type; all other columns are texts.
KINDS = {"long": ("member_idx", "file_size", "phash64", "trashed"), "int": ("width", "height", "has_camera_exif", "from_shared_album", "from_partner", "favorited", "archived"), "double": ("exif_lat", "exif_lon", "lap_var", "luma_mean", "luma_std", "frac_dark", "frac_bright", "flat_frac", "lat", "lon"), "binary": ("sha256",)}


def completed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with null columns for those it lacks."""
    kind = {c: k for k, cs in KINDS.items() for c in cs}
    return df.withColumns({c: F.lit(None).cast(kind.get(c, "string")) for c in columns if c not in df.columns})


def build(spark: SparkSession, source: str | dict[str, DataFrame], root: str, name: str, p: GroupParams | None = None) -> dict:
    """Read deliveries, build the index and write it as a snapshot; returns the manifest.

    source: a folder of Parquet tables, or the tables themselves (see `sources.scan.deliveries`).
    """
    scratch = Scratch(spark, "build")
    raw = lambda t: source[t] if isinstance(source, dict) else spark.read.parquet(f"{source}/{t}.parquet")
    scanned = completed(raw("items_raw"), PHOTO)
    photos = scratch.save(latest_values(scanned, "item_id", [*PHOTO, *(c for c in ["sig"] if c in scanned.columns)]), "photos")
    told = completed(raw("sidecars_raw"), SIDECAR)
    sidecars = scratch.save(latest_values(told, "sidecar_id", [*SIDECAR, *(c for c in ("lat_exif", "lon_exif") if c in told.columns)]), "sidecars")
    owned = scratch.save(owned_sidecars(photos, sidecars, scratch), "owned")
    items, aliases = library_items(records(photos, sidecars, owned, raw("exports")), sidecars, scratch)
    tables = analyse(items, scratch, p)
    missing = scratch.save(without_row(photos, sidecars, owned, raw("exports"), tables["items"]), "missing")
    by_day = missing.where("day is not null").groupBy(F.col("day").alias("local_date")).agg(F.count("*").alias("n"))
    stats = library_stats(tables["items"], tables["dup_groups"], tables["scores"], by_day)
    more = {"undated_unindexed": missing.where("day is null"), "aliases": aliases, "unreadable": photos.where("err is not null or sha256 is null")}
    for key, df in more.items():
        stats = stats.unionByName(df.agg(F.count("*").alias("value")).select(F.lit(key).alias("key"), "value"))
    stats = stats.unionByName(owned.groupBy("rule").agg(F.count("*").alias("value")).select(F.concat(F.lit("pairing:"), "rule").alias("key"), "value"))
    return write_snapshot(spark, root, name, {**tables, "item_aliases": aliases, "videos_by_day": by_day, "stats": stats, "zips": raw("zips")}, _cfg(p))


def regroup(spark: SparkSession, root: str, old: str, new: str, p: GroupParams) -> dict:
    """A new snapshot with the analysis made anew from the items of an old one."""
    scratch = Scratch(spark, "regroup")
    items = read_table(spark, root, old, "items").drop("shot", "is_graphic")
    keep = {t: read_table(spark, root, old, t) for t in ("item_aliases", "videos_by_day", "zips")}
    tables = analyse(items, scratch, p)
    now = library_stats(tables["items"], tables["dup_groups"], tables["scores"], keep["videos_by_day"])
    # What a new analysis doesn't touch stays as it was counted.
    before = read_table(spark, root, old, "stats").join(now.select("key"), "key", "left_anti").where("key not like 'groups:%' and key not like 'category:%'")
    return write_snapshot(spark, root, new, {**tables, **keep, "stats": now.unionByName(before.select("key", "value"))}, _cfg(p))
