"""Records of the same library item collapsed into one: primary, aliases, merged flags, albums, uids and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.localtime import exif_wall, wall_date
from lumenfold.functions.text import casefold, url_id
from lumenfold.operators.ordering import numbered
from lumenfold.session import Scratch

FLAGS = ("favorited", "shared", "partner", "archived")


def precedence() -> list[Column]:
    """Year folder before album, newest export, then the lowest archive and member."""
    return [F.when(F.col("folder_kind") == "year", 0).otherwise(1), F.col("export_id").desc(), F.col("zipkey"), F.col("member_idx")]


def intrinsic_day() -> Column:
    """The capture day written inside the file."""
    return wall_date(F.coalesce(exif_wall(F.col("exif_dt")), exif_wall(F.col("exif_dt_any"))))


def nourl_key() -> Column:
    """What byte-identical records share: hash, folded name and capture day."""
    return F.struct("sha256", casefold(F.col("filename")).alias("name"), F.coalesce(intrinsic_day(), F.lit("")).alias("day"))


def alias_reason(has_url: Column, other_export: Column) -> Column:
    return F.when(F.col("folder_kind") == "album", "album_copy").when(other_export, F.when(has_url, "double_export").otherwise("double_export_nourl")).otherwise(F.when(has_url, "same_url").otherwise("same_file_nourl"))


def assign_items(records: DataFrame) -> DataFrame:
    """Add item_key, is_primary and reason to records.

    Records with a url are one item for each url. A record without one belongs to the url item whose records share its key, if
    exactly one does; if several do it stays alone; else it is one item with the others of its key.
    """
    r = records.withColumn("nk", nourl_key())
    owners = r.where("url is not null").groupBy("nk").agg(F.count_distinct("url").alias("owners"), F.min("url").alias("owner"))
    r = r.join(owners, "nk", "left")
    own = F.concat_ws("|", F.lit("n"), F.hex("sha256"), F.col("nk.name"), F.col("nk.day"))
    alone = F.concat_ws("|", F.lit("a"), "zipkey", "member_idx")
    key = F.when(F.col("url").isNotNull(), F.concat(F.lit("u|"), "url")).when(F.col("owners") == 1, F.concat(F.lit("u|"), "owner")).when(F.col("owners") > 1, alone).otherwise(own)
    r = r.withColumn("item_key", key)
    w = Window.partitionBy("item_key")
    # A record without a url is never the primary of a url item.
    ranked = w.orderBy(F.col("url").isNull(), *precedence())
    r = r.withColumn("place", F.row_number().over(ranked)).withColumn("primary_export", F.first("export_id").over(ranked))
    reason = F.when(F.col("place") > 1, alias_reason(F.col("url").isNotNull(), F.col("export_id") != F.col("primary_export")))
    return r.withColumn("is_primary", F.col("place") == 1).withColumn("reason", reason).drop("nk", "owners", "owner", "place", "primary_export")


def albums_by_url(sidecars: DataFrame) -> DataFrame:
    """Albums whose sidecars name a url: (url, albums)."""
    return sidecars.where("url is not null and folder_kind = 'album' and coalesce(trashed, 0) = 0").groupBy("url").agg(F.collect_set("folder").alias("url_albums"))


def merged(assigned: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """One row per item_key: merged flags, and the sorted set of albums of all its records and of sidecars with its url."""
    flags = [F.max(F.coalesce(F.col(f), F.lit(0))).alias(f) for f in FLAGS if f in assigned.columns]
    own = F.collect_set(F.when(F.col("folder_kind") == "album", F.col("folder")))
    m = assigned.groupBy("item_key").agg(*flags, own.alias("own_albums"), F.max("url").alias("url"), F.count("*").alias("n_records"))
    albums = F.col("own_albums")
    if sidecars is not None:
        m = m.join(albums_by_url(sidecars), "url", "left")
        albums = F.array_union("own_albums", F.coalesce("url_albums", F.array().cast("array<string>")))
    m = m.withColumn("albums", F.array_sort(albums))
    return m.withColumn("albums_n", F.size("albums")).drop("own_albums", "url_albums")


def with_uids(items: DataFrame) -> DataFrame:
    """Add item_uid: g: and the url's id, else s:, the hash and the name; further items of one base get :2, :3 and so on.

    A number whose uid is another item's own base is passed over, so uids are unique.
    """
    base = F.when(F.col("url").isNotNull(), F.concat(F.lit("g:"), url_id(F.col("url")))).otherwise(F.concat(F.lit("s:"), F.lower(F.hex("sha256")), F.lit(":"), F.col("filename")))
    made = items.withColumn("uid_base", base)
    # Bases that look like another base with a number; names hardly ever do.
    bases = made.where("url is null").select("uid_base").distinct()
    taken = bases.select(F.regexp_extract("uid_base", r"^(.*):([1-9]\d{0,8})$", 1).alias("owner"), F.regexp_extract("uid_base", r"^(.*):([1-9]\d{0,8})$", 2).try_cast("long").alias("no")).where("no >= 2")
    taken = taken.join(bases.withColumnRenamed("uid_base", "owner"), "owner", "left_semi").groupBy("owner").agg(F.array_sort(F.collect_set("no")).alias("taken")).withColumnRenamed("owner", "uid_base")
    w = Window.partitionBy("uid_base").orderBy(F.coalesce("local_date", F.lit("")), "folder", "export_id", "zip_name", "member")
    made = made.withColumn("uid_no", F.when(F.col("url").isNotNull(), 1).otherwise(F.row_number().over(w)).cast("long")).join(taken, "uid_base", "left")
    # Every taken number at or below the place reached so far moves it on by one.
    no = F.aggregate(F.coalesce("taken", F.array().cast("array<long>")), F.col("uid_no"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    made = made.withColumn("uid_no", F.when(F.col("uid_no") == 1, 1).otherwise(no))
    return made.withColumn("item_uid", F.when(F.col("uid_no") == 1, F.col("uid_base")).otherwise(F.concat_ws(":", "uid_base", "uid_no"))).drop("uid_base", "uid_no", "taken")


def with_item_ids(items: DataFrame, scratch: Scratch, out: str = "item_id") -> DataFrame:
    """Add dense ids in the order of date (undated last), time and uid; a day, or the undated, may span many tasks."""
    return numbered(items, [F.coalesce("local_date", F.lit("9999-99-99")), F.coalesce("local_time", F.lit("")), "item_uid"], out, scratch)


def unindexed(media: DataFrame, indexed_urls: DataFrame, home_tz: Column | str) -> DataFrame:
    """One row per library item that has no row in the index: kind ('video' or 'image') and local day (null if unknown).

    media: kind, url, filename, file_size, taken_ts. Records with one url are one item; without, those of one kind, folded name,
    size and day. An image whose url is indexed is not counted.
    """
    from lumenfold.functions.localtime import utc_to_wall

    m = media.withColumn("day", wall_date(utc_to_wall(F.col("taken_ts"), home_tz)))
    known = indexed_urls.select("url").where("url is not null").distinct().withColumn("indexed", F.lit(True))
    m = m.join(known, "url", "left").where(~((F.col("kind") == "image") & F.coalesce("indexed", F.lit(False))))
    same = F.when(F.col("url").isNotNull(), F.concat(F.lit("u|"), "url")).otherwise(F.concat_ws("|", F.lit("n"), "kind", casefold(F.col("filename")), F.coalesce(F.col("file_size").cast("string"), F.lit("?")), F.coalesce("day", F.lit("?"))))
    return m.withColumn("same", same).groupBy("same").agg(F.min(F.struct("kind", "day")).alias("x")).select("x.kind", "x.day")
