"""Scanning: archives to shard tables, row by row with its own error, committed by a shard_info row written last.

Tables are partitioned by cfg, zipkey and shard. A scan takes the shards that have no shard_info yet, so it can be run again until
nothing is pending; what a broken run left of a shard is overwritten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.documents import sidecar_fields
from lumenfold.functions.names import PHOTO_EXTS, classify, export_id, ext_of
from lumenfold.functions.pixels import FINGERPRINT, fingerprint
from lumenfold.session import Scratch
from lumenfold.sources.archive import plan_shards, read_archives
from lumenfold.sources.snapshots import Store

PLACE = ["cfg", "zipkey", "shard"]
COMMON = ["zip_name", "member_idx", "member"]
DECODED = "member_idx long, zipkey string, rgb binary, width int, height int, err string"

Decoder = Callable[[bytes], np.ndarray]


def decoded(images: DataFrame, decode: Decoder) -> DataFrame:
    """(zipkey, member_idx, rgb, width, height, err): each image decoded for itself; what fails is a row with the kind of its error.

    images: zipkey, member_idx, content, err. The rest of a batch is not touched by a bad member; only the loss of a worker is a
    matter of Spark's retries.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    if r.content is None:
                        raise ValueError(r.err or "no content")
                    a = np.ascontiguousarray(decode(bytes(r.content)), dtype=np.uint8)
                    if a.ndim != 3 or a.shape[2] != 3 or 0 in a.shape:
                        raise ValueError("no RGB image")
                    rows.append((r.member_idx, r.zipkey, a.tobytes(), a.shape[1], a.shape[0], None))
                except Exception as e:  # noqa: BLE001 - a member that can't be decoded is a row, not a failed task
                    rows.append((r.member_idx, r.zipkey, None, None, None, r.err or type(e).__name__))
            frame = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in DECODED.split(", ")])
            yield frame.astype({"width": "Int32", "height": "Int32"})

    return images.select("member_idx", "zipkey", "content", "err").mapInPandas(run, DECODED)


def _images(m: DataFrame, keys: list[str], decode: Decoder | None) -> DataFrame:
    images = m.where("kind = 'image'")
    items = images.select(*keys, "folder", "folder_kind", "filename", ext_of(F.col("filename")).alias("ext"), "file_size", "crc32", "sha256", "err")
    pixels = [f for f in FINGERPRINT.fields if f.name != "err"]
    if decode is None:
        return items.select("*", *[F.lit(None).cast("int").alias(c) for c in ("width", "height")], *[F.lit(None).cast(f.dataType).alias(f.name) for f in pixels])
    d = decoded(images, decode).withColumn("f", F.when(F.col("rgb").isNotNull(), fingerprint("rgb", "width", "height")))
    d = d.select("zipkey", "member_idx", "width", "height", *[F.col(f"f.{f.name}").alias(f.name) for f in pixels], F.coalesce("err", "f.err").alias("err"))
    return items.drop("err").join(d, ["zipkey", "member_idx"], "left")


def _sidecars(m: DataFrame, keys: list[str]) -> DataFrame:
    cars = sidecar_fields(m.where("kind = 'sidecar'").select(*keys, "folder", "folder_kind", F.col("filename").alias("json_name"), F.col("content").cast("string").alias("doc"), F.col("err").alias("read_err")))
    geo = {f"{c}{s}": F.col(f"geo{s}.{c}") for s in ("", "_exif") for c in ("lat", "lon")}
    return cars.withColumns({**geo, "alt": F.col("geo.alt"), "err": F.coalesce("read_err", "err")}).drop("geo", "geo_exif", "doc", "read_err")


def scan(spark: SparkSession, archives: str, out: str, cfg: str, photos_per_shard: int = 2000, decode: Decoder | None = None) -> DataFrame:
    """Scan the archives of a folder into shard tables under `out`; returns shard_info of the shards done now, empty if none was pending.

    Shards are planned on names and sizes alone. Each table then reads the archives with pending shards for the contents it needs:
    images those of photos, sidecars those of JSON, the others none. Without a decoder images have bytes and hashes, but no pixels.
    """
    out = out.rstrip("/")

    told = ["kind", "folder", "folder_kind", "filename", "reason"]
    c = F.col("c")
    scratch = Scratch(spark, "scan")
    # Written before its parts are read, so that the rules are evaluated once.
    every = scratch.save(read_archives(spark, archives, "").select("zipkey", "zip_name", "member_idx", "member", "file_size", "crc32", classify(F.col("member"), F.col("file_size")).alias("c")), "members")
    every = every.select("zipkey", "zip_name", "member_idx", "member", "file_size", "crc32", *[c[f].alias(f) for f in told])
    plan = plan_shards(every.withColumn("ext", F.when(F.col("kind") == "image", ext_of(F.col("filename")))), photos_per_shard).drop("ext")
    if Store(spark, out).exists("shard_info"):
        done = spark.read.parquet(f"{out}/shard_info").where(F.col("cfg") == cfg).select("zipkey", "shard").distinct()
        plan = plan.join(done, ["zipkey", "shard"], "left_anti")
    plan = scratch.save(plan.withColumns({"cfg": F.lit(cfg), "export_id": export_id(F.col("zip_name"))}), "plan")
    names = [r["zip_name"] for r in plan.select("zip_name").distinct().collect()]  # a name for each archive
    if not names:
        return plan.select("cfg", "zipkey", "shard", "zip_name").where("false")

    def members(contents: str) -> DataFrame:
        return plan.join(read_archives(spark, archives, contents, names=names).select("zipkey", "member_idx", "content", "sha256", "err"), ["zipkey", "member_idx"])

    keys, bare = [*PLACE, *COMMON, "export_id"], plan
    tables = {
        "items_raw": _images(members(",".join(PHOTO_EXTS)), keys, decode),
        "sidecars_raw": _sidecars(members("json"), keys),
        "videos_raw": bare.where("kind = 'video'").select(*keys, "folder", "folder_kind", "filename", "file_size"),
        "skipped_raw": bare.where("kind = 'skip'").select(*keys, "reason", "file_size"),
    }
    shards = plan.select("zipkey", "zip_name", "shard", "cfg", "export_id").distinct()
    for t, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(f"{out}/{t}")
        n = spark.read.schema(df.schema).parquet(f"{out}/{t}").where(F.col("cfg") == cfg).groupBy("zipkey", "shard").agg(F.count("*").alias(f"n_{t.removesuffix('_raw')}"))
        shards = shards.join(n, ["zipkey", "shard"], "left").fillna(0, [f"n_{t.removesuffix('_raw')}"])
    info = spark.createDataFrame(shards.collect(), shards.schema)  # a row for each shard
    info.coalesce(1).write.mode("append").parquet(f"{out}/shard_info")
    return info


def checkpoint_problems(plan: DataFrame, info: DataFrame, packs: DataFrame, cfg: str) -> DataFrame:
    """(zipkey, shard, problem): of every present shard what keeps it out of a merge, null if nothing does.

    plan: zipkey, shard, present. info: zipkey, shard, cfg, pack_name, pack_size, pack_sha256, pack_md5. packs: pack_name, size, sha256 and md5
    (null where the store tells none). A pack agrees if its size does and, of the first kind of hash that both sides have, its hash.
    A merge with any problem is partial.
    """
    p = packs.select("pack_name", F.col("size").alias("l_size"), F.lower("sha256").alias("l_sha"), F.lower("md5").alias("l_md5"), F.lit(True).alias("listed"))
    i = info.select("zipkey", "shard", "cfg", "pack_name", "pack_size", F.lower("pack_sha256").alias("w_sha"), F.lower("pack_md5").alias("w_md5"), F.lit(True).alias("done"))
    d = plan.where("present").select("zipkey", "shard").join(i, ["zipkey", "shard"], "left").join(p, "pack_name", "left")
    hashes = F.coalesce(F.col("w_md5") == F.col("l_md5"), F.col("w_sha") == F.col("l_sha"), F.lit(True))
    agrees = F.coalesce(F.col("pack_size") == F.col("l_size"), F.lit(True)) & hashes
    broken = (F.coalesce("cfg", F.lit("")) != cfg) | F.coalesce("w_sha", F.lit("")).eqNullSafe("")
    problem = F.when(F.col("done").isNull(), "not scanned").when(broken, "unreadable or of another configuration").when(F.col("listed").isNull(), "pack missing").when(~agrees, "pack differs")
    return d.select("zipkey", "shard", problem.alias("problem"))


def merge_state(problems: DataFrame) -> DataFrame:
    """One row: shards present, usable, missing, and whether a merge of the usable ones is partial."""
    usable = F.count_if(F.col("problem").isNull())
    return problems.agg(F.count("*").alias("present"), usable.alias("usable"), (F.count("*") - usable).alias("missing"), (F.count("*") > usable).cast("int").alias("partial"))


def survey(items: DataFrame, sidecars: DataFrame, members: DataFrame) -> DataFrame:
    """(key, n): how often a scan's fields are there, by sidecar key and EXIF field, errors, and members of each kind, in one pass over each table."""
    some = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") & (F.col(c).cast("string") != "0")
    keys = [c for c in ("title", "taken_ts", "creation_ts", "lat", "url", "description", "people", "origin_folder", "device_type", "from_shared_album", "from_partner", "favorited", "archived", "trashed") if c in sidecars.columns]
    told = {"sidecars": F.count("*"), **{f"sc_{c}": F.count_if(some(c)) for c in keys}}
    seen = {"items": F.count("*"), "exif_dt": F.count_if(some("exif_dt")), "exif_offset": F.count_if(some("exif_offset")), "exif_camera": F.count_if(F.col("has_camera_exif") == 1), "exif_gps": F.count_if(F.col("exif_lat").isNotNull()), "item_errors": F.count_if(some("err"))}
    rows = lambda df, aggs: df.agg(*[c.alias(k) for k, c in aggs.items()]).select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("n")) for k in aggs])))
    kinds = members.groupBy(F.concat_ws(":", F.lit("member"), "kind", "reason").alias("key")).agg(F.count("*").alias("n"))
    return rows(sidecars, told).unionByName(rows(items, seen)).unionByName(kinds)


def deliveries(spark: SparkSession, shards: str, home_tz: str = "UTC") -> dict[str, DataFrame]:
    """The tables that a build reads, from scanned shards: items_raw and sidecars_raw with a key told by archive and member, exports and zips.

    A member scanned twice (under two configurations) is delivered twice; the one of the greater configuration counts.
    """
    shards = shards.rstrip("/")
    read = lambda t: spark.read.parquet(f"{shards}/{t}")
    key = F.xxhash64("zipkey", "member_idx")
    stamp = F.col("cfg").alias("scanned_at")
    items = read("items_raw").select("*", key.alias("item_id"), stamp)
    cars = read("sidecars_raw").select("*", key.alias("sidecar_id"), F.lit(None).cast("long").alias("item_id"), stamp)
    zips = read("shard_info").groupBy("zipkey").agg(F.min("zip_name").alias("name"), F.min("export_id").alias("export_id"))
    exports = zips.select("export_id").distinct().withColumn("home_tz", F.lit(home_tz))
    return {"items_raw": items, "sidecars_raw": cars.withColumn("taken_ts", F.col("taken_ts").cast("string")), "exports": exports, "zips": zips}
