"""The core's queries, by name; each takes a session and a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import bits, names, text
from lumenfold.functions.documents import position, sidecar_fields, unix_field
from lumenfold.functions.localtime import LOCAL, exif_wall, reset_hour, subsec, utc_to_wall, wall_date, with_local_fields
from lumenfold.operators import bursts as B
from lumenfold.operators import candidates as C
from lumenfold.operators import collapse as L
from lumenfold.operators import groups as G
from lumenfold.operators import scores as S
from lumenfold.operators.capture import library_instants
from lumenfold.operators.components import connected
from lumenfold.operators.deliveries import latest_values
from lumenfold.operators.pairing import mutual_best, pair
from lumenfold.plans import lookups, shaping
from lumenfold.plans import search as Q
from lumenfold.session import Scratch, table
from lumenfold.sources import shards as H
from lumenfold.sources import snapshots
from lumenfold.sources.archive import plan_shards as with_shards
from lumenfold.sources.scan import survey
from lumenfold.streaming import decisions as D
from lumenfold.streaming.sessions import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MAX_YEAR = 2027  # fixed, so that results don't change with the date of a run


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def photos(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    return latest_values(table(spark, d, "items_raw"), "item_id", list(fields))


def sidecars(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    return latest_values(table(spark, d, "sidecars_raw"), "sidecar_id", list(fields))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The UTC second of every timestamp that denotes an instant."""
    found = library_instants(table(spark, d, "items_raw"), table(spark, d, "sidecars_raw"), table(spark, d, "exports"))
    return found.where(F.col("epoch_s").isNotNull()).select("field", "row_id", "epoch_s")


# Names, members, shards


@query
def media_names(spark, d):
    n = F.col("filename")
    return photos(spark, d, "filename", "folder").where("filename is not null").select("item_id", names.base(n).alias("base"), names.copy_number(n).alias("copy_no"), names.ext_of(n).alias("ext"), names.is_edited(n).alias("edited"), names.year_of_folder(F.col("folder")).alias("folder_year"), names.messaging_app(n).alias("app"), names.is_screenshot_name(n).alias("screenshot"), names.burst_key(n).alias("burst_key"))


@query
def export_ids(spark, d):
    return table(spark, d, "zips").select("zip_id", names.export_id(F.col("name")).alias("export"))


def _members(spark, d):
    a = photos(spark, d, "member", "file_size", "zipkey", "member_idx").select(F.col("item_id").alias("id"), "member", "file_size", "zipkey", "member_idx")
    b = sidecars(spark, d, "member", "zipkey", "member_idx").select((-F.col("sidecar_id")).alias("id"), "member", F.lit(0).cast("long").alias("file_size"), "zipkey", "member_idx")
    return a.unionByName(b).where("member is not null")


@query
def classify_members(spark, d):
    c = _members(spark, d).withColumn("c", names.classify(F.col("member"), F.col("file_size")))
    return c.select("id", "c.kind", "c.folder", "c.folder_kind", "c.filename", "c.reason")


@query
def member_reasons(spark, d):
    c = names.classify(F.col("member"), F.col("file_size"))
    return _members(spark, d).select(c.alias("c")).groupBy(F.col("c.kind").alias("kind"), F.coalesce("c.reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query
def plan_shards(spark, d):
    m = photos(spark, d, "zipkey", "member_idx", "ext").where("zipkey is not null and member_idx is not null")
    return with_shards(m.withColumn("ext", F.lower("ext")), 50, ("member_idx", "item_id")).select("item_id", "zipkey", "shard")


@query
def pending_shards(spark, d):
    plan = table(spark, d, "zips").select(F.col("zip_id").alias("shard_id"), "zipkey", F.lit(True).alias("present"))
    done = photos(spark, d, "zipkey", "err").where("err is not null").groupBy("zipkey").agg(F.count("*").alias("size"))
    return H.pending(plan, done.join(plan, "zipkey").select("shard_id", "size")).select("shard_id", "zipkey")


@query
def unique_names(spark, d):
    return H.without_repeated_names(photos(spark, d, "filename").where("filename is not null"), "filename").select("item_id", "filename")


@query
def worker_split(spark, d):
    return H.split_work(table(spark, d, "zips").select(F.col("zip_id").alias("shard_id")), 4).groupBy("worker").agg(F.count("*").alias("n"))


@query
def extended_plan(spark, d):
    """A plan of two thirds of the archives, extended by all of them but the first."""
    z = table(spark, d, "zips").select("zip_id", "zipkey", F.lit(0).alias("shard"))
    plan = z.where("zip_id % 3 > 0").select(F.col("zip_id").alias("shard_id"), "zipkey", "shard", F.lit(True).alias("present"))
    return H.extend_plan(plan, z.where("zip_id > 1").select("zipkey", "shard"), Scratch(spark, "plan")).select("shard_id", "zipkey", F.col("present").cast("int").alias("present"))


@query
def snapshot_round_trip(spark, d):
    """A table written as a snapshot, checked against its manifest, made current and read back."""
    root = Scratch(spark, "snapshot").root
    snapshots.write_snapshot(spark, root, "one", {"items": table(spark, d, "items")}, {"distance": 3})
    if not snapshots.check_snapshot(spark, root, "one").isEmpty():
        raise ValueError("the snapshot differs from its manifest")
    snapshots.set_current(spark, root, "one")
    return snapshots.read_table(spark, root, snapshots.current(spark, root), "items").select("item_id", "item_uid", "year")


# Texts and documents


@query
def text_clean(spark, d):
    t = F.col("text")
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", text.clean_text(t, 60).alias("clean"), text.csv_cell(t).alias("cell"), F.length(text.strip_unsafe(t)).cast("long").alias("n_safe"))


@query
def url_ids(spark, d):
    return sidecars(spark, d, "url").where("url is not null").select("sidecar_id", text.photo_url(F.col("url"), "photos.example").alias("canonical"), text.url_id(F.col("url")).alias("url_id"))


@query
def sidecar_times(spark, d):
    s = sidecars(spark, d, "taken_ts", "lat", "lon")
    return s.select("sidecar_id", unix_field(F.col("taken_ts")).alias("taken"), position(F.col("lat"), F.col("lon")).isNotNull().alias("located"))


@query
def json_props(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, d, "events").select("event_id", k.alias("k"))


@query
def search_links(spark, d):
    p = photos(spark, d, "filename").join(sidecars(spark, d, "item_id", "url").where("item_id is not null").groupBy("item_id").agg(F.min("url").alias("url")), "item_id", "left")
    link = lookups.photo_link(host="photos.example")
    return p.select("item_id", link["conf"].alias("conf"), link["link"].alias("link"))


@query
def image_tokens(spark, d):
    return photos(spark, d, "width", "height").where("width > 0 and height > 0").select("item_id", text.image_tokens(F.col("width"), F.col("height")).alias("tokens"))


@query
def text_forms(spark, d):
    """The smaller text functions over whole texts."""
    t = F.col("text")
    docs = table(spark, d, "documents").where("text is not null")
    day = text.recoverable_until(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 86_400)).cast("string")
    return docs.select("doc_id", text.casefold(t).alias("folded"), text.truncate_utf8(t, 100).alias("bytes100"), text.reason(t).alias("reason"), text.slug(t).alias("slug"), day.alias("until"), text.url_quote(F.left(t, F.lit(50))).alias("quoted"))


@query
def sidecar_documents(spark, d):
    """Sidecars written as JSON documents and read back."""
    s = sidecars(spark, d, "title", "taken_ts", "creation_ts", "lat", "lon", "alt", "description", "device_type", "favorited", "trashed", "from_partner")
    geo = F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("alt").alias("altitude"))
    at = lambda c: F.struct(F.col(c).alias("timestamp"))
    origin = F.struct(F.struct(F.col("device_type").alias("deviceType")).alias("mobileUpload"), F.when(F.col("from_partner") == 1, F.struct(F.lit(1).alias("x"))).alias("fromPartnerSharing"))
    yes = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)).alias(c)
    doc = F.to_json(F.struct("title", at("taken_ts").alias("photoTakenTime"), at("creation_ts").alias("creationTime"), geo.alias("geoData"), "description", origin.alias("googlePhotosOrigin"), yes("favorited"), yes("trashed")))
    docs = Scratch(spark, "docs").save(s.select("sidecar_id", doc.alias("doc")))
    f = sidecar_fields(docs)
    return f.select("sidecar_id", "title", "taken_ts", "creation_ts", "geo.lat", "geo.lon", "geo.alt", "description", "device_type", "from_partner", "favorited", "trashed", F.coalesce("err", F.lit("")).alias("err"))


# Local time


@query
def local_day(spark, d):
    s = sidecars(spark, d, "item_id", "taken_ts").where("item_id is not null").groupBy("item_id").agg(F.min_by("taken_ts", "sidecar_id").alias("sc"))
    p = photos(spark, d, "exif_dt", "exif_offset", "exif_dt_any", "folder", "export_id").join(s, "item_id", "left").join(table(spark, d, "exports"), "export_id", "left")
    p = with_local_fields(p.withColumn("sc_ts", unix_field(F.col("sc"))), "exif_dt", "exif_offset", "exif_dt_any", "sc_ts", "folder", F.col("home_tz"), MAX_YEAR)
    return p.select("item_id", *LOCAL[1:])


def _local(spark, d):
    """Written once: filters on computed dates would otherwise repeat the whole computation."""
    return Scratch(spark, "local").save(local_day(spark, d))


@query
def day_counts(spark, d):
    return lookups.day_stats(_local(spark, d)).select("local_date", "n", "n_uncertain")


@query
def undated_by_year(spark, d):
    return lookups.undated_counts(_local(spark, d).join(photos(spark, d, "folder"), "item_id")).select("year", "n")


# Scores


MEASURES = ["filename", "format", "width", "height", "has_camera_exif", "lap_var", "luma_mean", "luma_std", "frac_dark", "frac_bright", "flat_frac"]


def _measured(spark, d, *more):
    s = sidecars(spark, d, "item_id", "origin_folder").where("item_id is not null").groupBy("item_id").agg(F.min_by("origin_folder", "sidecar_id").alias("origin_folder"))
    return photos(spark, d, *MEASURES, *more).join(s, "item_id", "left")


@query
def category_scores(spark, d):
    return S.category_scores(_measured(spark, d))


def _all_scores(spark, d, label):
    scratch = Scratch(spark, label)
    m = _measured(spark, d).withColumn("shot", F.coalesce(S.screenshot()["score"], F.lit(0.0)))
    # The test tables have no signatures, whose rules are left out.
    m = scratch.save(m.withColumn("is_graphic", S.is_graphic(F.col("shot"), F.lit(None).cast("double"), F.lit(True))), "measured")
    return scratch.save(S.stored(S.category_scores(m), S.distribution_scores(m, scratch)), "scores")


@query
def distribution_scores(spark, d):
    return _all_scores(spark, d, "ecdf").where("category in ('blur', 'dark', 'overexposed')")


@query
def combined_score(spark, d):
    return S.combined(_all_scores(spark, d, "combined"))


@query
def top_flags(spark, d):
    return S.top_flags(_all_scores(spark, d, "flags"))


@query
def junk_counts(spark, d):
    return S.category_counts(_all_scores(spark, d, "junk"))


@query
def ecdf_values(spark, d):
    e = S.ecdf(photos(spark, d, "lap_var"), "lap_var", Scratch(spark, "ecdf-values"))
    return e.select(F.col("x"), F.round("below", 9).alias("below"), F.round("above", 9).alias("above"))


# Duplicates


@query
def exact_dups(spark, d):
    p = photos(spark, d, "sha256", "width", "height", "file_size").where("sha256 is not null")
    px = F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0))
    order = F.struct(px.alias("px"), F.coalesce("file_size", F.lit(0)).alias("size"), (-F.col("item_id")).alias("id"))
    best = p.groupBy("sha256").agg(F.count("*").alias("n"), (-F.max(order)["id"]).alias("keeper")).where("n > 1")
    members = Scratch(spark, "exact").save(p.join(best, "sha256").select("keeper", F.col("item_id").cast("string").alias("item_uid")))
    return G.group_keys(members, "keeper").select("keeper", F.col("size").alias("n"), "group_key")


def _eligible(spark, d):
    p = photos(spark, d, "phash64", "width", "height", "exif_dt", "exif_subsec", "sha256").where("phash64 is not null and phash64 <> 0")
    return p.withColumns({"capture_s": exif_wall(F.col("exif_dt"), MAX_YEAR), "subsec": subsec(F.col("exif_subsec"))})


def signature_of_hash(h):
    """A stand-in for the signatures that the test tables lack: every bit of the hash lights a cell of 4 by 4 luma pixels."""
    bit = lambda r, c: F.when(F.getbit(h, r * 8 + c) == 1, F.lit("1e" * 4)).otherwise(F.lit("00" * 4))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.repeat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: bit(r, c)), ""), 4))
    return F.when(h.isNotNull(), F.unhex(F.concat(F.array_join(rows, ""), F.lit("80" * 128))))


def _near(spark, d, distance, label):
    """Pairs between the smallest photos of distinct hashes; `hash_classes` tells the others of each."""
    reps = _eligible(spark, d).groupBy("phash64").agg(F.min("item_id").alias("item_id"))
    return C.exact_candidates(reps, Scratch(spark, label), distance)


@query
def near_candidates(spark, d):
    return _near(spark, d, 3, "near")


@query
def near_candidates_5(spark, d):
    return _near(spark, d, 5, "near5")


@query
def hash_classes(spark, d):
    """The photos of one hash, as one class named by its smallest."""
    p = _eligible(spark, d).select("item_id", "phash64")
    return p.join(p.groupBy("phash64").agg(F.min("item_id").alias("rep")), "phash64").select("item_id", "rep")


@query
def bucket_skips(spark, d):
    return C.bucket_skips(_eligible(spark, d), 3, 5)


@query
def vector_hashes(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", bits.vector_hash(F.col("embedding"), bits.median64(F.col("embedding"))).alias("h"))


def _checked(spark, d, label):
    """Candidate pairs of representatives of (hash, bytes, sizes, capture) with the check that rejects each."""
    scratch = Scratch(spark, label)
    looks = ["phash64", "width", "height", "capture_s", "subsec", "sha256"]
    p = scratch.save(_eligible(spark, d).groupBy(*looks).agg(F.min("item_id").alias("item_id")), "looks")
    edges = G.verified_edges(C.exact_candidates(p, scratch, 3), p, p.select("item_id", signature_of_hash(F.col("phash64")).alias("sig")), scratch, G.GroupParams())
    return scratch.save(edges.select("a", "b", F.coalesce("rejected", F.lit("none")).alias("rejected")), "checked")


@query
def edge_checks(spark, d):
    return _checked(spark, d, "checks")


@query
def reject_tally(spark, d):
    return _checked(spark, d, "tally").groupBy("rejected").agg(F.count("*").alias("n"))


@query
def components(spark, d):
    return connected(_checked(spark, d, "ccx").where("rejected = 'none'"), Scratch(spark, "cc"))


def _groupable(spark, d):
    """Photos with what find_groups needs: position, favorite, albums, url and time from their sidecars and files."""
    raw = sidecars(spark, d, "item_id", "url", "favorited", "folder", "folder_kind", "trashed", "taken_ts", "lat", "lon")
    albums = L.albums_by_url(raw)
    own = raw.where("item_id is not null").withColumn("at", position(F.col("lat"), F.col("lon"))).groupBy("item_id").agg(F.min_by("url", F.when(F.col("url").isNotNull(), F.col("sidecar_id"))).alias("url"), F.max("favorited").alias("favorited"), F.min_by("at", F.when(F.col("at").isNotNull(), F.col("sidecar_id"))).alias("sc_at"), F.min_by("taken_ts", "sidecar_id").alias("sc"))
    p = photos(spark, d, "sha256", "phash64", "width", "height", "file_size", "has_camera_exif", "exif_dt", "exif_offset", "exif_dt_any", "exif_subsec", "exif_lat", "exif_lon", "folder", "folder_kind", "export_id")
    p = p.join(own, "item_id", "left").join(albums, "url", "left").join(table(spark, d, "exports"), "export_id", "left")
    p = with_local_fields(p.withColumn("sc_ts", unix_field(F.col("sc"))), "exif_dt", "exif_offset", "exif_dt_any", "sc_ts", "folder", F.col("home_tz"), MAX_YEAR)
    at = F.coalesce("sc_at", position(F.col("exif_lat"), F.col("exif_lon")))
    album = F.when(F.col("folder_kind") == "album", F.array("folder")).otherwise(F.array().cast("array<string>"))
    p = p.withColumns({"lat": at["lat"], "lon": at["lon"], "favorited": F.coalesce("favorited", F.lit(0)), "albums_n": F.size(F.array_union(album, F.coalesce("url_albums", F.array().cast("array<string>"))))})
    return p.withColumns({"item_uid": F.col("item_id").cast("string"), "is_graphic": F.coalesce(F.col("phash64") == 0, F.lit(False)), "capture_s": exif_wall(F.col("exif_dt"), MAX_YEAR), "subsec": subsec(F.col("exif_subsec"))})


@query
def seed_groups(spark, d):
    """Groups in which every member matches its seed; signatures are derived from the hashes, as the test tables have none."""
    scratch = Scratch(spark, "seed")
    items = scratch.save(_groupable(spark, d), "groupable").withColumn("sig", signature_of_hash(F.col("phash64")))
    found = G.find_groups(items, scratch)
    return found["members"].select("seed_item_id", "item_id", "place", "dist", "is_keeper")


@query
def keeper_rank(spark, d):
    """The place of every copy but the best among those of its bytes, in the order of keepers."""
    scratch = Scratch(spark, "rank")
    p = scratch.save(G.with_keeper_rank(_groupable(spark, d).where("sha256 is not null")).select("item_id", "sha256", "keeper_rank"), "ranked")
    return G.with_places(p, scratch, "sha256").where("place > 0").select("item_id", F.col("place").cast("long").alias("place"))


# Collapse


def _records(spark, d):
    s = sidecars(spark, d, "item_id", "url", "favorited", "archived").where("item_id is not null").groupBy("item_id").agg(F.min_by(F.struct("url", "favorited", "archived"), "sidecar_id").alias("s"))
    p = photos(spark, d, "zipkey", "zip_name", "export_id", "member_idx", "member", "folder", "folder_kind", "filename", "sha256", "exif_dt", "exif_dt_any").where("sha256 is not null")
    return p.join(s, "item_id", "left").select(*p.columns, "s.url", F.coalesce("s.favorited", F.lit(0)).alias("favorited"), F.coalesce("s.archived", F.lit(0)).alias("archived"))


@query
def collapse(spark, d):
    a = L.assign_items(_records(spark, d))
    return a.select("item_id", F.col("is_primary").cast("int").alias("is_primary"), F.coalesce("reason", F.lit("")).alias("reason"))


@query
def flag_merge(spark, d):
    m = L.merged(L.assign_items(Scratch(spark, "flags").save(_records(spark, d)))).where("url is not null")
    return m.select("url", F.col("favorited").cast("long").alias("favorited"), F.col("archived").cast("long").alias("archived"), F.col("n_records"), F.col("albums_n").cast("long").alias("albums_n"))


@query
def album_sets(spark, d):
    s = sidecars(spark, d, "url", "folder", "folder_kind", "trashed")
    return L.albums_by_url(s).select("url", F.array_join(F.array_sort("url_albums"), "|").alias("albums"))


@query
def uid_suffixes(spark, d):
    """The uid of every record, as if each were an item: those of one url share theirs, other repeats are numbered."""
    r = L.with_uids(_records(spark, d).where("filename is not null").withColumn("local_date", F.lit(None).cast("string")))
    return r.select("item_id", "item_uid")


@query
def dense_ids(spark, d):
    p = _local(spark, d).withColumn("item_uid", F.concat(F.lit("x:"), F.col("item_id").cast("string")))
    return L.with_item_ids(p.withColumnRenamed("item_id", "photo"), Scratch(spark, "dense"), "new_id").select("photo", "new_id")


@query
def unindexed_by_day(spark, d):
    s = sidecars(spark, d, "item_id", "url", "taken_ts", "title").withColumn("ts", unix_field(F.col("taken_ts")))
    media = s.where("item_id is null").select(F.lit("image").alias("kind"), "url", F.coalesce("title", F.lit("")).alias("filename"), F.lit(None).cast("long").alias("file_size"), F.col("ts").alias("taken_ts"))
    u = L.unindexed(media, s.where("item_id is not null").select("url"), "America/New_York")
    return u.groupBy("day").agg(F.count("*").alias("n"))


# Pairing


@query
def pairing(spark, d):
    """The sidecar of every photo by names, titles and times alone."""
    m = photos(spark, d, "export_id", "folder", "filename", "exif_dt").select(F.col("item_id").alias("media_key"), "export_id", "folder", "filename", exif_wall(F.col("exif_dt"), MAX_YEAR).alias("exif_ts")).where("filename is not null")
    s = sidecars(spark, d, "export_id", "folder", "json_name", "title", "taken_ts").select(F.col("sidecar_id").alias("sidecar_key"), "export_id", "folder", "json_name", "title", unix_field(F.col("taken_ts")).alias("taken_ts")).where("json_name is not null")
    return pair(m, s, Scratch(spark, "pairing"))


@query
def mutual_best_match(spark, d):
    """Customers and suppliers of a nation with balances within 50, paired while each is the other's only best.

    Balances fall into buckets of 50, so a partner is in the same or a neighbouring one.
    """
    bucket = lambda c: F.floor(F.col(c) / 50)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("media_key"), F.col("c_nationkey").alias("k"), "c_acctbal", F.explode(F.array(*[bucket("c_acctbal") + i for i in (-1, 0, 1)])).alias("at"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sidecar_key"), F.col("s_nationkey").alias("k"), "s_acctbal", bucket("s_acctbal").alias("at"))
    q = F.abs(F.col("c_acctbal") - F.col("s_acctbal"))
    return mutual_best(c.join(s, ["k", "at"]).withColumn("q", q).where("q <= 50").select("media_key", "sidecar_key", "q"), Scratch(spark, "mutual"))


# Bursts


def _shots(spark, d, scratch):
    """Photos in the order of their wall clocks, with hash, model, measures and the group of equal bytes."""
    p = photos(spark, d, "exif_dt", "exif_subsec", "phash64", "model", "lap_var", "width", "height", "frac_dark", "frac_bright")
    p = p.withColumns({"item_uid": F.col("item_id").cast("string"), "taken_ts": exif_wall(F.col("exif_dt"), MAX_YEAR)})
    return scratch.save(p.join(_dup_members(spark, d).select("item_id", F.col("group_id").alias("dup_group")), "item_id", "left"), "shots")


def _bursts(spark, d, label):
    scratch = Scratch(spark, label)
    shots = _shots(spark, d, scratch)
    return scratch.save(B.time_bursts(shots, scratch), "bursts"), shots


@query
def bursts_time(spark, d):
    return _bursts(spark, d, "bt")[0]


@query
def burst_ranks(spark, d):
    return B.ranked(*_bursts(spark, d, "br")).select("burst", "item_id", F.col("rank").cast("long").alias("place"), F.col("is_best").cast("long").alias("is_best"))


@query
def burst_summary(spark, d):
    return B.burst_summary(*_bursts(spark, d, "bs")).withColumn("duration_s", F.round("duration_s", 6))


@query
def burst_extras(spark, d):
    members, shots = _bursts(spark, d, "be")
    rank = B.ranked(members, shots)
    return B.extra_reasons(B.burst_extras(rank), B.burst_summary(members, shots), rank)


@query
def bursts_by_name(spark, d):
    """Photos of a folder whose names tell of one burst."""
    return B.filename_bursts(photos(spark, d, "folder", "filename"))


# Serving


def _index(spark, d):
    i = _local(spark, d).join(photos(spark, d, "filename", "exif_lat", "exif_lon", "file_size"), "item_id").withColumnsRenamed({"exif_lat": "lat", "exif_lon": "lon"})
    return i.withColumn("item_uid", F.concat(F.lit("x:"), F.col("item_id").cast("string"))).withColumn("origin_folder", F.lit(None).cast("string"))


@query
def search_filters(spark, d):
    p = Q.SearchParams(date_from="2015-01-01", date_to="2019-12-31", filename_contains="IMG_", has_gps=True)
    return Q.filtered(_index(spark, d), p.validate()).select("item_id", "local_date")


@query
def search_semi(spark, d):
    p = Q.SearchParams(category="tiny", min_score=0.6).validate()
    return Q.filtered(_index(spark, d), p, S.category_scores(_measured(spark, d)).select("item_id", "category", "score")).select("item_id")


@query
def search_anti(spark, d):
    queued = sidecars(spark, d, "item_id", "favorited").where("favorited = 1").select(F.concat(F.lit("x:"), F.col("item_id").cast("string")).alias("item_uid")).where("item_uid is not null").distinct()
    return Q.filtered(_index(spark, d), Q.SearchParams(year=2018).validate(), queued=queued).select("item_id")


@query
def search_page(spark, d):
    """The second page of a search in calendar order: the limit is the feature."""
    page, _ = Q.search(_index(spark, d), Q.SearchParams(limit=50, offset=50), S.category_scores(_measured(spark, d)).select("item_id", "category", "score"))
    return page.select("item_id", "local_date", "score")


@query
def search_scored(spark, d):
    """Items without a position that have any score from 0.6 on, up to a day, by score: the limit is the feature."""
    p = Q.SearchParams(category="any", min_score=0.6, date_to="2019-12-31", has_gps=False, sort="score", limit=100)
    page, _ = Q.search(_index(spark, d), p, S.category_scores(_measured(spark, d)).select("item_id", "category", "score"))
    return page.select("item_id", "local_date", "score")


@query
def search_total(spark, d):
    """How many items a search finds, and where its next page begins."""
    _, total = Q.search(_index(spark, d), Q.SearchParams(filename_contains="img", year=2018, limit=10), S.category_scores(_measured(spark, d)).select("item_id", "category", "score"))
    return total


@query
def search_group(spark, d):
    """The members of one group of equal bytes, by its id: that of the smallest group."""
    members = Scratch(spark, "group").save(_dup_members(spark, d))
    first = members.agg(F.min("group_id").alias("g")).first()["g"]  # one number
    p = Q.SearchParams(group=f"dup:{first}").validate()
    return Q.filtered(_index(spark, d), p, dup_members=members).select("item_id")


@query
def junk_pages(spark, d):
    """The second page of small pictures: the limit is the feature."""
    return lookups.junk_page(S.category_scores(_measured(spark, d)), _index(spark, d), "tiny", 0.5, 5, 20).select("item_id", "score")


@query
def vector_topk(spark, d):
    """The 20 vectors most similar to a fixed direction: a top-k report."""
    return Q.vector_topk(table(spark, d, "embeddings"), [1.0 if i % 2 else -0.5 for i in range(64)], 20, -1.0, "vec_id", "embedding").select("vec_id")


@query
def items_in_zips(spark, d):
    z = table(spark, d, "zips").select("zipkey", "zip_id", F.col("name").alias("zip_name"))
    return table(spark, d, "items").join(z, "zipkey").select("item_id", "zip_id", "zip_name")


@query
def library_counts(spark, d):
    i = table(spark, d, "items")
    return i.groupBy("year").agg(F.count("*").alias("n"), F.count("emb_row").alias("n_vectors"), F.count_if(F.col("is_graphic") == 1).alias("n_graphic"))


def _dup_members(spark, d):
    p = photos(spark, d, "sha256").where("sha256 is not null")
    g = p.groupBy("sha256").agg(F.min("item_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    m = p.join(g, "sha256")
    return m.select("group_id", "item_id", (F.col("item_id") == F.col("group_id")).cast("int").alias("is_keeper"))


@query
def memberships(spark, d):
    """The group of equal bytes and the burst of every item."""
    members, shots = _bursts(spark, d, "memberships")
    rank = B.ranked(members, shots)
    bursts = rank.where("is_best = 1").select(F.col("burst").alias("burst_id"), F.col("item_id").alias("best_item_id"))
    return lookups.memberships(table(spark, d, "items"), _dup_members(spark, d), members.withColumnRenamed("burst", "burst_id"), bursts)


@query
def keeper_diff(spark, d):
    return lookups.keeper_diff(_dup_members(spark, d), photos(spark, d, "width", "height", "file_size", "filename"), ("width", "height", "file_size", "filename"))


@query
def uncertain_members(spark, d):
    url = sidecars(spark, d, "item_id", "url").where("item_id is not null").groupBy("item_id").agg(F.min("url").alias("url"))
    return lookups.uncertain_members(_dup_members(spark, d), photos(spark, d, "zipkey").join(url, "item_id", "left"))


@query
def relational_division(spark, d):
    chosen = photos(spark, d, "width").where("width >= 1000").select("item_id")
    return lookups.contained_groups(_dup_members(spark, d), chosen)


@query
def group_pages(spark, d):
    """The members of the first 20 groups: a page is the feature."""
    m = _dup_members(spark, d)
    g = m.groupBy("group_id").agg(F.count("*").alias("size"))
    return lookups.group_page(g, m, photos(spark, d, "filename"), 0, 20).select("group_id", "item_id", "is_keeper")


@query
def ordered_lookup(spark, d):
    want = table(spark, d, "items").where("emb_row is not null").select(F.col("emb_row").alias("ordinal"), "item_id")
    return lookups.by_ids(table(spark, d, "items").select("item_id", "item_uid"), want).select("item_id", "item_uid", "ordinal")


@query
def day_blockers(spark, d):
    """The days with favorites as approved rows, and all that speaks against taking each as a whole."""
    i = _index(spark, d).join(photos(spark, d, "folder"), "item_id")
    s = sidecars(spark, d, "item_id", "favorited", "taken_ts").withColumn("ts", unix_field(F.col("taken_ts"))).withColumn("day", wall_date(utc_to_wall(F.col("ts"), "UTC")))
    liked = s.where("favorited = 1 and item_id is not null").groupBy("item_id").agg(F.min("day").alias("local_date"))
    approved = liked.select(F.concat(F.lit("x:"), F.col("item_id").cast("string")).alias("item_uid"), "local_date")
    return lookups.day_safety(i, s.where("item_id is null").select("day"), approved)


# Shaping


def _library(spark, d, scratch):
    """Index rows with their sidecar's fields, scores, groups of equal bytes and what is uncertain about them."""
    told = F.struct("url", "title", "favorited", F.col("from_shared_album").alias("shared"), F.col("from_partner").alias("partner"))
    s = sidecars(spark, d, "item_id", "url", "title", "favorited", "from_shared_album", "from_partner").where("item_id is not null").groupBy("item_id").agg(F.min_by(told, "sidecar_id").alias("s"))
    i = _index(spark, d).join(photos(spark, d, "folder", "make", "model", "width", "height"), "item_id").join(s, "item_id", "left")
    i = i.select(*[c for c in i.columns if c != "s"], "s.url", "s.favorited", "s.shared", "s.partner", F.when(F.col("s.title") == F.col("filename"), "high").when(F.col("s").isNotNull(), "low").alias("match_conf"))
    i = scratch.save(i, "index")
    members = scratch.save(_dup_members(spark, d), "members")
    groups = members.join(i.select("item_id", "url"), "item_id").groupBy("group_id").agg((F.count_distinct("url") >= 2).cast("int").alias("deletable"))
    uncertain = scratch.save(shaping.uncertainty(groups, members, i), "uncertain")
    return i, scratch.save(S.category_scores(_measured(spark, d)), "scores"), members, uncertain


def _cards(spark, d, label):
    scratch = Scratch(spark, label)
    i, scores, members, uncertain = _library(spark, d, scratch)
    frames, shots = _bursts(spark, d, f"{label}-bursts")
    best = B.ranked(frames, shots).where("is_best = 1").select(F.col("burst").alias("burst_id"), F.col("item_id").alias("best_item_id"))
    inside = lookups.memberships(i, members, frames.withColumnRenamed("burst", "burst_id"), best)
    queue = i.where("favorited = 1").select("item_uid", F.lit("approved").alias("status"))
    return shaping.item_cards(i, scores, inside, uncertain, queue, "photos.example")


@query
def item_cards(spark, d):
    return _cards(spark, d, "cards").drop("item_uid")


@query
def sheet_legend(spark, d):
    """The legend of a sheet of the first 48 items: a page is the feature."""
    return shaping.legend(_cards(spark, d, "legend").orderBy("item_id").limit(48), [F.col("item_id")])


@query
def item_details(spark, d):
    i, scores, members, uncertain = _library(spark, d, Scratch(spark, "details"))
    return shaping.item_details(i, scores, members, uncertain)


@query
def uncertain_groups(spark, d):
    return _library(spark, d, Scratch(spark, "uncertain"))[3].select("item_id", "group_id", F.col("uncertain_group").cast("int").alias("uncertain_group"), F.col("maybe_same").cast("int").alias("maybe_same"))


@query
def queue_pages(spark, d):
    """A page of the approved rows in the order of the calendar: the limit is the feature."""
    s = sidecars(spark, d, "item_id", "favorited").where("item_id is not null and favorited = 1").groupBy("item_id").agg(F.min("sidecar_id").alias("proposed_at"))
    queue = s.select(F.concat(F.lit("x:"), F.col("item_id").cast("string")).alias("item_uid"), F.lit("approved").alias("status"), "proposed_at")
    i = _index(spark, d)
    approved = shaping.queue_page(queue, i, "approved", 10, 40).select("item_uid", "status", "local_date")
    proposed = shaping.queue_page(queue.withColumn("status", F.lit("proposed")), i, "proposed", 5, 20).select("item_uid", "status", "local_date")
    return approved.unionByName(proposed)


@query
def event_log(spark, d):
    """The 100 newest events: the limit is the feature."""
    e = table(spark, d, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("action"))
    return shaping.latest_events(e).select("seq", "action")


@query
def burst_pages(spark, d):
    """The frames of the first 20 bursts, the best first: a page is the feature."""
    frames, shots = _bursts(spark, d, "bpages")
    rank = B.ranked(frames, shots).select("burst", "item_id", "is_best")
    return lookups.group_page(frames.select("burst").distinct(), rank, photos(spark, d, "filename"), 0, 20, key="burst", first="is_best").select("burst", "item_id", "is_best", "filename")


@query
def library_summary(spark, d):
    """Counts of the whole library, by year, kind of group and category."""
    scratch = Scratch(spark, "summary")
    i = scratch.save(_index(spark, d).join(table(spark, d, "items").select("item_id", "emb_row"), "item_id", "left"), "items")
    groups = _dup_members(spark, d).select("group_id").distinct().withColumn("kind", F.lit("exact"))
    s = sidecars(spark, d, "item_id", "taken_ts").where("item_id is null").withColumn("ts", unix_field(F.col("taken_ts")))
    by_day = s.where("ts is not null").groupBy(wall_date(utc_to_wall(F.col("ts"), "UTC")).alias("local_date")).agg(F.count("*").alias("n"))
    return lookups.library_stats(i, groups, S.category_scores(_measured(spark, d)), by_day)


@query
def scan_survey(spark, d):
    """How often each field of a scan is there, and its members by kind."""
    c = names.classify(F.col("member"), F.col("file_size"))
    keys = ("title", "taken_ts", "creation_ts", "lat", "url", "description", "people", "origin_folder", "device_type", "from_shared_album", "from_partner", "favorited", "archived", "trashed")
    return survey(photos(spark, d, "exif_dt", "exif_offset", "has_camera_exif", "exif_lat", "err"), sidecars(spark, d, *keys), _members(spark, d).select(c.alias("c")).select("c.kind", "c.reason"))


@query
def quota_hours(spark, d):
    return table(spark, d, "events").select("event_id", reset_hour(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("hour"))


# Decisions and streams


def _decisions(events: DataFrame) -> DataFrame:
    kind = F.pmod(F.col("event_id"), F.lit(5))
    action = F.when(kind == 0, "propose").when(kind == 1, "approve").when(kind == 2, "reject").when(kind == 3, "add").otherwise("reset")
    return events.select(F.col("user_id").cast("string").alias("item_uid"), F.col("event_id").alias("seq"), action.alias("action"), F.lit("a").alias("actor"))


@query
def queue_fold(spark, d):
    return D.fold(_decisions(table(spark, d, "events")))


@query
def queue_counts(spark, d):
    """How many rows of each status the folded queue has."""
    return D.counts(D.fold(_decisions(table(spark, d, "events"))))


@query
def queue_rows(spark, d):
    """Queue rows with their items, those without one too."""
    q = sidecars(spark, d, "item_id").where("item_id is not null").select(F.concat(F.lit("x:"), F.col("item_id").cast("string")).alias("item_uid")).distinct()
    return lookups.queue_rows(q, _index(spark, d)).select("item_uid", "item_id", "local_date")


@query
def queue_log(spark, d):
    """Every decision that changed a row, with its status before and after and its revision."""
    return D.transitions(_decisions(table(spark, d, "events")))


@query
def batch_decisions(spark, d):
    """Decisions on whole batches spread over what was proposed in them before."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("item_uid"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 997 == 0, "reject_batch").otherwise("approve").alias("action"), F.lit("a").alias("actor"), F.col("event_type").alias("batch_id"))
    return D.with_batches_spread(e.where("seq % 997 = 0 or seq % 5 = 1"), e.where("seq % 5 = 0")).select("item_uid", "seq", "action", "batch_id")


@query
def latest_decisions(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("group_key"), F.col("event_id").alias("seq"), F.when(F.pmod(F.col("event_id"), F.lit(3)) == 0, "clear").otherwise("keeper").alias("action"), F.col("event_type").alias("keeper_uid"))
    return D.latest_decision(e)


@query
def proposal_batches(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("batch_id"), F.pmod(F.col("user_id"), F.lit(3)).cast("string").alias("actor"), F.col("event_id").alias("ts"))
    return D.batches(e)


@query
def event_sessions(spark, d):
    s = sessions(table(spark, d, "events"), ["event_type"], "ts", "60 seconds")
    return s.select("event_type", "n", F.unix_timestamp("start_ts").alias("start_s"), F.unix_timestamp("end_ts").alias("end_s"))


def _stream(spark, d, name):
    """The events as a file stream: the table's file is read through a glob."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")


@query
def stream_queue_fold(spark, d):
    """The fold of decisions run as a stream to its end, and its latest state per key."""
    scratch = Scratch(spark, "stream")
    out, check = f"{scratch.root}/rows", f"{scratch.root}/state"
    q = D.run_guarded(D.fold_stream(_decisions(_stream(spark, d, "events"))), lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(out), None, check)
    q.awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.groupBy("item_uid").agg(F.max(F.struct("batch", "seq", "status", "actor", "n_events")).alias("x"))
    return last.where("x.status is not null").select("item_uid", "x.status", "x.actor", "x.seq", "x.n_events")


@query
def stream_sessions(spark, d):
    """Sessions of the event stream run to its end, in complete mode."""
    scratch = Scratch(spark, "sessions")
    out = f"{scratch.root}/rows"
    s = sessions(_stream(spark, d, "events"), ["event_type"], "ts", "60 seconds")
    q = s.writeStream.outputMode("complete").option("checkpointLocation", f"{scratch.root}/state").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("event_type", "n", F.unix_timestamp("start_ts").alias("start_s"), F.unix_timestamp("end_ts").alias("end_s"))


from lumenfold.oracles import ORACLES  # noqa: E402,F401
