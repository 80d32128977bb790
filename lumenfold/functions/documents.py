"""Fields of JSON sidecar documents, read with type checks and without raising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import photo_url, truncate_utf8

LIMITS = {"title": 1024, "description": 4096, "origin_folder": 1024, "device_type": 1024}
PEOPLE = (200, 200)  # names, and bytes of each
RAW_BYTES = 65536


TS_LIMIT = 10**12  # seconds beyond it are no times


def _usable(ts: Column) -> Column:
    return F.when((F.abs(ts) < TS_LIMIT) & (ts != 0), ts)


def unix_field(text: Column) -> Column:
    """Seconds of a text of 1 to 12 decimal digits, a minus before them allowed, blanks around them ignored; else null, as is 0."""
    return _usable(F.when(text.rlike(r"^\s*-?[0-9]{1,12}\s*$"), F.trim(F.regexp_replace(text, r"\s", "")).try_cast("long")))


def unix_number(number: Column) -> Column:
    """Seconds of a finite number, fractions dropped towards zero; 0 and sizes from 10^12 are null."""
    return _usable(F.when(F.abs(number) < TS_LIMIT, number.cast("long")))


def position(lat: Column, lon: Column) -> Column:
    """struct(lat, lon) of a finite position in range that isn't 0/0, else null."""
    finite = ~F.isnan(lat) & ~F.isnan(lon)
    good = finite & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon")))


def sidecar_fields(df: DataFrame, doc: str = "doc") -> DataFrame:
    """The fields of a sidecar document beside the columns of df; `err` tells why a text is none.

    Altitudes are those of a usable position. `raw` is the whole document where it is one.

    A byte-order mark is skipped. Null text gives err 'Missing', text that is no JSON object 'BadJson'; both give null fields.
    Wrong types read as null. Long texts are cut to their byte limits; people are at most 200.
    """
    text = F.regexp_replace(F.col(doc), "^\\x{FEFF}", "")
    d = df.withColumn("_v", F.try_parse_json(text))
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    as_text = lambda path: F.when(F.schema_of_variant(get(path, "variant")) == "STRING", get(path, "string"))
    kind = lambda path: F.schema_of_variant(get(path, "variant"))
    numeric = lambda path: kind(path).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)")
    num = lambda path: F.when(numeric(path), get(path, "double"))
    # Texts and numbers are read apart: "12.5" is no time, 12.5 is 12.
    when = lambda path: F.when(kind(path) == "STRING", unix_field(get(path, "string"))).when(numeric(path), unix_number(get(path, "double")))

    def geo(block: str) -> Column:
        at = position(num(f"$.{block}.latitude"), num(f"$.{block}.longitude"))
        return F.when(at.isNotNull(), F.struct(at["lat"].alias("lat"), at["lon"].alias("lon"), num(f"$.{block}.altitude").alias("alt")))

    flag = lambda path: F.when(get(path, "boolean"), 1).otherwise(0)
    present = lambda path: F.when(get(path, "variant").isNotNull(), 1).otherwise(0)
    written = lambda c: F.when(c.rlike(r"[^\s\p{Z}]"), c)
    people = F.slice(F.filter(F.transform(get("$.people", "array<struct<name string>>"), lambda p: truncate_utf8(written(p["name"]), PEOPLE[1])), lambda x: x.isNotNull()), 1, PEOPLE[0])
    origin = "$.googlePhotosOrigin"
    out = {
        "title": truncate_utf8(F.regexp_replace(written(as_text("$.title")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), LIMITS["title"]),
        "taken_ts": when("$.photoTakenTime.timestamp"),
        "creation_ts": when("$.creationTime.timestamp"),
        "geo": geo("geoData"),
        "geo_exif": geo("geoDataExif"),
        "url": photo_url(as_text("$.url")),
        "description": truncate_utf8(written(as_text("$.description")), LIMITS["description"]),
        "people": F.when(F.size(people) > 0, F.to_json(people)),
        "origin_folder": truncate_utf8(written(as_text(f"{origin}.mobileUpload.deviceFolder.localFolderName")), LIMITS["origin_folder"]),
        "device_type": truncate_utf8(written(as_text(f"{origin}.mobileUpload.deviceType")), LIMITS["device_type"]),
        "from_shared_album": present(f"{origin}.fromSharedAlbum"),
        "from_partner": present(f"{origin}.fromPartnerSharing"),
        "favorited": flag("$.favorited"),
        "archived": flag("$.archived"),
        "trashed": flag("$.trashed"),
        "raw": F.when(is_object, truncate_utf8(text, RAW_BYTES)),
        "err": F.when(F.col(doc).isNull(), "Missing").when(F.col("_v").isNull() | ~is_object, "BadJson"),
    }
    return d.withColumns(out).drop("_v")
