"""Facts told by the names of archive members: columns in, columns out, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, extensions and patterns that exports and apps use.
PHOTO_EXTS = ("jpg", "jpeg", "png", "heic", "heif", "webp", "gif")
VIDEO_EXTS = ("mp4", "mov", "3gp", "m4v", "mkv", "avi", "webm", "mts", "m2ts", "wmv", "mpg", "mpeg", "mp")
RAW_EXTS = ("dng", "cr2", "cr3", "nef", "arw", "rw2", "orf", "raf", "srw", "pef")
OTHER_IMAGE_EXTS = ("bmp", "tif", "tiff", "avif", "jxl")
NON_SIDECAR_JSON = ("metadata.json", "print-subscriptions.json", "shared_album_comments.json", "user-generated-memory-titles.json")
TRASH_FOLDERS = ("trash", "bin")
EDITED_WORDS = ("edited", "bearbeitet", "modifié", "editado", "modificato", "bewerkt", "redigerad")
EDITED_CUT = ("-edi", "-edit", "-edite")
CUT_BYTES = (47, 56)
MESSAGING = (
    ("whatsapp", r"(?i)^(?:IMG|VID)-\d{8}-WA\d{4}"),
    ("whatsapp", r"(?i)^WhatsApp (?:Image|Video) \d{4}-\d{2}-\d{2}"),
    ("messenger", r"(?i)^received_\d{6,}"),
    ("facebook", r"(?i)^FB_IMG_\d{6,}"),
    ("signal", r"(?i)^signal-\d{4}-\d{2}-\d{2}"),
    ("telegram", r"(?i)^photo_\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}"),
    ("snapchat", r"(?i)^Snapchat-\d{4,}"),
    ("reddit", r"(?i)^RDT_\d{8}_"),
)
SCREENSHOT = r"(?i)^(?:screenshot[_ (-]|screen shot |screencapture)"
EXT = r"^(.+)(\.[A-Za-z0-9]{1,10})$"
COPY = r"^(.*\S)\((\d{1,6})\)$"
BURST = r"(?i)^(.+?)_BURST(\d{3,})(_COVER)?(?:\.[A-Za-z0-9]+)?$"
RAW_BURST = r"(?i)^(PXL_\d{8}_\d{6,9})\.RAW-\d{2}\.(.+)$"


def first(*options: Column) -> Column:
    return F.coalesce(*options)


def match(c: Column, pattern: str, group: int) -> Column:
    """The group, or null if the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def stem(name: Column) -> Column:
    """The name without its extension: one to ten letters or digits after the last dot of a longer name."""
    return first(match(name, EXT, 1), name)


def dot_ext(name: Column) -> Column:
    return first(match(name, EXT, 2), F.when(name.isNotNull(), F.lit("")))


def ext_of(name: Column) -> Column:
    """The extension in lower case without its dot; empty if there is none."""
    return F.lower(F.substring(dot_ext(name), 2, 10))


def base(name: Column) -> Column:
    """The stem without the number of a copy, which never follows a blank."""
    return first(match(stem(name), COPY, 1), stem(name))


def copy_number(name: Column) -> Column:
    return match(stem(name), COPY, 2).cast("int")


def without_copy(name: Column) -> Column:
    return F.concat(base(name), dot_ext(name))


def is_edited(name: Column) -> Column:
    """An edited copy: the word of one of seven languages, or a cut form of it on a name at the limit of length."""
    b, size = F.lower(base(name)), F.octet_length(without_copy(name))
    words = b.rlike("-(?:" + "|".join(EDITED_WORDS) + ")$")
    return words | (size.between(*CUT_BYTES) & b.rlike("(?:" + "|".join(EDITED_CUT) + ")$"))


def export_id(zip_name: Column) -> Column:
    """The export that an archive is a part of: its name without part number, else its stem, never empty."""
    name = F.substring_index(F.replace(zip_name, F.lit("\\"), F.lit("/")), "/", -1)
    plain = F.regexp_replace(name, r"(?i)\.zip$", "")
    return first(match(name, r"(?i)^(.+?)-\d{3,}\.zip$", 1), F.when(plain == "", "default").otherwise(plain))


def year_of_folder(folder: Column) -> Column:
    return match(folder, r"^Photos from (\d{4})$", 1).cast("int")


def messaging_app(name: Column) -> Column:
    """The app whose way of naming saved files the name follows, the first of the ordered patterns."""
    return first(*[F.when(name.rlike(p), app) for app, p in MESSAGING])


def is_screenshot_name(name: Column) -> Column:
    return name.rlike(SCREENSHOT)


def burst_key(name: Column) -> Column:
    """What the frames of one burst share in their names; null if the name tells of none."""
    n = without_copy(name)
    number = match(n, BURST, 2)
    return first(match(n, RAW_BURST, 1), F.when(F.length(number) >= 14, F.concat(F.lit("BURST"), number)), match(n, BURST, 1))


def is_burst_cover(name: Column) -> Column:
    n = without_copy(name)
    parts = F.split(F.upper(match(n, RAW_BURST, 2)), r"\.")
    return first(F.array_contains(parts, "COVER"), F.when(n.rlike(BURST), F.regexp_extract(n, BURST, 3) != ""))


def classify(member: Column, file_size: Column, include_albums: bool = False, max_bytes: int = 200 * 1024 * 1024) -> Column:
    """struct(kind, folder, folder_kind, filename, reason) of a member, by its name and size; the order of the cases matters."""
    path = F.replace(member, F.lit("\\"), F.lit("/"))
    parts = F.split(path, "/")
    at = lambda i: F.get(parts, F.lit(i))
    folder, name, ext = at(2), at(3), ext_of(at(3))
    year = year_of_folder(folder).isNotNull()
    kind = F.when(year, "year").otherwise("album")
    none = F.lit(None).cast("string")

    def out(k: str, reason: str | None, f: Column = folder, fk: Column = kind, n: Column = name) -> Column:
        return F.struct(F.lit(k).alias("kind"), f.alias("folder"), fk.alias("folder_kind"), n.alias("filename"), F.lit(reason).cast("string").alias("reason"))

    image, video, other, raw = ext.isin(*PHOTO_EXTS), ext.isin(*VIDEO_EXTS), ext.isin(*OTHER_IMAGE_EXTS), ext.isin(*RAW_EXTS)
    return (
        F.when(path.endswith("/"), out("skip", "directory", none, none, none))
        .when((at(0) != "Takeout") | F.coalesce(at(1) != "Google Photos", F.lit(True)), out("skip", "outside_photos", none, none, none))
        .when((F.size(parts) == 3) & (ext_of(at(2)) == "json"), out("skip", "non_sidecar_json", none, none, at(2)))
        .when(F.size(parts) == 3, out("skip", "other", none, none, at(2)))
        .when((F.size(parts) != 4) | (folder == "") | (name == ""), out("skip", "other", none, none, none))
        .when(F.lower(folder).isin(*TRASH_FOLDERS), out("skip", "trash", folder, none))
        .when((ext == "json") & F.lower(name).isin(*NON_SIDECAR_JSON), out("skip", "non_sidecar_json"))
        .when(ext == "json", out("sidecar", None))
        .when((image | video | other) & is_edited(name), out("skip", "edited"))
        .when(raw, out("skip", "raw"))
        .when(other, out("skip", "other_image"))
        .when(image & ~year & F.lit(not include_albums), out("skip", "album_media"))
        .when(image & (file_size > max_bytes), out("skip", "too_large"))
        .when(image, out("image", None))
        .when(video & ~year, out("skip", "album_video"))
        .when(video, out("video", None))
        .otherwise(out("skip", "other"))
    )
