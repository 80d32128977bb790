"""Media files paired with their sidecars: six ordered rules, each a join, and mutual unique-best assignment.

All joins are equi-joins within (export_id, folder), so a folder of any size is spread by name; prefixes of titles are exploded
rather than compared. A rule's candidates are confirmed, and pairs that are the only best from both sides are taken, again and
again until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.names import NON_SIDECAR_JSON, base, classify, copy_number, dot_ext, is_edited, match, without_copy
from lumenfold.functions.text import casefold, nfc
from lumenfold.session import Scratch

# Fixed values of the naming scheme.
SUPP = ".supplemental-metadata"
CUT_MIN_BYTES, PREFIX_MIN = 40, 20
ZONE_S, WINDOW_S = 14 * 3600, 86400 + 14 * 3600
PLACE = ["export_id", "folder"]
PAIR = "media_key long, sidecar_key long, rule string, conf string"


def _same_format(ext: Column) -> Column:
    return F.when(ext == "jpeg", "jpg").when(ext == "heif", "heic").when(ext == "tiff", "tif").otherwise(ext)


def _key(name: Column) -> Column:
    """The folded stem with its copy number and the folded extension, for comparing titles with names."""
    n = F.trim(name)
    number = F.coalesce(F.concat(F.lit("("), copy_number(n).cast("string"), F.lit(")")), F.lit(""))
    return F.struct(casefold(F.concat(base(n), number)).alias("stem"), _same_format(F.lower(F.substring(dot_ext(n), 2, 10))).alias("ext"))


def _media(media: DataFrame) -> DataFrame:
    m = media.where(~is_edited(F.col("filename"))).withColumn("lit", nfc(F.col("filename")))
    m = m.select(F.col("media_key"), *PLACE, "lit", "exif_ts", copy_number(F.col("lit")).alias("m_dup"), without_copy(F.col("lit")).alias("plain"), base(F.col("lit")).alias("base"))
    m = m.withColumns({"lit_key": _key(F.col("lit")), "plain_key": _key(F.col("plain")), "base_cf": casefold(F.col("base")), "plain_cf": casefold(F.col("plain")), "lit_cf": casefold(F.col("lit"))})
    return m.withColumn("cut", (F.octet_length("lit") >= CUT_MIN_BYTES) & (F.length("base") >= PREFIX_MIN))


def _sidecars(sidecars: DataFrame, present: DataFrame) -> DataFrame:
    s = sidecars.withColumn("name", nfc(F.col("json_name"))).withColumn("name_cf", casefold(F.col("name")))
    s = s.where(F.col("name_cf").endswith(".json") & ~F.col("name_cf").isin(*NON_SIDECAR_JSON))
    core = F.expr("left(name, length(name) - 5)")
    pattern = r"^(.*\S)\((\d{1,6})\)$"
    title = nfc(F.when(F.trim("title") != "", F.trim("title")))
    s = s.select("sidecar_key", *PLACE, "name", "name_cf", "taken_ts", title.alias("title"), casefold(F.coalesce(match(core, pattern, 1), core)).alias("stem_cf"), match(core, pattern, 2).cast("int").alias("s_dup"), (F.octet_length("name") >= CUT_MIN_BYTES).alias("long"))
    s = s.withColumn("title_key", F.when(F.col("title").isNotNull(), _key(F.col("title")))).withColumn("title_cf", casefold(F.col("title")))
    # A numbered sidecar whose unnumbered sibling describes another file got its number by a collision of cut names.
    plain = s.where("s_dup is null and title_cf is not null").groupBy(*PLACE, "stem_cf").agg(F.min("title_cf").alias("t_lo"), F.max("title_cf").alias("t_hi"))
    s = s.join(plain, [*PLACE, "stem_cf"], "left")
    other = F.coalesce((F.col("t_lo") != F.col("title_cf")) | (F.col("t_hi") != F.col("title_cf")), F.lit(False))
    s = s.withColumn("collision", F.col("s_dup").isNotNull() & F.col("long") & F.col("title_cf").isNotNull() & other).drop("t_lo", "t_hi")
    return s.join(present.withColumnRenamed("key", "title_key"), [*PLACE, "title_key"], "left").withColumn("names_present", F.coalesce("here", F.lit(False))).drop("here")


def _confirmed(c: DataFrame) -> DataFrame:
    """Candidates that title and time don't refute, with their quality (less is better) and confidence; rule is a column."""
    named = (F.col("title_key") == F.col("lit_key")) | (F.col("title_key") == F.col("plain_key"))
    prefix = F.col("cut") & (F.col("title_key.ext") == F.col("plain_key.ext")) & F.col("title_key.stem").startswith(F.col("base_cf")) & ~F.col("names_present")
    no_title = F.when(~F.col("rule").isin("R3", "R4", "R6"), 2)
    title_rank = F.when(F.col("title").isNull(), no_title).when(named, 0).when(prefix, 1)
    dt = F.abs(F.col("taken_ts") - F.col("exif_ts"))
    off = dt % 900
    time_rank = F.when(dt.isNull(), 2).when(dt > WINDOW_S, F.lit(None).cast("int")).when((dt <= ZONE_S) & ((off <= 1) | (off >= 899)), 0).when(dt <= ZONE_S, 1).otherwise(2)
    d = c.withColumns({"title_rank": title_rank, "time_rank": time_rank, "dup_rank": F.when(F.col("s_dup").eqNullSafe(F.col("m_dup")), 0).otherwise(1)})
    d = d.where("title_rank is not null and time_rank is not null and not (title_rank = 1 and time_rank <> 0)")
    conf = F.when((F.col("title_rank") == 0) | ((F.col("title_rank") == 1) & ~F.col("rule").isin("R3", "R6")), "high").otherwise("low")
    return d.select("rule", "media_key", "sidecar_key", F.struct("title_rank", "dup_rank", "time_rank").alias("q"), conf.alias("conf"))


def _titled(m: DataFrame, s: DataFrame) -> DataFrame:
    """Media that a sidecar's title can confirm: named by it, or cut names that begin it."""
    t = s.where("title is not null")
    keys = m.select("*", F.explode(F.array_distinct(F.array("lit_key", "plain_key"))).alias("title_key"))
    named = t.join(keys, [*PLACE, "title_key"]).select(*t.columns, *[c for c in m.columns if c not in PLACE])
    starts = t.where(F.length("title_key.stem") >= PREFIX_MIN).select("*", F.explode(F.sequence(F.lit(PREFIX_MIN), F.length("title_key.stem"))).alias("n")).withColumn("base_cf", F.left(F.col("title_key.stem"), F.col("n"))).drop("n")
    begun = starts.join(m.where("cut"), [*PLACE, "base_cf"]).select(*named.columns)
    return named.unionByName(begun)


def _by_name(m: DataFrame, s: DataFrame) -> dict[str, DataFrame]:
    """Candidates of the rules that go by the sidecar's name, from one join on exact and one on folded names."""
    js, number = F.lit(".json"), F.concat(F.lit("("), F.col("m_dup").cast("string"), F.lit(")"))
    dup = F.coalesce(number, F.lit(""))
    # Null where a name has no number: such keys are left out.
    key = lambda rule, c: F.struct(F.lit(rule).alias("rule"), c.alias("key"))
    whole = [F.concat("lit", F.lit(SUPP), js), F.concat("lit", js)]
    moved = [F.concat("plain", F.lit(SUPP), number, js), F.concat("plain", number, js)]
    bare = [F.when(F.col("plain") != F.col("base"), F.concat("base_cf", x, dup, js)) for x in (F.lit(""), F.lit(SUPP))]

    def joined(keys: list[Column], on: str) -> DataFrame:
        d = m.select("*", F.inline(F.array_distinct(F.filter(F.array(*keys), lambda x: x["key"].isNotNull())))).withColumnRenamed("key", on)
        return s.join(d, [*PLACE, on])

    exact = joined([*(key("R1", c) for c in whole), *(key("R2", c) for c in moved)], "name")
    any_case = [F.concat("lit_cf", F.lit(SUPP), js), F.concat("lit_cf", js), F.concat("plain_cf", F.lit(SUPP), number, js), F.concat("plain_cf", number, js)]
    folded = joined([*(key("R4", c) for c in bare), *(key("R5", c) for c in any_case)], "name_cf")
    return {"exact": exact, "folded": folded}


def mutual_best(edges: DataFrame, scratch: Scratch, left: str = "media_key", right: str = "sidecar_key", quality: str = "q") -> DataFrame:
    """The edges taken by repeating: keep those that are the only best of both their ends, drop their ends' other edges.

    edges: distinct pairs of longs with a quality, less is better. Ends when a round takes none, so there are at most as many rounds as
    the longest chain of edges of which each one's taking frees the next. Ties of quality on one side leave both edges open. A side's
    best is told by two aggregates, its smallest and its largest partner of the least quality, so a hot end is no burden.
    """
    keep = [c for c in edges.columns if c != quality]
    rest, taken = edges, None
    while True:
        def only(end: str, other: str) -> DataFrame:
            lo, hi = (F.min(F.struct(F.col(quality).alias("q"), x.alias("o")))["o"] for x in (F.col(other), -F.col(other)))
            return rest.groupBy(end).agg(lo.alias(other), hi.alias("_hi")).where(F.col(other) == -F.col("_hi")).drop("_hi")

        pairs = only(left, right).join(only(right, left), [left, right])
        won, n = scratch.save_counted(rest.join(pairs, [left, right], "left_semi").select(*keep), "won")
        if not n:
            break
        taken = won if taken is None else taken.unionByName(won)
        before = rest
        rest, n = scratch.save_counted(rest.join(won.select(left), left, "left_anti").join(won.select(right), right, "left_anti"), "rest")
        scratch.drop(before if before is not edges else None)
        if not n:
            break
    return taken if taken is not None else edges.where("false").select(*keep)


RULES = ("R1", "R2", "R3", "R4", "R5", "R6")


def candidates(m: DataFrame, s: DataFrame, scratch: Scratch) -> DataFrame:
    """(rule, media_key, sidecar_key, q, conf): the confirmed candidates of all rules, each pair once a rule. No rule's depend on what others took."""
    t = _titled(m, s)
    same_number = F.col("m_dup").eqNullSafe(F.col("s_dup"))
    cut = F.concat("plain_cf", F.lit(SUPP)).startswith(F.col("stem_cf")) | (F.col("cut") & F.col("stem_cf").startswith(F.col("base_cf")))
    r3 = F.col("long") & (F.length("stem_cf") >= PREFIX_MIN) & cut & (same_number | (F.col("m_dup").isNull() & F.col("collision")))
    by_title = t.select("*", F.explode(F.array_compact(F.array(F.when(r3, F.lit("R3")), F.when(same_number, F.lit("R6"))))).alias("rule"))
    found = None
    for d in (*_by_name(m, s).values(), by_title):
        c = _confirmed(d)
        found = c if found is None else found.unionByName(c)
    return scratch.save(found.distinct(), "candidates")


def pair(media: DataFrame, sidecars: DataFrame, scratch: Scratch) -> DataFrame:
    """(media_key, sidecar_key, rule, conf): every media key, with 'none' where no sidecar belongs to it.

    media: media_key long, export_id, folder, filename, exif_ts; videos and skipped media included. sidecars: sidecar_key long,
    export_id, folder, json_name, title, taken_ts. Edited copies never own a sidecar. Nulls in a place match nothing. The candidates of
    all rules are found in one pass; a rule is then settled among those whose ends no earlier rule took.
    """
    m = scratch.save(_media(media), "media")
    present = m.select(*PLACE, F.explode(F.array("lit_key", "plain_key")).alias("key")).distinct().withColumn("here", F.lit(True))
    s = scratch.save(_sidecars(sidecars, present), "sidecars")
    every = candidates(m, s, scratch)
    some = {r["rule"] for r in every.select("rule").distinct().collect()}  # six at most
    found = None
    for rule in RULES:
        if rule not in some:
            continue
        left = every.where(F.col("rule") == rule).select("media_key", "sidecar_key", "q", "conf", "rule")
        if found is not None:
            left = left.join(found.select("media_key"), "media_key", "left_anti").join(found.select("sidecar_key"), "sidecar_key", "left_anti")
        won = mutual_best(left, scratch)
        found = won if found is None else found.unionByName(won)
    out = media.select("media_key").distinct()
    if found is None:
        return out.select("media_key", F.lit(None).cast("long").alias("sidecar_key"), F.lit("none").alias("rule"), F.lit("none").alias("conf"))
    out = out.join(found, "media_key", "left")
    return out.select("media_key", "sidecar_key", F.coalesce("rule", F.lit("none")).alias("rule"), F.coalesce("conf", F.lit("none")).alias("conf"))


SKIPPED_MEDIA = ("raw", "other_image", "too_large")  # reasons by which library items have no row


def media_of_all_kinds(images: DataFrame, videos: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """The media that take part in pairing: kind ('image', 'video' or 'skipped'), key, export_id, folder, filename, file_size and exif_ts.

    Videos and skipped media own sidecars, so images must not take them. skipped: key, export_id, member, reason and file_size; folder and
    name are told from the member, and only media of a year folder skipped for one of SKIPPED_MEDIA count.
    """
    cols = ["kind", "key", "export_id", "folder", "filename", "file_size", "exif_ts"]
    none = F.lit(None).cast("long")
    out = images.withColumn("kind", F.lit("image")).select(*cols)
    if videos is not None:
        out = out.unionByName(videos.withColumns({"kind": F.lit("video"), "exif_ts": none}).select(*cols))
    if skipped is not None:
        c = classify(F.col("member"), F.lit(None).cast("long"), include_albums=True)
        d = skipped.where(F.col("reason").isin(*SKIPPED_MEDIA)).withColumn("c", c).where("c.folder_kind = 'year' and c.filename is not null")
        out = out.unionByName(d.select(F.lit("skipped").alias("kind"), "key", "export_id", "c.folder", "c.filename", "file_size", none.alias("exif_ts")))
    return out


def unpaired(sidecars: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sidecars that no media file claimed."""
    return sidecars.join(pairs.where("sidecar_key is not null").select("sidecar_key"), "sidecar_key", "left_anti")


def pairing_stats(pairs: DataFrame) -> DataFrame:
    """(rule, conf, n) over all media."""
    return pairs.groupBy("rule", "conf").agg(F.count("*").alias("n"))
