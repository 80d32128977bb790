"""Lookups of groups, bursts, memberships, days and the review queue: joins of index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.names import year_of_folder
from lumenfold.functions.text import url_quote
from lumenfold.plans.search import calendar_order, page

# What tells two copies apart for a person; sizes are compared as one.
DIFF_FIELDS = ("dims", "size_bytes", "ext", "local_date", "local_time", "filename", "match_conf", "link_conf", "albums_n", "shared", "partner", "favorited")


def by_ids(items: DataFrame, wanted: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows of the wanted keys in the order asked; wanted: key and ordinal. Keys not found give no row, repeated ones the first place."""
    first = wanted.groupBy(key).agg(F.min("ordinal").alias("ordinal"))
    return items.join(first, key).orderBy("ordinal")


def group_page(groups: DataFrame, members: DataFrame, items: DataFrame, offset: int = 0, limit: int = 50, kind: str | None = None, key: str = "group_id", first: str = "is_keeper") -> DataFrame:
    """The members of a page of groups, groups by id, the keeper (or best) first: the page is cut before members are joined."""
    offset, limit = page(offset, limit)
    g = groups.where(F.col("kind") == kind) if kind else groups
    some = g.orderBy(key).offset(offset).limit(limit)
    return members.join(F.broadcast(some.select(key)), key).join(items, "item_id").orderBy(key, F.desc(first), "item_id")  # at most a page of ids


def memberships(items: DataFrame, dup_members: DataFrame, burst_members: DataFrame, bursts: DataFrame) -> DataFrame:
    """(item_id, dup_group, is_keeper, burst, is_best): null where an item is in none."""
    d = dup_members.select("item_id", F.col("group_id").alias("dup_group"), "is_keeper")
    b = burst_members.join(bursts.select("burst_id", "best_item_id"), "burst_id").select("item_id", F.col("burst_id").alias("burst"), (F.col("item_id") == F.col("best_item_id")).cast("int").alias("is_best"))
    return items.select("item_id").join(d, "item_id", "left").join(b, "item_id", "left")


def keeper_diff(members: DataFrame, items: DataFrame, fields: tuple[str, ...] = DIFF_FIELDS, key: str = "group_id") -> DataFrame:
    """(key, item_id, diff): the fields in which a member differs from its group's keeper; null equals null.

    `dims` are width and height as one, `size_bytes` is file_size; fields that items lack are left out.
    """
    made = {"dims": ("width", F.struct("width", "height")), "size_bytes": ("file_size", F.col("file_size"))}
    fields = tuple(f for f in fields if f in items.columns or (f in made and made[f][0] in items.columns))
    values = [(F.col(f) if f in items.columns else made[f][1]).alias(f) for f in fields]
    rows = members.join(items.select("item_id", *values), "item_id")
    keeper = rows.where("is_keeper = 1").select(key, *[F.col(f).alias(f"k_{f}") for f in fields])
    diff = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"k_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return rows.join(keeper, key).where("is_keeper = 0").select(key, "item_id", F.array_join(diff, ",").alias("diff"))


def uncertain_members(members: DataFrame, items: DataFrame, key: str = "group_id") -> DataFrame:
    """Members that may be the keeper's own library item: without a url, or with the keeper's."""
    m = members.join(items.select("item_id", "url"), "item_id")
    keeper = m.where("is_keeper = 1").select(key, F.col("url").alias("keeper_url"))
    same = F.col("url").isNull() | F.col("keeper_url").isNull() | (F.col("url") == F.col("keeper_url"))
    return m.where("is_keeper = 0").join(keeper, key).where(same).select(key, "item_id")


def contained_groups(members: DataFrame, chosen: DataFrame, key: str = "group_id") -> DataFrame:
    """Groups all of whose members are chosen: relational division."""
    c = chosen.select("item_id").distinct().withColumn("in", F.lit(True))
    return members.join(c, "item_id", "left").groupBy(key).agg(F.bool_and(F.coalesce("in", F.lit(False))).alias("all")).where("all").select(key)


def junk_page(scores: DataFrame, items: DataFrame, category: str, min_score: float = 0.5, offset: int = 0, limit: int = 50) -> DataFrame:
    """Items of a category by score, then by the calendar."""
    offset, limit = page(offset, limit)
    s = scores.where((F.col("category") == category) & (F.col("score") >= min_score))
    return items.join(s.select("item_id", "score"), "item_id").orderBy(F.desc("score"), *calendar_order()).offset(offset).limit(limit)


def queue_rows(queue: DataFrame, items: DataFrame) -> DataFrame:
    """Queue rows with their items; rows of items that aren't in this index stay, without an id."""
    return queue.join(items.select("item_uid", "item_id", "local_date", "local_time"), "item_uid", "left")


def day_stats(items: DataFrame) -> DataFrame:
    """(local_date, n, n_uncertain) of dated items."""
    return items.where("local_date is not null").groupBy("local_date").agg(F.count("*").alias("n"), F.sum("day_uncertain").cast("long").alias("n_uncertain"))


def undated_counts(items: DataFrame) -> DataFrame:
    """(year, n) of undated items, by the year of their folder where there is none; null for an unknown year."""
    return items.where("local_date is null").groupBy(F.coalesce("year", year_of_folder(F.col("folder"))).alias("year")).agg(F.count("*").alias("n"))


# Why a day can't be taken as a whole, in the order they are told.
DAY_BLOCKERS = ("no_indexed_photos", "not_all_approved", "not_indexed_that_day", "day_uncertain", "undated_in_year", "undated_unknown_year", "unindexed_undated")


def day_safety(items: DataFrame, unindexed: DataFrame, approved: DataFrame) -> DataFrame:
    """One row per day with approved rows: its counts, the codes of all that speaks against taking it as a whole, and whether nothing does.

    items: item_uid, local_date, day_uncertain, year, folder. unindexed: day, null where unknown. approved: item_uid of approved rows, each
    once, and a local_date that counts where the item isn't in the index. Undated items speak against the days of their year, those of
    unknown year and undated media without a row against every day.
    """
    known = items.select("item_uid", F.col("local_date").alias("indexed_date"), F.lit(1).alias("here"))
    own = F.col("local_date") if "local_date" in approved.columns else F.lit(None).cast("string")
    chosen = approved.select("item_uid", own.alias("own_date")).join(known, "item_uid", "left").withColumn("local_date", F.coalesce("indexed_date", F.when(F.col("here").isNull(), F.col("own_date"))))
    days = chosen.where("local_date is not null").groupBy("local_date").agg(F.count("here").alias("n_approved"))
    others = unindexed.where("day is not null").groupBy(F.col("day").alias("local_date")).agg(F.count("*").alias("n_not_indexed"))
    undated = undated_counts(items)
    by_year = undated.where("year is not null").select(F.col("year").cast("int").alias("_year"), F.col("n").alias("n_undated_in_year"))
    # Two tables of one row each.
    unknown = undated.agg(F.coalesce(F.sum(F.when(F.col("year").isNull(), F.col("n"))), F.lit(0)).alias("n_undated_unknown_year")).withColumn("_one", F.lit(1))
    dateless = unindexed.agg(F.count_if(F.col("day").isNull()).alias("n_unindexed_undated")).withColumn("_one", F.lit(1))
    d = days.withColumns({"_one": F.lit(1), "_year": F.left("local_date", F.lit(4)).cast("int")})
    d = d.join(day_stats(items), "local_date", "left").join(others, "local_date", "left").join(by_year, "_year", "left").join(unknown, "_one").join(dateless, "_one")
    counts = ["n", "n_approved", "n_not_indexed", "n_uncertain", "n_undated_in_year", "n_undated_unknown_year", "n_unindexed_undated"]
    d = d.select("local_date", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    c = F.col
    checks = (c("n") == 0, (c("n") > 0) & (c("n_approved") != c("n")), c("n_not_indexed") > 0, c("n_uncertain") > 0, c("n_undated_in_year") > 0, c("n_undated_unknown_year") > 0, c("n_unindexed_undated") > 0)
    codes = F.array_join(F.array(*[F.when(x, F.lit(code)) for code, x in zip(DAY_BLOCKERS, checks, strict=True)]), ",")
    return d.withColumn("blockers", codes).withColumn("safe", F.when(F.col("blockers") == "", 1).otherwise(0))


def photo_link(url_col: str = "url", name_col: str = "filename", account: int | None = None, host: str = "photos.google.com") -> F.Column:
    """struct(link, conf): the canonical url with high confidence, else a search for the name's stem with low, else none."""
    from lumenfold.functions.names import stem

    root = f"https://{host}" + (f"/u/{account}" if account is not None else "")
    direct = F.replace(F.col(url_col), F.lit(f"https://{host}"), F.lit(root))
    text = stem(F.col(name_col))
    return F.when(F.col(url_col).isNotNull(), F.struct(direct.alias("link"), F.lit("high").alias("conf"))).when(F.coalesce(text, F.lit("")) != "", F.struct(F.concat(F.lit(f"{root}/search/"), url_quote(text)).alias("link"), F.lit("low").alias("conf"))).otherwise(F.struct(F.lit(None).cast("string").alias("link"), F.lit("none").alias("conf")))


def library_stats(items: DataFrame, groups: DataFrame, scores: DataFrame, videos_by_day: DataFrame) -> DataFrame:
    """(key, value) of the whole library: counts, per year, per kind of group and per category."""
    one = lambda df, name, c: df.agg(c.cast("long").alias("value")).select(F.lit(name).alias("key"), "value")
    per = lambda df, prefix, col: df.groupBy(col).agg(F.count("*").alias("value")).select(F.concat_ws(":", F.lit(prefix), F.coalesce(F.col(col).cast("string"), F.lit("unknown"))).alias("key"), "value")
    parts = [one(items, "items", F.count("*")), one(items, "with_vector", F.count("emb_row") if "emb_row" in items.columns else F.lit(0)), one(items, "undated", F.count_if(F.col("local_date").isNull())), one(videos_by_day, "unindexed", F.coalesce(F.sum("n"), F.lit(0))), per(items, "year", "year"), per(groups, "groups", "kind"), per(scores.where("score >= 0.5"), "category", "category")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
