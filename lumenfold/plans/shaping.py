"""Rows as people and tools see them: flags, tags, links, queue pages, details and legends, each a projection over index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import clean_text, when_text
from lumenfold.plans.lookups import photo_link
from lumenfold.plans.search import page

# Widths of cleaned texts, and how many scores a tag line shows.
NAME_WIDTH, DESCRIPTION_WIDTH, REASON_WIDTH, FLAG_TOP = 120, 500, 120, 3


def attr_flags() -> Column:
    """What makes taking an item away riskier or harder: shared, from a partner, a favorite, without a link."""
    on = lambda c, name: F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.lit(name))
    return F.array_compact(F.array(on("shared", "shared"), on("partner", "partner"), on("favorited", "fav"), F.when(F.coalesce("url", F.lit("")) == "", F.lit("nolink"))))


def two_digits(c: Column) -> Column:
    """A score in hundredths as text."""
    n = F.rint(c * 100).cast("long")
    return F.concat((n - n % 100).__truediv__(100).cast("long").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def ranked_scores(scores: DataFrame) -> DataFrame:
    """(item_id, flags): all positive scores of an item, the highest first, as structs of category, score and cleaned reason."""
    f = F.struct((-F.col("score")).alias("k"), "category", F.round("score", 3).alias("score"), clean_text(F.col("reason"), REASON_WIDTH).alias("reason"), F.col("score").alias("exact"))
    return scores.where("score > 0").groupBy("item_id").agg(F.array_sort(F.collect_list(f)).alias("flags"))


def junk_flags(flags: Column, top: int = FLAG_TOP) -> Column:
    """The first flags as category:0.95."""
    return F.transform(F.slice(flags, 1, top), lambda x: F.concat(x["category"], F.lit(":"), two_digits(x["exact"])))


def group_tag() -> Column:
    """dup3:keeper,burst1:best; a ? after a group that may be one library item; - for an item in none."""
    dup = F.when(F.col("dup_group").isNotNull(), F.concat(F.lit("dup"), F.col("dup_group").cast("string"), F.when(F.coalesce("uncertain_group", F.lit(False)), "?").otherwise(""), F.when(F.col("is_keeper") == 1, ":keeper").otherwise("")))
    burst = F.when(F.col("burst").isNotNull(), F.concat(F.lit("burst"), F.col("burst").cast("string"), F.when(F.col("is_best") == 1, ":best").otherwise("")))
    return F.when(dup.isNull() & burst.isNull(), "-").otherwise(F.concat_ws(",", dup, burst))


def uncertainty(groups: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, group_id, uncertain_group, maybe_same): whether a member's group may be one library item, and whether the member may be its keeper's own.

    A group is uncertain if it is not deletable. A member but the keeper may be the same in an uncertain group, or if it or the keeper has
    no url, or both have one. groups: group_id, deletable; members: group_id, item_id, is_keeper.
    """
    m = members.join(groups.select("group_id", (F.coalesce("deletable", F.lit(0)) == 0).alias("uncertain_group")), "group_id").join(items.select("item_id", F.coalesce("url", F.lit("")).alias("_url")), "item_id")
    keeper = m.where("is_keeper = 1").groupBy("group_id").agg(F.min("_url").alias("_keeper"))
    m = m.join(keeper, "group_id", "left").withColumn("_keeper", F.coalesce("_keeper", F.lit("")))
    same = (F.col("is_keeper") != 1) & (F.col("uncertain_group") | (F.col("_url") == "") | (F.col("_keeper") == "") | (F.col("_url") == F.col("_keeper")))
    return m.select("item_id", "group_id", "uncertain_group", same.alias("maybe_same"))


def link_of(host: str = "photos.google.com", account: int | None = None) -> Column:
    """struct(link, conf); a link told by a pairing of low confidence may show another photo, so its confidence is low."""
    link = photo_link(account=account, host=host)
    conf = F.when((link["conf"] == "high") & ~F.coalesce(F.col("match_conf") == "high", F.lit(False)), "low").otherwise(link["conf"])
    return F.struct(link["link"].alias("link"), conf.alias("conf"))


def item_cards(items: DataFrame, scores: DataFrame, memberships: DataFrame, uncertain: DataFrame, queue: DataFrame, host: str = "photos.google.com") -> DataFrame:
    """One row per item with flags, attributes, tag, link, queue status, and whether it is protected.

    Protected are shared, partner's and favorite items and those of an uncertain group. memberships: see `lookups.memberships`; uncertain:
    see `uncertainty`; queue: item_uid, status. Items in none of these tables keep their row.
    """
    d = items.join(ranked_scores(scores), "item_id", "left").join(memberships, "item_id", "left").join(uncertain.select("item_id", "uncertain_group", "maybe_same"), "item_id", "left").join(queue.select("item_uid", F.col("status").alias("queue_status")), "item_uid", "left")
    on = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    possible = F.coalesce("uncertain_group", F.lit(False))
    link = link_of(host)
    return d.select(
        "item_id", "item_uid", clean_text(F.col("filename"), NAME_WIDTH).alias("filename"), when_text(F.col("local_date"), F.col("local_time"), F.col("day_uncertain")).alias("taken"),
        link["link"].alias("photos_url"), link["conf"].alias("link_conf"), F.array_join(junk_flags(F.coalesce("flags", F.array().cast("array<struct<k: double, category: string, score: double, reason: string, exact: double>>"))), " ").alias("flags"),
        F.array_join(attr_flags(), ",").alias("attrs"), group_tag().alias("tag"), possible.cast("int").alias("possible_same"), F.coalesce("maybe_same", F.lit(False)).cast("int").alias("maybe_same"),
        (on("shared") | on("partner") | on("favorited") | possible).cast("int").alias("protected"), "queue_status",
    )


def queue_page(queue: DataFrame, items: DataFrame, status: str, offset: int = 0, limit: int = 500) -> DataFrame:
    """A page of the queue's rows of one status: by time of proposal and uid, approved ones by the calendar, rows without an item last in their place.

    The order is found on keys; the page is what callers join full rows to.
    """
    offset, limit = page(offset, limit)
    d = queue.where(F.col("status") == status).join(items.select("item_uid", "item_id", "local_date", "local_time"), "item_uid", "left")
    calendar = [F.col("local_date").isNull(), F.coalesce("local_date", F.lit("")), F.coalesce("local_time", F.lit("")), F.col("item_id").isNull(), F.coalesce("item_id", F.lit(0)), F.col("item_uid")]
    return d.orderBy(*(calendar if status == "approved" else [F.col("proposed_at"), F.col("item_uid")])).offset(offset).limit(limit)


def latest_events(events: DataFrame, limit: int = 100) -> DataFrame:
    """The newest events first, of equal times the later in the log."""
    _, limit = page(0, limit)
    return events.orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def item_details(items: DataFrame, scores: DataFrame, members: DataFrame, uncertain: DataFrame) -> DataFrame:
    """(item_id, details): everything about an item as one JSON text, nulls included; texts of others stand in a block of their own.

    Of its group a row tells size and keeper, not all members: these are a join away and may be many.
    """
    group = members.groupBy("group_id").agg(F.count("*").alias("size"), F.min(F.when(F.col("is_keeper") == 1, F.col("item_id"))).alias("keeper_id"))
    g = members.select("item_id", "group_id").join(group, "group_id").join(uncertain.select("item_id", "uncertain_group", "maybe_same"), "item_id", "left")
    in_group = F.struct("group_id", "size", "keeper_id", F.coalesce("uncertain_group", F.lit(False)).alias("uncertain"), F.coalesce("maybe_same", F.lit(False)).alias("maybe_same_item_as_keeper"))
    d = items.join(g.select("item_id", in_group.alias("duplicate_group")), "item_id", "left").join(ranked_scores(scores), "item_id", "left")
    told = F.struct(clean_text(F.col("filename"), NAME_WIDTH).alias("filename"), clean_text(F.col("folder"), NAME_WIDTH).alias("folder"), F.when(F.concat_ws(" ", "make", "model") != "", clean_text(F.concat_ws(" ", "make", "model"), NAME_WIDTH)).alias("camera"))
    info = F.struct(
        F.col("item_id").alias("id"), F.col("local_date").alias("date"), F.col("local_time").alias("time"), (F.coalesce("day_uncertain", F.lit(0)) != 0).alias("day_uncertain"),
        F.concat_ws("x", F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))).alias("size"), F.rint(F.coalesce("file_size", F.lit(0)) / 1024).cast("long").alias("file_kb"), attr_flags().alias("flags"),
        F.transform(F.coalesce("flags", F.array().cast("array<struct<k: double, category: string, score: double, reason: string, exact: double>>")), lambda x: F.struct(x["category"].alias("category"), two_digits(x["exact"]).alias("score"), x["reason"].alias("reason"))).alias("scores"),
        "duplicate_group", told.alias("untrusted_text"),
    )
    return d.select("item_id", F.to_json(info, {"ignoreNullFields": "false"}).alias("details"))


def legend(cards: DataFrame, order: list[Column]) -> DataFrame:
    """(n, line): the legend of a contact sheet of an ordered page of cards: number, id, time, name, flags and tag, one line each.

    cards is a page, so it is bounded by its limit.
    """
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy(*order))
    line = F.concat_ws(" | ", n.cast("string"), F.concat(F.lit("#"), F.col("item_id").cast("string")), "taken", "filename", F.when(F.col("flags") == "", "-").otherwise(F.col("flags")), F.when(F.col("attrs") == "", "-").otherwise(F.col("attrs")), "tag")
    return cards.select(n.alias("n"), line.alias("line"))
