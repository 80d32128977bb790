"""Filtered, ranked and vector search over the index tables."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import casefold
from lumenfold.operators.scores import CATEGORIES, SHOW_MIN, top_flags

# Limits of a search.
MAX_TEXT, MAX_LIMIT, MAX_OFFSET, SIMILARITY_MIN = 200, 200, 10_000_000, 0.18
GROUP = re.compile(r"^(dup|burst):(\d{1,9})$")


@dataclass
class SearchParams:
    """What to search; every filter is optional and all are combined."""

    vector: list[float] | None = None
    category: str | None = None
    min_score: float | None = None
    date_from: str | None = None
    date_to: str | None = None
    year: int | None = None
    filename_contains: str | None = None
    origin_contains: str | None = None
    group: str | None = None
    has_gps: bool | None = None
    exclude_queued: bool = True
    sort: str | None = None
    limit: int = 50
    offset: int = 0

    def validate(self) -> SearchParams:
        """Raise ValueError for what is out of range; blank texts become None."""

        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        for name in ("filename_contains", "origin_contains"):
            v = getattr(self, name)
            need(v is None or (isinstance(v, str) and len(v) <= MAX_TEXT), f"{name} is too long")
            setattr(self, name, (v or "").strip() or None)
        need(self.category in (None, "any", *CATEGORIES), "unknown category")
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        need(self.min_score is None or (number(self.min_score) and 0 <= self.min_score <= 1), "min_score must be 0..1")
        for v in (self.date_from, self.date_to):
            need(v is None or bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", v)), "dates must be YYYY-MM-DD")
            if v:
                date.fromisoformat(v)
        need(self.year is None or (type(self.year) is int and 1800 <= self.year <= 2200), "year out of range")
        need(self.group is None or bool(GROUP.match(self.group)), "group must be dup:<id> or burst:<id>")
        need(self.has_gps in (None, True, False) and type(self.exclude_queued) is bool, "flags must be bool")
        need(self.sort in (None, "score", "date", "similarity"), "unknown sort")
        need(self.sort != "similarity" or self.vector is not None, "sort=similarity needs a vector")
        page(self.offset, self.limit, MAX_LIMIT)
        return self


def page(offset: int, limit: int, most: int = 10_000) -> tuple[int, int]:
    """A valid page, else ValueError."""
    if type(limit) is not int or not 1 <= limit <= most:
        raise ValueError(f"limit must be 1..{most}")
    if type(offset) is not int or not 0 <= offset <= MAX_OFFSET:
        raise ValueError("offset out of range")
    return offset, limit


def calendar_order(c: str = "") -> list[Column]:
    """By date with undated last, then time and id."""
    return [F.col(f"{c}local_date").isNull(), F.col(f"{c}local_date"), F.col(f"{c}local_time"), F.col(f"{c}item_id")]


def filtered(items: DataFrame, p: SearchParams, scores: DataFrame | None = None, dup_members: DataFrame | None = None, burst_members: DataFrame | None = None, queued: DataFrame | None = None) -> DataFrame:
    """Items that pass all filters. Membership filters are semi-joins, hidden ones an anti-join; comparisons push down."""
    d = items
    if p.date_from:
        d = d.where(F.col("local_date") >= p.date_from)
    if p.date_to:
        d = d.where(F.col("local_date") <= p.date_to)
    if p.year is not None:
        d = d.where(F.col("year") == p.year)
    for text, col in ((p.filename_contains, "filename"), (p.origin_contains, "origin_folder")):
        if text:
            d = d.where(casefold(F.col(col)).contains(text.casefold()))
    if p.has_gps is not None:
        both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
        d = d.where(both if p.has_gps else ~both)
    least = p.min_score if p.min_score is not None else SHOW_MIN if p.category else None
    if least is not None and scores is not None:
        s = scores.where(F.col("score") >= least)
        d = d.join((s if p.category in (None, "any") else s.where(F.col("category") == p.category)).select("item_id"), "item_id", "left_semi")
    if p.group:
        kind, number = GROUP.match(p.group).groups()
        members, col = (dup_members, "group_id") if kind == "dup" else (burst_members, "burst_id")
        d = d.join(members.where(F.col(col) == int(number)).select("item_id"), "item_id", "left_semi")
    if p.exclude_queued and queued is not None:
        d = d.join(queued.select("item_uid"), "item_uid", "left_anti")
    return d


def with_score(d: DataFrame, p: SearchParams, scores: DataFrame) -> DataFrame:
    """Add score: the chosen category's, else the highest."""
    s = scores if p.category in (None, "any") else scores.where(F.col("category") == p.category)
    return d.join(s.groupBy("item_id").agg(F.max("score").alias("score")), "item_id", "left")


def dot(values: Column, query: list[float]) -> Column:
    """Dot product with a fixed vector, summed in double precision; null for a vector of another length."""
    q = F.array(*[F.lit(float(np.float32(v))) for v in query])
    products = F.zip_with(values, q, lambda a, b: a.cast("double") * b)
    return F.when(F.size(values) == len(query), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def unit(query: list[float]) -> list[float]:
    q = np.asarray(query, np.float32)
    n = float(np.linalg.norm(q))
    return (q / n if n > 0 else q).tolist()


def vector_topk(vectors: DataFrame, query: list[float], k: int, min_similarity: float = SIMILARITY_MIN, key: str = "emb_row", vector: str = "emb") -> DataFrame:
    """(key, sim): the k rows most similar to a query, from the least similarity on; ties by key. One ordered take, no shuffle of vectors."""
    d = vectors.select(key, dot(F.col(vector), unit(query)).alias("sim")).where(F.col("sim") >= min_similarity)
    return d.orderBy(F.desc("sim"), key).limit(k)


def search(items: DataFrame, p: SearchParams, scores: DataFrame, vectors: DataFrame | None = None, **tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page of rows, one row with total and next_offset).

    The page is found on ids, sort keys and scores only; full rows join to it afterwards.
    """
    p.validate()
    keys = ["item_id", "item_uid", "local_date", "local_time"] + (["emb_row"] if p.vector is not None else [])
    d = with_score(filtered(items, p, scores, **tables).select(*keys), p, scores)
    if p.vector is not None:
        sims = vectors.select("emb_row", dot(F.col("emb"), unit(p.vector)).alias("sim")).where(F.col("sim") >= SIMILARITY_MIN)
        d = d.join(sims, "emb_row")
    sort = p.sort or ("similarity" if p.vector is not None else "score" if p.category else "date")
    lead = {"date": [], "score": [F.coalesce("score", F.lit(0.0)).desc()], "similarity": [F.desc("sim")] if p.vector is not None else []}[sort]
    order = [*lead, *calendar_order()]
    rows = d.orderBy(*order).offset(p.offset).limit(p.limit)
    total = d.agg(F.count("*").alias("total")).withColumn("next_offset", F.when(F.col("total") > p.offset + p.limit, F.lit(p.offset + p.limit)))
    slim = rows.select("item_id", "score", *(["sim"] if p.vector is not None else []))
    return items.join(F.broadcast(slim), "item_id").orderBy(*order), total  # a page has at most MAX_LIMIT rows


def flags(scores: DataFrame, k: int = 5) -> DataFrame:
    """(item_id, flags): the highest scores of each item in order."""
    t = top_flags(scores, k)
    return t.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "category", "score"))), lambda x: F.struct(x["category"].alias("category"), F.round(x["score"], 3).alias("score"))).alias("flags"))


def within_budget(rows: DataFrame, cost: str, budget: int, order: list[Column]) -> DataFrame:
    """The rows of an ordered page until their summed cost passes the budget; the first row always stays.

    rows is a page, so it is bounded by its limit.
    """
    from pyspark.sql import Window

    w = Window.orderBy(*order)
    d = rows.withColumn("_sum", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return d.where((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")
