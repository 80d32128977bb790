"""Timestamps in mixed notations, precisions and zones, brought to UTC seconds.

A value is parsed by JVM regular expressions to a wall time (seconds as if it were UTC) and what it says of its
zone, or to Unix time. Wall times without an offset are resolved by an as-of join with the zone-offset intervals
of their zone, exploded to years: two matching intervals mean an ambiguous time, none a skipped one, and one gives
the offset directly.
"""

from __future__ import annotations

import functools
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1990, 2026

# Offsets in minutes of zone abbreviations, where the home zone does not use the abbreviation itself.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
ABSOLUTE = ("UTC", "GMT", "Z", "UT")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

INTERVALS = "zone string, ws long, we long, off int, abbr string"


def _spans(zone: str, first: int, last: int) -> tuple[tuple[int, int, int, str], ...]:
    """Intervals (start and end in wall seconds, offset in seconds, abbreviation) of one zone."""
    tz, step = ZoneInfo(zone), timedelta(days=14)

    def at(t: datetime) -> tuple[int, str]:
        local = t.astimezone(tz)
        offset = local.utcoffset()
        return offset.days * 86400 + offset.seconds, local.tzname()

    t, end = datetime(first - 1, 12, 1, tzinfo=UTC), datetime(last + 1, 2, 1, tzinfo=UTC)
    changes = [(int(t.timestamp()), *at(t))]
    while t < end:
        nxt = t + step
        if at(nxt) != changes[-1][1:]:
            lo, hi = int(t.timestamp()), int(nxt.timestamp())
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if at(datetime.fromtimestamp(mid, UTC)) == changes[-1][1:] else (lo, mid)
            changes.append((hi, *at(datetime.fromtimestamp(hi, UTC))))
        t = nxt
    ends = [c[0] for c in changes[1:]] + [int(end.timestamp())]
    return tuple((s + off, e + off, off, abbr) for (s, off, abbr), e in zip(changes, ends, strict=True))


@functools.lru_cache(maxsize=8)
def _interval_frame(zones: tuple[str, ...], first: int, last: int) -> pd.DataFrame:
    rows = [(zone, *span) for zone in zones for span in _spans(zone, first, last)]
    return pd.DataFrame(rows, columns=["zone", "ws", "we", "off", "abbr"])


def zone_offset_intervals(spark: SparkSession, zones: list[str] | None = None, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """One row per zone and interval of one offset: start and end in wall seconds, offset in seconds, abbreviation."""
    known = available_timezones()
    return spark.createDataFrame(_interval_frame(tuple(sorted(known.intersection(zones) if zones is not None else known)), first, last), INTERVALS)


def intervals_by_year(intervals: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """The intervals exploded to the years that they touch, as one array per zone and year: the side of the as-of join.

    A week more on either side of the year, so that a skipped time at its turn still finds its neighbours.
    """
    year_of = lambda c, days: F.year(F.timestamp_seconds(c + F.lit(days * 86400)))
    years = F.sequence(F.greatest(year_of(F.col("ws"), -7), F.lit(first)), F.least(year_of(F.col("we"), 7), F.lit(last)))
    inside = intervals.where((year_of(F.col("we"), 7) >= first) & (year_of(F.col("ws"), -7) <= last))
    return inside.withColumn("year", F.explode(years)).groupBy("zone", "year").agg(F.collect_list(F.struct("ws", "we", "off", "abbr")).alias("spans"))


def _tidy(value: Column) -> Column:
    """Kinds of blanks become one blank; NULs and other controls, and blanks at the ends, go."""
    blanks = F.regexp_replace(value.cast("string"), r"[\p{Z}\t\r\n]+", " ")
    return F.trim(F.regexp_replace(blanks, r"[\p{Cc}\p{Cf}]+", ""))


_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)? ?(?:([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r" ?\(?((?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+|[A-Za-z]{1,5})?\)?"
# Each notation is rewritten to @year|month|day|hour|minute|second|a or p|zone.
_NOTATIONS = (
    (rf"^(\d{{4}})([:/.-])(\d{{1,2}})\2(\d{{1,2}})[T ]{_CLOCK}{_ZONE}$", "@$1|$3|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T ](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]\d+)?(){_ZONE}$", "@$1|$2|$3|$4|$5|$6|$7|$8"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?[T ]{_CLOCK}{_ZONE}$", "@$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^(?:[A-Za-z]+\.?,? )?([A-Za-z]{{3,9}})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}),? {_CLOCK}{_ZONE}$", "@$3|$1|$2|$4|$5|$6|$7|$8"),
    (rf"^(?:[A-Za-z]+\.?,? )?(\d{{1,2}})[ -]([A-Za-z]{{3,9}})\.?[ -](\d{{4}}),? {_CLOCK}{_ZONE}$", "@$3|$2|$1|$4|$5|$6|$7|$8"),
)
_UNIX = r"^[+]?\d+(\.\d*)?([eE][+]?\d{1,2})?$"


def offset_seconds(text: Column) -> Column:
    """Seconds of an offset such as +02:00, +0200, -7 or UTC+2; null if beyond 14 hours or with minutes from 60."""
    parts = F.split(F.regexp_replace(text, r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?$", "$1|$2|$3"), r"\|")
    hours, minutes = F.get(parts, F.lit(1)).try_cast("int"), F.coalesce(F.get(parts, F.lit(2)).try_cast("int"), F.lit(0))
    seconds = hours * 3600 + minutes * 60
    good = (F.size(parts) == 3) & (minutes < 60) & (seconds <= 14 * 3600)
    return F.when(good, F.when(parts[0] == "-", -seconds).otherwise(seconds)).cast("int")


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integer arithmetic."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return (era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468).cast("long")


def parse_value(value: Column) -> Column:
    """The eight texts of a wall time as an array, or one text that is Unix time, or an empty array."""
    v = _tidy(value)
    for pattern, to in _NOTATIONS:
        v = F.regexp_replace(v, pattern, to)
    return F.when(v.startswith("@"), F.split(F.substring(v, 2, 2**31 - 1), r"\|", 8)).when(v.rlike(_UNIX), F.array(v))


def with_instants(df: DataFrame, value: str, home_tz: str, offset: str | None = None, out: str = "epoch_s", first: int = FIRST_YEAR, last: int = LAST_YEAR, zones: list[str] | None = None) -> DataFrame:
    """Add `out` (UTC seconds or null) and `<out>_how` ('unix', 'offset', 'zone', 'ambiguous', 'skipped' or null).

    value: the text; offset: column with an offset used where the value has none; home_tz: column with an IANA zone used
    after that. zones: IANA zones that may occur (all known ones by default; the table has a row per zone and year).
    Cases: null, empty, zero, impossible dates and years outside first..last give null; a wall time that occurs twice is
    the first one unless an offset or abbreviation tells; a skipped one is read with the offset before the change; an
    unknown zone in the value gives null; a wall time without any known zone gives null. Rows are kept one to one.
    """
    spark = df.sparkSession
    p = lambda i: F.get("_ts_p", F.lit(i))
    n = lambda i: p(i).try_cast("int")
    names = F.create_map(*[F.lit(x) for i, name in enumerate(MONTHS, 1) for k in sorted({name, name[:3], *(["sept"] if i == 9 else [])}) for x in (k, i)])
    # In stages, so that no expression is repeated in the generated code.
    d = df.withColumn("_ts_p", parse_value(F.col(value)))
    d = d.withColumns({"_ts_y": n(0), "_ts_m": F.coalesce(n(1), names[F.lower(p(1))]), "_ts_d": n(2), "_ts_h": n(3), "_ts_mi": n(4), "_ts_s": F.coalesce(n(5), F.lit(0)), "_ts_half": F.lower(p(6)), "_ts_raw": F.when(F.size("_ts_p") == 1, F.coalesce(p(0).try_cast("decimal(38,9)"), p(0).try_cast("double").try_cast("decimal(38,9)")))})
    year, month, day, hour, minute, second, half, raw = (F.col(c) for c in ("_ts_y", "_ts_m", "_ts_d", "_ts_h", "_ts_mi", "_ts_s", "_ts_half", "_ts_raw"))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    month_days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    unit = F.when(raw < F.lit(10**11), 1).when(raw < F.lit(10**14), 1000).when(raw < F.lit(10**17), 1000000).otherwise(1000000000)
    d = d.withColumns({
        "_ts_h": F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)),
        "_ts_md": month_days,
        "_ts_days": F.when((F.size("_ts_p") == 8) & month.between(1, 12) & year.between(first, last), days_from_civil(year, month, day)),
        "_ts_u": F.floor(raw / unit).try_cast("long"),
    })
    real = (day >= 1) & (day <= F.col("_ts_md")) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    lo, hi = int(datetime(first, 1, 1, tzinfo=UTC).timestamp()), int(datetime(last + 1, 1, 1, tzinfo=UTC).timestamp())
    d = d.withColumns({"_ts_w": F.when(real, F.col("_ts_days") * 86400 + hour * 3600 + minute * 60 + second), "_ts_u": F.when((F.col("_ts_u") >= lo) & (F.col("_ts_u") < hi), F.col("_ts_u"))})
    d = d.withColumn("_ts_z", F.when(F.col("_ts_w").isNotNull(), F.trim(p(7))))

    fixed = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 60)])
    zoned, upper = F.col("_ts_z") != "", F.upper("_ts_z")
    by_sign = F.col("_ts_z").rlike(r"^(?:UTC|GMT)?[+-]")
    named = F.col("_ts_z").contains("/")
    own = F.when(by_sign, offset_seconds(F.col("_ts_z"))).when(upper.isin(*ABSOLUTE), F.lit(0))
    beside = F.when(~zoned, offset_seconds(F.trim(F.col(offset)))) if offset else F.lit(None).cast("int")
    d = d.withColumn("_ts_off", F.coalesce(own, beside))
    d = d.withColumn("_ts_abbr", F.when(zoned & ~by_sign & ~named & ~upper.isin(*ABSOLUTE), upper))
    # A named zone decides; an abbreviation is looked up in the home zone first.
    d = d.withColumn("_ts_zone", F.when(F.col("_ts_off").isNull() & F.col("_ts_w").isNotNull() & ~F.coalesce(by_sign, F.lit(False)), F.when(named, F.col("_ts_z")).otherwise(F.col(home_tz))))
    d = d.withColumn("_ts_year", F.when(F.col("_ts_zone").isNotNull(), F.col("_ts_y")))

    spans = intervals_by_year(zone_offset_intervals(spark, zones, first, last), first, last)
    spans = spans.select(F.col("zone").alias("_ts_zone"), F.col("year").alias("_ts_year"), F.col("spans").alias("_ts_spans"))
    # Bounded by the number of IANA zones times years, whatever the data's size.
    d = d.join(F.broadcast(spans), ["_ts_zone", "_ts_year"], "left")
    w = F.col("_ts_w")
    hits = F.filter("_ts_spans", lambda s: (s["ws"] <= w) & (w < s["we"]))
    told = F.filter("_ts_spans", lambda s: s["abbr"] == F.col("_ts_abbr"))
    before = F.array_max(F.transform(F.filter("_ts_spans", lambda s: s["we"] <= w), lambda s: F.struct(s["we"].alias("we"), s["off"].alias("off"))))["off"]
    known = F.col("_ts_spans").isNotNull() & F.col("_ts_abbr").isNull()
    abbr_off = F.coalesce(F.get(told, F.lit(0))["off"], fixed[F.col("_ts_abbr")])
    # Of two intervals the one with the larger offset has the earlier instant.
    zone_off = F.when(F.size(hits) > 0, F.array_max(F.transform(hits, lambda s: s["off"]))).otherwise(before)
    used = F.when(F.col("_ts_off").isNotNull(), F.col("_ts_off")).when(F.col("_ts_abbr").isNotNull(), abbr_off).when(known, zone_off)
    how = (
        F.when(F.col("_ts_u").isNotNull(), F.lit("unix"))
        .when(used.isNull(), F.lit(None).cast("string"))
        .when(F.col("_ts_off").isNotNull() | F.col("_ts_abbr").isNotNull(), F.lit("offset"))
        .when(F.size(hits) > 1, F.lit("ambiguous"))
        .when(F.size(hits) == 1, F.lit("zone"))
        .otherwise(F.lit("skipped"))
    )
    d = d.withColumn(out, F.coalesce(F.col("_ts_u"), w - used)).withColumn(f"{out}_how", how)
    return d.select(*[c for c in df.columns if c not in (out, f"{out}_how")], out, f"{out}_how")
