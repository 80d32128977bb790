"""Local capture times by the reference order of sources: certain wall clocks before converted instants."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.names import year_of_folder
from lumenfold.operators.timestamps import days_from_civil, offset_seconds

EXIF = r"^\s*(\d{4})[:\-/](\d{2})[:\-/](\d{2})[ T](\d{2}):(\d{2}):(\d{2})"
MIN_YEAR = 1990
# Instants that have a date of four digits in every zone.
LOWEST, HIGHEST = -62135510400, 253402214400


def exif_wall(text: Column, max_year: int | None = None) -> Column:
    """Seconds of an EXIF wall clock as if it were UTC; null unless it is a real date from 1990 to next year."""
    top = max_year if max_year is not None else datetime.now(UTC).year + 1
    clean = F.when(text.rlike(EXIF), text)
    g = lambda i: F.regexp_extract(clean, EXIF, i).try_cast("int")
    y, mo, d, h, mi, s = (g(i) for i in range(1, 7))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
    real = y.between(MIN_YEAR, top) & mo.between(1, 12) & d.between(1, days) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)
    return F.when(real, days_from_civil(y, mo, d) * 86400 + h * 3600 + mi * 60 + s)


def exif_offset(text: Column) -> Column:
    """Seconds of ±hh:mm or ±hhmm within 14 hours, else null."""
    return F.when(text.rlike(r"^\s*[+-]\d{2}:?\d{2}\s*$"), offset_seconds(F.trim(text)))


def subsec(text: Column) -> Column:
    """Digits as a fraction of a second."""
    digits = F.regexp_extract(text, r"^\s*(\d{1,9})", 1)
    return F.when(digits != "", digits.try_cast("double") / F.pow(F.lit(10.0), F.length(digits)))


def wall_to_utc(wall: Column, zone: Column | str) -> Column:
    """UTC seconds of a wall clock in a zone; skipped and repeated times as the JVM resolves them."""
    z = F.lit(zone) if isinstance(zone, str) else zone
    return F.unix_timestamp(F.to_utc_timestamp(F.timestamp_seconds(wall), z))


def utc_to_wall(ts: Column, zone: Column | str) -> Column:
    """Wall seconds of an instant in a zone; null beyond four-digit years."""
    z = F.lit(zone) if isinstance(zone, str) else zone
    return F.when(ts.between(LOWEST, HIGHEST), F.unix_timestamp(F.from_utc_timestamp(F.timestamp_seconds(ts), z)))


def wall_date(wall: Column) -> Column:
    return F.date_format(F.timestamp_seconds(wall), "yyyy-MM-dd")


def wall_time(wall: Column) -> Column:
    return F.date_format(F.timestamp_seconds(wall), "HH:mm:ss")


def with_exif_walls(df: DataFrame, walls: dict[str, str], max_year: int | None = None) -> DataFrame:
    """Add for each name the wall seconds of a column, as exif_wall, in stages that keep the generated code small."""
    top = max_year if max_year is not None else datetime.now(UTC).year + 1
    texts = {f"_{o}_t": F.split(F.regexp_extract(F.regexp_replace(F.when(F.col(c).rlike(EXIF), F.col(c)), EXIF + r".*$", "$1 $2 $3 $4 $5 $6"), r"^[\d ]+", 0), " ") for o, c in walls.items()}
    d = df.withColumns(texts)
    d = d.withColumns({f"_{o}_{i}": F.get(f"_{o}_t", F.lit(i)).try_cast("int") for o in walls for i in range(6)})
    out = {}
    for o in walls:
        y, mo, day, h, mi, s = (F.col(f"_{o}_{i}") for i in range(6))
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        days = F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
        real = y.between(MIN_YEAR, top) & mo.between(1, 12) & day.between(1, days) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)
        out[o] = F.when(real, days_from_civil(y, mo, day) * 86400 + h * 3600 + mi * 60 + s)
    return d.withColumns(out).drop(*texts, *[f"_{o}_{i}" for o in walls for i in range(6)])


LOCAL = ("taken_ts", "taken_src", "local_date", "local_time", "day_uncertain", "year")


def with_local_fields(df: DataFrame, exif_dt: str, offset: str, exif_dt_any: str, sidecar_ts: str, folder: str, zone: Column, max_year: int | None = None) -> DataFrame:
    """Add taken_ts, taken_src, local_date, local_time, day_uncertain and year.

    taken_ts: the sidecar, else EXIF with its offset, else EXIF in the zone, else the other EXIF time in the zone. Local: EXIF
    (certain), the sidecar with the EXIF offset (certain), the sidecar in the zone (uncertain), the other EXIF time (uncertain).
    """
    d = with_exif_walls(df, {"_dto": exif_dt, "_any": exif_dt_any}, max_year)
    d = d.withColumns({"_off": exif_offset(F.col(offset)), "_zone": zone, "_sc": F.col(sidecar_ts)})
    dto, other, off, sc, z = (F.col(c) for c in ("_dto", "_any", "_off", "_sc", "_zone"))
    by_offset = F.when(sc.between(LOWEST, HIGHEST), sc + off)
    wall = F.when(dto.isNotNull(), dto).when(sc.isNotNull() & off.isNotNull(), by_offset).when(sc.isNotNull(), utc_to_wall(sc, z)).otherwise(other)
    d = d.withColumns({
        "_wall": wall,
        "taken_ts": F.coalesce(sc, dto - off, wall_to_utc(dto, z), wall_to_utc(other, z)),
        "taken_src": F.when(sc.isNotNull(), "sidecar").when(dto.isNotNull() & off.isNotNull(), "exif_offset").when(dto.isNotNull(), "exif_local").when(other.isNotNull(), "exif_any").otherwise("none"),
    })
    at = F.col("_wall")
    certain = dto.isNotNull() | (sc.isNotNull() & off.isNotNull() & at.isNotNull())
    d = d.withColumns({"local_date": wall_date(at), "local_time": wall_time(at), "day_uncertain": F.when(certain, 0).otherwise(1), "year": F.coalesce(F.year(F.timestamp_seconds(at)), year_of_folder(F.col(folder)))})
    return d.drop("_dto", "_any", "_off", "_sc", "_zone", "_wall")


def reset_hour(instant: Column, zone: str = "America/Los_Angeles") -> Column:
    """UTC hour of the next midnight of a zone after an instant in seconds, when daily quotas begin anew."""
    midnight = (F.floor(utc_to_wall(instant, zone) / 86400) + 1) * 86400
    return F.floor(F.pmod(wall_to_utc(midnight, zone), F.lit(86400)) / 3600).cast("int")
