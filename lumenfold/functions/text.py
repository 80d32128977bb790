"""Text functions that Spark lacks or does otherwise, and the cleaning of text for people."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full Unicode case folding of the composed form, which lower() isn't: ß folds to ss."""
    return s.map(lambda v: None if v is None else v.lower() if v.isascii() else unicodedata.normalize("NFC", v).casefold())


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


def truncate_utf8(c: Column, limit: int) -> Column:
    """At most `limit` bytes, without a character cut in two: the cut is moved before the bytes that go on a character."""
    b = F.encode(c, "UTF-8")
    goes_on = lambda at: F.hex(F.substring(b, at, 1)).rlike("^[89AB]")
    part = lambda k: F.substring(b, 1, limit - k).cast("string")
    cut = F.when(~goes_on(limit + 1), part(0)).when(~goes_on(limit), part(1)).when(~goes_on(limit - 1), part(2)).otherwise(part(3))
    return F.when(F.octet_length(c) <= limit, c).otherwise(cut)


# Controls, invisible marks, directional marks and tags that must not reach a screen.
UNSAFE = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2069}\x{feff}\x{e0000}-\x{e007f}]"


def strip_unsafe(c: Column) -> Column:
    """Without controls and invisible marks; blanks become one, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, UNSAFE, ""), r"\s+", " "))


def reason(c: Column) -> Column:
    """A cleaned reason of 3 to 300 characters, else null."""
    s = strip_unsafe(c)
    return F.when(F.length(s).between(3, 300), s)


def clean_text(c: Column, width: int) -> Column:
    """One line for a table: | becomes /, and what is longer than the width ends in an ellipsis."""
    s = F.replace(strip_unsafe(c), F.lit("|"), F.lit("/"))
    return F.when(F.length(s) > width, F.concat(F.rtrim(F.left(s, F.lit(width - 1))), F.lit("…"))).otherwise(s)


def csv_cell(c: Column) -> Column:
    """Text that a spreadsheet could take for a formula gets a quote before it."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike(r"^[=+\-@\t\r\n]"), F.concat(F.lit("'"), s)).otherwise(s)


def url_quote(c: Column) -> Column:
    """Percent encoding of all but letters, digits and -._~ of ASCII."""
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        c = F.replace(F.url_encode(c) if a == "+" else c, F.lit(a), F.lit(b))
    return c


def when_text(date: Column, time: Column, uncertain: Column) -> Column:
    """YYYY-MM-DD HH:MM, ~ after it where the day is uncertain, 'undated' without a day."""
    return F.when(date.isNull(), "undated").otherwise(F.concat(F.concat_ws(" ", date, F.left(time, F.lit(5))), F.when(uncertain == 1, "~").otherwise("")))


def image_tokens(w: Column, h: Column) -> Column:
    """Tokens of an image: its patches of 28 by 28."""
    return (F.ceil(w / 28) * F.ceil(h / 28)).cast("long")


def slug(c: Column, limit: int = 32) -> Column:
    """Lower-case letters, digits and - only; 'client' if nothing is left."""
    s = F.left(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(limit))
    return F.when(F.coalesce(s, F.lit("")) == "", "client").otherwise(s)


def photo_url(c: Column, host: str = "photos.google.com") -> Column:
    """The canonical https://<host>/photo/<id> of a link to a photo, else null."""
    pattern = rf"^https://{host.replace('.', '[.]')}/photo/([A-Za-z0-9_-]{{10,200}})/?(?:[?#][!-~]*)?$"
    return F.when((F.length(c) <= 2048) & c.rlike(pattern), F.concat(F.lit(f"https://{host}/photo/"), F.regexp_extract(c, pattern, 1)))


def url_id(c: Column) -> Column:
    """The last part of a url's path."""
    return F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1)


def recoverable_until(deleted_at: Column, days: int = 30) -> Column:
    """The last day on which something deleted can be restored."""
    return F.date_add(F.to_date(deleted_at), days)


def fixed(c: Column, digits: int) -> Column:
    """A number with fixed digits, rounded half to even on its exact binary value, which format_string isn't."""

    @F.pandas_udf(T.StringType())
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or v != v else f"{v:.{digits}f}")

    return form(c.cast("double"))


def percent(c: Column) -> Column:
    """A share as whole percent, rounded half to even on its exact binary value."""

    @F.pandas_udf(T.StringType())
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or v != v else f"{v:.0%}")

    return form(c.cast("double"))


def round_binary(c: Column, digits: int = 4) -> Column:
    """Rounded on the exact binary value, where round() goes by the shortest decimal."""

    @F.pandas_udf(T.DoubleType())
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or v != v else round(v, digits)).astype(float)

    return form(c.cast("double"))


def round_share(c: Column) -> Column:
    """A share from 1/32 on, at most 1, in four digits, rounded half to even on its exact binary value: as round_binary, in the JVM."""
    unit = 1 << 57  # such a share is a whole number of these parts
    n = (F.least(c, F.lit(1.0)) * float(unit)).cast("decimal(20,0)") * F.lit(10_000)
    q = F.call_function("div", n, F.lit(unit).cast("decimal(20,0)"))
    r = (n - q.cast("decimal(20,0)") * F.lit(unit).cast("decimal(20,0)")).cast("decimal(38,0)")
    up = (r > F.lit(unit // 2)) | ((r == F.lit(unit // 2)) & (q % 2 == 1))
    return (q + F.when(up, 1).otherwise(0)) / 10_000
