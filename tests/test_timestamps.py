"""Timestamps against a brute-force resolution with zoneinfo, and the defined edge cases."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lumenfold.operators.deliveries import latest_values
from lumenfold.operators.timestamps import with_instants, zone_offset_intervals

ZONES = ["America/New_York", "Europe/Berlin", "Australia/Sydney", "America/St_Johns", "Asia/Kathmandu"]


def epochs(spark, rows):
    df = spark.createDataFrame(rows, "id int, v string, off string, tz string, extra int, unused array<int>")
    out = with_instants(df, "v", "tz", "off", zones=[*ZONES, "Asia/Tokyo"])
    assert out.columns == [*df.columns, "epoch_s", "epoch_s_how"]
    return {r.id: (r.epoch_s, r.epoch_s_how) for r in out.collect()}


def at(*args):
    return int(datetime(*args, tzinfo=UTC).timestamp())


CASES = [
    ("2022:04:03 02:20:52", None, "Europe/Berlin", at(2022, 4, 3, 0, 20, 52)),
    ("2022-04-03T02:38:41", "+11:00", "Europe/Berlin", at(2022, 4, 2, 15, 38, 41)),
    ("2022-04-03T02:38:41Z", "+11:00", "Europe/Berlin", at(2022, 4, 3, 2, 38, 41)),
    ("2022-04-03T02:20:51.035413+1100", None, "Europe/Berlin", at(2022, 4, 2, 15, 20, 51)),
    ("06.03.2013 18:13:39", None, "Asia/Tokyo", at(2013, 3, 6, 9, 13, 39)),
    ("05.07.2019 21:56", None, "Asia/Tokyo", at(2019, 7, 5, 12, 56)),
    ("20190705T215615", None, "Asia/Tokyo", at(2019, 7, 5, 12, 56, 15)),
    ("Jan 23, 2019 7:48:33 PM", None, "Asia/Tokyo", at(2019, 1, 23, 10, 48, 33)),
    ("May 30, 2019, 12:33:22 AM UTC", None, "Asia/Tokyo", at(2019, 5, 30, 0, 33, 22)),
    ("Sat, 02 Apr 2022 15:54:21 +0000", None, "Asia/Tokyo", at(2022, 4, 2, 15, 54, 21)),
    ("11 September 2021 21:36:19 CEST", None, "Europe/Berlin", at(2021, 9, 11, 19, 36, 19)),
    ("2013-07-28 06:41:46 Australia/Sydney", None, "Asia/Tokyo", at(2013, 7, 27, 20, 41, 46)),
    ("2013-07-28 06:41:46 America/New_York", None, "Asia/Tokyo", at(2013, 7, 28, 10, 41, 46)),
    (" 2022:04:03 02:38:04\x00", "+00:00", "Asia/Tokyo", at(2022, 4, 3, 2, 38, 4)),
    ("1566350851", None, None, 1566350851),
    ("1685258337671", None, None, 1685258337),
    ("1510111869149271", None, None, 1510111869),
    ("1.562327780E+09", None, None, 1562327780),
    ("1575922967.5", None, None, 1575922967),
    # twice: the first, unless the offset tells; skipped: the offset before
    ("2022-11-06 01:30:00", None, "America/New_York", at(2022, 11, 6, 5, 30)),
    ("2022-11-06 01:30:00 EST", None, "America/New_York", at(2022, 11, 6, 6, 30)),
    ("2022-11-06 01:30:00", "-05:00", "America/New_York", at(2022, 11, 6, 6, 30)),
    ("2022-03-13 02:30:00", None, "America/New_York", at(2022, 3, 13, 7, 30)),
    # an unusable offset beside the value is passed over
    ("2022-07-01 12:00:00", "+25:00", "America/New_York", at(2022, 7, 1, 16)),
    ("2022-07-01 12:00:00", "+05:75", "America/New_York", at(2022, 7, 1, 16)),
]
NOTHING = ["", "   ", None, "unknown", "0000:00:00 00:00:00", "    :  :     :  :  ", "2019:02:30 10:00:00", "2107:05:05 05:05:05", "1989:12:31 10:00:00", "2017:06:12 27:61:00", "2015-09-14T25:10:00Z", "0", "0.0", "NaN", "N/A", "12345", "2021-00-10 09:00:00", "2020-01-01 10:00:00 Mars/Olympus", "9" * 40, "x" * 200_000]


def test_notations(spark):
    got = epochs(spark, [(i, v, off, tz, 1, [1]) for i, (v, off, tz, _) in enumerate(CASES)])
    assert {i: got[i][0] for i in got} == {i: c[3] for i, c in enumerate(CASES)}


def test_values_that_denote_nothing(spark):
    got = epochs(spark, [(i, v, None, "Europe/Berlin", None, None) for i, v in enumerate(NOTHING)])
    assert {i: e for i, (e, _) in got.items()} == dict.fromkeys(range(len(NOTHING)))


def test_without_a_zone_there_is_no_instant(spark):
    got = epochs(spark, [(1, "2020-01-01 10:00:00", None, None, 1, None), (2, "2020-01-01 10:00:00", None, "No/Where", 1, None)])
    assert got[1][0] is None and got[2][0] is None


def test_brute_force_around_changes(spark):
    """Every half hour around the changes of a year, against the definition."""
    rows, want = [], {}
    for zone in ZONES:
        tz = ZoneInfo(zone)
        for day in ("2019-03-10", "2019-03-31", "2019-04-07", "2019-10-06", "2019-10-27", "2019-11-03", "2019-12-31"):
            t0 = datetime.fromisoformat(day)
            for k in range(48):
                w = t0 + timedelta(minutes=30 * k)
                fits = sorted({int(w.replace(tzinfo=tz, fold=f).timestamp()) for f in (0, 1) if w.replace(tzinfo=tz, fold=f).astimezone(UTC).astimezone(tz).replace(tzinfo=None) == w})
                # the first of two; a skipped one with the offset before the change, which fold 0 gives
                want[len(rows)] = fits[0] if fits else int(w.replace(tzinfo=tz, fold=0).timestamp())
                rows.append((len(rows), w.strftime("%Y:%m:%d %H:%M:%S"), None, zone, 0, None))
    got = epochs(spark, rows)
    assert {i: e for i, (e, _) in got.items()} == want
    assert {how for _, how in got.values()} == {"zone", "ambiguous", "skipped"}


def test_empty_table(spark):
    assert epochs(spark, []) == {}


def test_intervals_are_gapless_in_utc(spark):
    rows = sorted((r.zone, r.ws - r.off, r.we - r.off) for r in zone_offset_intervals(spark, ZONES).collect())
    for a, b in zip(rows, rows[1:], strict=False):
        assert a[0] != b[0] or a[2] == b[1]


def test_repeated_deliveries(spark):
    df = spark.createDataFrame([(1, "a", None, 1), (1, None, "x", 2), (1, "b", None, 2), (None, "z", "z", 9), (2, None, None, 1), (3, "p", "q", None), (3, "r", None, 0)], "k int, u string, v string, t int").withColumn("scanned_at", F.col("t"))
    got = {r.k: (r.u, r.v) for r in latest_values(df, "k", ["u", "v"]).collect()}
    assert got == {1: ("b", "x"), 2: (None, None), 3: ("r", "q")}
    assert latest_values(df.limit(0), "k", ["u"]).count() == 0


@pytest.mark.parametrize("text", ["+15:00", "+05:60", "5", "", None])
def test_bad_offsets(spark, text):
    got = epochs(spark, [(1, "2022-07-01 12:00:00", text, "America/New_York", 0, None)])
    assert got[1][0] == at(2022, 7, 1, 16)
