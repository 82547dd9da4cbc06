from datetime import datetime, timezone

import pytest

from tidewave.operators.timestamps import to_utc


def us(*args, micro=0):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


NY, PHX = "America/New_York", "America/Phoenix"
CASES = [
    ("2020-03-11T16:38:14-04:00", None, us(2020, 3, 11, 20, 38, 14), "zoned"),
    ("2019-10-22 19:30:38.181318+00", None, us(2019, 10, 22, 19, 30, 38, micro=181318), "zoned"),
    ("2020-04-02 12:42:11.210-0600", None, us(2020, 4, 2, 18, 42, 11, micro=210000), "zoned"),
    ("2019-09-07T02:14:24.630110770Z", None, us(2019, 9, 7, 2, 14, 24, micro=630110), "zoned"),
    ("1584380597.879386", None, us(2020, 3, 16, 17, 43, 17, micro=879386), "zoned"),
    ("1572410778", None, 1572410778 * 10**6, "zoned"),
    ("1568504455629", None, 1568504455629 * 10**3, "zoned"),
    ("1568504455629123", None, 1568504455629123, "zoned"),
    ("20200401T223743Z", None, us(2020, 4, 1, 22, 37, 43), "zoned"),
    ("Sat, 16 Jan 2021 11:19:47 -0700", None, us(2021, 1, 16, 18, 19, 47), "zoned"),
    ("Sat Mar 21 03:21:17 +0000 2020", None, us(2020, 3, 21, 3, 21, 17), "zoned"),
    ("2020-04-23 09:54:24 CDT", NY, us(2020, 4, 23, 14, 54, 24), "zoned"),
    ("2020-03-22T21:55:15.239796-05:00[America/Chicago]", None, us(2020, 3, 23, 2, 55, 15, micro=239796), "zoned"),
    ("2020-07-01T12:00:00[America/Phoenix]", NY, us(2020, 7, 1, 19), "local"),
    ("03/13/2022 12:20:04 AM", PHX, us(2022, 3, 13, 7, 20, 4), "local"),
    ("10/31/2019 12:23:35 PM", PHX, us(2019, 10, 31, 19, 23, 35), "local"),
    ("April 24, 2022 6:39 AM", NY, us(2022, 4, 24, 10, 39), "local"),
    ("2020-11-01 01:30:00", NY, us(2020, 11, 1, 5, 30), "ambiguous"),
    ("2020-03-08 02:30:00", NY, None, "skipped"),
    ("2020-03-08 02:30:00", PHX, us(2020, 3, 8, 9, 30), "local"),
    ("2020-03-08 02:30:00", "Mars/Olympus", None, "unknown zone"),
    ("2020-03-08 02:30:00", None, None, "unknown zone"),
    ("2021-02-29 02:30:00", NY, None, "unreadable"),
    ("2021-02-28 24:30:00", NY, None, "unreadable"),
    ("2021-02-28 10:30:00 XYZ", NY, None, "unreadable"),
    ("2021-02-28", PHX, us(2021, 2, 28, 7), "local"),
    ("unknown", NY, None, "unreadable"),
    ("", NY, None, "unreadable"),
    (None, NY, None, "unreadable"),
    ("7" * 100000, NY, None, "unreadable"),
]


def test_all_forms(spark):
    df = spark.createDataFrame([(i, s, z, "clash") for i, (s, z, _, _) in enumerate(CASES)], "i int, s string, z string, utc_us string")
    df = df.withColumnRenamed("utc_us", "utc")
    got = {r.i: (r.utc_us, r.utc_case) for r in to_utc(df, "s", "z").collect()}
    for i, (s, z, want, case) in enumerate(CASES):
        assert got[i] == (want, case), (s and s[:60], z)


def test_without_zone_column_times_are_utc(spark):
    df = spark.createDataFrame([("2020-03-08 02:30:00",), ("04/08/2022 07:24:57 PM",)], "s string")
    assert sorted(r.utc_us for r in to_utc(df, "s").collect()) == [us(2020, 3, 8, 2, 30), us(2022, 4, 8, 19, 24, 57)]


@pytest.mark.parametrize("drop", [False, True])
def test_empty_table_and_finished_stamps(spark, drop):
    assert to_utc(spark.createDataFrame([], "s string, z string"), "s", "z", drop_finished=drop).count() == 0
    one = spark.createDataFrame([("2020-01-01T00:00:00.000000Z",), ("2020-01-01T00:00:00.000000Z",)], "s string")
    assert to_utc(one, "s", drop_finished=drop).count() == (0 if drop else 2)


def test_any_year_has_its_offset(spark):
    """Local times before and after the table of intervals, against the zone database itself."""
    from datetime import datetime, timezone
    from zoneinfo import ZoneInfo

    zone = ZoneInfo("America/New_York")
    stamps = [f"{y:04d}-{m:02d}-15 12:30:00" for y in (1200, 1799, 1800, 1883, 1884, 1918, 1945, 1969, 1970, 2037, 2099, 2100, 2101, 2150, 2399, 2400, 3001, 9998) for m in (1, 3, 7, 11, 12)]
    rows = spark.createDataFrame([(s, "America/New_York") for s in stamps], "s string, tz string")
    got = {r.s: (r.utc_us, r.utc_case) for r in to_utc(rows, "s", "tz").collect()}
    for s in stamps:
        local = datetime.fromisoformat(s)
        year = local.year
        offset = local.replace(tzinfo=zone).utcoffset() if year < 9999 else None
        want = (local.replace(tzinfo=timezone.utc) - offset - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()
        assert got[s] == (int(want) * 1_000_000, "local"), s


def test_hours_that_occur_twice_or_never_in_later_years(spark):
    """In 2150 the clocks change as they do in the year with the same calendar."""
    from datetime import date, timedelta

    sunday = lambda d: d + timedelta((6 - d.weekday()) % 7)
    spring, autumn = sunday(date(2150, 3, 1)) + timedelta(7), sunday(date(2150, 11, 1))
    rows = spark.createDataFrame([(f"{spring} 02:30:00", "America/New_York"), (f"{autumn} 01:30:00", "America/New_York")], "s string, tz string")
    assert [r.utc_case for r in to_utc(rows, "s", "tz").orderBy("s").collect()] == ["skipped", "ambiguous"]


def test_numbers_and_zone_letters(spark):
    rows = spark.createDataFrame([(s,) for s in ("86400000", "7", "-5.5", "20200601", "0", "2020-06-01 12:00:00 CET", "2020-06-01 12:00:00 JST", "2020-06-01 12:00:00 CST", "2020-06-01 12:00:00 IST")], "s string")
    got = {r.s: r.utc_us for r in to_utc(rows, "s").collect()}
    noon = 1_591_012_800_000_000
    hour = 3_600_000_000
    assert got == {"86400000": 86_400_000_000_000, "7": 7_000_000, "-5.5": -5_500_000, "20200601": noon - 12 * hour, "0": None, "2020-06-01 12:00:00 CET": noon - hour, "2020-06-01 12:00:00 JST": noon - 9 * hour, "2020-06-01 12:00:00 CST": noon + 6 * hour, "2020-06-01 12:00:00 IST": None}
