"""Timestamps of mixed formats and zones to one UTC instant."""

from __future__ import annotations

from collections.abc import Iterator

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

US = 1_000_000
DAY_US = 86_400 * US

# Hours east of UTC of zone abbreviations that are read in this sense, whatever else they may stand for.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6,
    "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10, "HDT": -9,
}
# The years of the interval table. Before them every zone of the public database has its first offset; after them zones keep their rules,
# so a later year has the intervals of the year from EVERY_CALENDAR on that begins on the same weekday and has as many days.
YEARS = (1800, 2099)
EVERY_CALENDAR = 2072
# English month names.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

# Each shape: a pattern, and which of its groups hold year, month, day, hour, minute, second, fraction, half of day, zone, named zone.
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"(?:\s*(Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{3,5}))?"
SHAPES = {
    "iso": (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[T ]{_TIME}{_ZONE}(?:\[([^\]]+)\])?)?$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    "compact": (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?(Z|[+-]\d{2}(?::?\d{2})?)?$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 0)),
    "day": (r"^((?:1[89]|2[01])\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$", (1, 2, 3, 0, 0, 0, 0, 0, 0, 0)),
    "mail": (rf"^(?:[A-Z][a-z]{{2}}, )?(\d{{1,2}}) ([A-Z][a-z]{{2}}) (\d{{4}}) {_TIME}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 0, 8, 0)),
    "post": (rf"^[A-Z][a-z]{{2}} ([A-Z][a-z]{{2}}) +(\d{{1,2}}) {_TIME}{_ZONE} (\d{{4}})$", (8, 1, 2, 3, 4, 5, 6, 0, 7, 0)),
    "slashed": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? {_TIME}(?: ?([AaPp])\.?[Mm]\.?)?{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8, 9, 0)),
    "worded": (rf"^([A-Z][a-z]{{2,8}})\.? (\d{{1,2}}), (\d{{4}})(?:,? {_TIME}(?: ?([AaPp])\.?[Mm]\.?)?{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8, 9, 0)),
}
PARTS = ["year", "month", "day", "hour", "minute", "second", "fraction", "half", "zone", "region"]
EPOCH = r"^-?(?!0+(?:\.0*)?$)\d{1,20}(?:\.\d+)?$"
FINISHED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"


@lru_cache(maxsize=1)
def abbreviations() -> dict[str, int]:
    """Minutes east of UTC of every zone abbreviation that is read: ABBREVIATIONS, and those that in this century stand for one offset in all zones
    of the public time zone database that use them (CET, JST, ...); one with several (IST, BST) is not read."""
    from datetime import datetime, timedelta
    from zoneinfo import ZoneInfo, available_timezones

    offsets: dict[str, set[timedelta]] = {}
    for name in sorted(available_timezones()):
        zone = ZoneInfo(name)
        for year in range(2001, 2026):
            for month in (1, 7):
                at = datetime(year, month, 1, tzinfo=zone)
                offsets.setdefault(at.tzname() or "", set()).add(at.utcoffset())
    of_database = {a: next(iter(o)) for a, o in offsets.items() if len(o) == 1 and a.isalpha() and a.isupper() and 3 <= len(a) <= 5}
    return {a: o // timedelta(minutes=1) for a, o in of_database.items()} | {a: h * 60 for a, h in ABBREVIATIONS.items()}


def fields_of(stamp: Column) -> Column:
    """The parts named in PARTS as an array of texts ('' where missing); for an epoch number, its digits before and after the
    point; null for any other text."""
    text = F.trim(stamp)
    fields = F.lit(None).cast("array<string>")
    for pattern, groups in reversed(SHAPES.values()):
        joined = F.regexp_replace(text, pattern, "\u0001".join(f"${g}" if g else "" for g in groups))
        fields = F.when(text.rlike(pattern), F.split(joined, "\u0001")).otherwise(fields)
    return F.when(text.rlike(EPOCH) & ~text.rlike(SHAPES["day"][0]), F.split(text, r"\.")).otherwise(fields)


def _wall_clock(rows: DataFrame) -> DataFrame:
    """From __fields: __local (microseconds of the wall clock), __offset (minutes east of UTC, null without a readable zone) and __zone.

    Each step is a column of its own, used by name, so that the planner evaluates it once a row."""
    text = lambda name: F.get("__fields", F.lit(PARTS.index(name)))
    number = lambda name: F.coalesce(F.get("__numbers", F.lit(PARTS.index(name))), F.lit(0))
    months = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m[:3]), F.lit(i + 1))])
    named = F.create_map(*[x for k, v in abbreviations().items() for x in (F.lit(k), F.lit(v))])
    # A failing try_cast costs microseconds (an exception each), so only digits are cast.
    rows = rows.withColumn("__numbers", F.transform("__fields", lambda x: F.when(x.rlike(r"^\d{1,9}$"), x.cast("int"))))
    rows = rows.withColumn("__month", F.coalesce(F.get("__numbers", F.lit(1)), F.try_element_at(months, F.substring(text("month"), 1, 3))))
    rows = rows.withColumn("__day", F.unix_date(F.format_string("%04d-%02d-%02d", number("year"), F.col("__month"), number("day")).try_cast("date")))
    rows = rows.withColumn("__zone", text("zone")).withColumn("__half", F.lower(text("half")))
    rows = rows.withColumn("__hour", F.when(F.col("__half") == "", number("hour")).when(number("hour").between(1, 12), number("hour") % 12 + F.when(F.col("__half") == "p", 12).otherwise(0)))
    valid = F.col("__hour").between(0, 23) & number("minute").between(0, 59) & number("second").between(0, 60) & F.col("__month").isNotNull()
    micros = F.rpad(F.substring(text("fraction"), 1, 6), 6, "0").try_cast("bigint")
    rows = rows.withColumn("__clock", F.when(valid, F.col("__day").cast("bigint") * DAY_US + (F.col("__hour") * 3600 + number("minute") * 60 + number("second")).cast("bigint") * US + micros))
    plain = F.regexp_replace("__zone", "[+:-]", "")
    hours = F.substring(plain, 1, 2).try_cast("int") * 60 + F.when(F.length(plain) > 2, F.substring(plain, 3, 2).try_cast("int")).otherwise(0)
    return rows.withColumn("__minutes", F.when(F.col("__zone").rlike("^[+-]"), F.when(F.col("__zone").startswith("-"), -hours).otherwise(hours)).when(F.col("__zone") != "", F.try_element_at(named, F.col("__zone"))))


def _epoch_us(fields: Column) -> Column:
    """Microseconds of an epoch number, given its digits before and after the point."""
    whole, after = F.get(fields, F.lit(0)), F.rpad(F.substring(F.coalesce(F.get(fields, F.lit(1)), F.lit("")), 1, 6), 6, "0").try_cast("bigint")
    negative = whole.startswith("-")
    digits = F.length(whole) - negative.cast("int")
    after = F.when(negative, -after).otherwise(after)
    n = whole.try_cast("bigint")
    # Overlong numbers are null in bigint and name no instant.
    return F.when(digits <= 11, n * US + after).when(digits <= 14, n * 1000 + F.floor(after / 1000)).when(digits <= 17, n).otherwise(F.floor(n.cast("decimal(20,0)") / 1000).cast("bigint"))


def _periods(years: tuple[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from datetime import datetime, timedelta, timezone
        from zoneinfo import ZoneInfo

        epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
        step = timedelta(days=7)
        for batch in batches:
            rows = []
            for name in batch["tz"]:
                try:
                    zone = ZoneInfo(name)
                except Exception:  # not a zone of the time zone database: its local times name no instant
                    continue
                offset = lambda t: t.astimezone(zone).utcoffset()  # noqa: E731, B023
                start, last = datetime(years[0], 1, 1, tzinfo=timezone.utc) - step, datetime(years[1], 12, 31, tzinfo=timezone.utc) + step
                at, now = start, offset(start)
                while at < last:
                    after = at + step
                    then = offset(after)
                    if then != now:
                        low, high = at, after
                        while high - low > timedelta(seconds=1):
                            middle = low + (high - low) // 2
                            middle -= timedelta(microseconds=middle.microsecond)
                            low, high = (middle, high) if offset(middle) == now else (low, middle)
                        rows.append((name, start, high, now))
                        start, now = high, then
                    at = after
                rows.append((name, start, last, now))
            us = lambda t: (t - epoch) // timedelta(microseconds=1)
            yield pd.DataFrame([(n, us(a + o), us(b + o), o // timedelta(microseconds=1)) for n, a, b, o in rows], columns=["tz", "local_from", "local_until", "offset"])

    return run


def offset_intervals(zones: DataFrame, years: tuple[int, int] = YEARS) -> DataFrame:
    """For each zone (column tz) and year of `years`: the intervals of local time with one offset that touch the year.

    A wall-clock time in two intervals occurs twice, one in none was skipped. At most one row for each zone of the public
    time zone database (about 600) and year, whatever the number of records."""
    rows = zones.select("tz").where(F.col("tz").isNotNull()).distinct().mapInPandas(_periods(years), "tz string, local_from bigint, local_until bigint, offset bigint")
    year = lambda us: F.year(F.date_from_unix_date(F.floor(us / DAY_US).cast("int")))
    exploded = rows.withColumn("local_year", F.explode(F.sequence(year(F.col("local_from")), year(F.col("local_until") - 1))))
    return exploded.groupBy("tz", "local_year").agg(F.collect_list(F.struct("local_from", "local_until", "offset")).alias("intervals"))


def _calendar_year(year: Column) -> Column:
    """The year of YEARS with the intervals of any year: itself, the first one for earlier years, one with the same calendar for later ones."""
    from datetime import date

    leap = lambda y: y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    same = {date(y, 1, 1).weekday() * 2 + leap(y): y for y in range(EVERY_CALENDAR, YEARS[1] + 1)}
    is_leap = (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))
    kind = F.weekday(F.make_date(year, F.lit(1), F.lit(1))) * 2 + is_leap.cast("int")
    later = F.try_element_at(F.create_map(*[F.lit(x) for kv in same.items() for x in kv]), kind)
    return F.when(year > YEARS[1], later).otherwise(F.greatest(year, F.lit(YEARS[0])))


def to_utc(df: DataFrame, stamp: str, zone: str | None = None, zones: DataFrame | None = None, drop_finished: bool = False) -> DataFrame:
    """Add utc_us (microseconds since 1970-01-01 UTC) and utc_case to every row of `df`.

    Digits beyond microseconds are dropped and missing smaller units are zero; slashed dates are month first. A number of eight digits that
    is a day of 1800 to 2199 is that day; other numbers count from 1970: up to 11 digits are seconds, 14 milliseconds, 17 microseconds, else nanoseconds (zeros alone are a placeholder). `stamp` is the text column; `zone`, if given, a column with the IANA zone in which a stamp without zone is local time
    (else such stamps are UTC); `zones` may list the zones that occur in it (column tz), to save reading them off `df`. Local times of any year are joined as-of to zone-offset intervals exploded by year: one interval gives
    the offset, two mean that the time occurred twice (the first is taken), none that the clocks skipped it. utc_case is
    'zoned', 'local', 'ambiguous', 'skipped', 'unknown zone' or 'unreadable'; utc_us is null in the last three.
    Rows are neither dropped nor repeated, unless `drop_finished` leaves out stamps already written YYYY-MM-DDTHH:MM:SS.ffffffZ.
    Null and empty stamps, placeholders, impossible dates or times and unknown zone letters are unreadable. Working columns are named with two underscores, other columns of `df` stay.
    """
    rows = df.where(~F.coalesce(F.col(stamp).rlike(FINISHED), F.lit(False))) if drop_finished else df
    rows = _wall_clock(rows.withColumn("__fields", fields_of(F.col(stamp))))
    is_epoch = F.size("__fields") <= 2
    rows = rows.withColumn("__zoned", is_epoch | (F.col("__zone") != ""))
    rows = rows.withColumn("__at", F.when(is_epoch, _epoch_us(F.col("__fields"))).when(F.col("__zone") != "", F.col("__clock") - F.col("__minutes").cast("bigint") * 60 * US).otherwise(F.col("__clock")))
    named = F.nullif(F.get("__fields", F.lit(PARTS.index("region"))), F.lit(""))
    rows = rows.withColumn("__tz", F.when(~F.col("__zoned"), F.coalesce(named, F.col(zone)) if zone else named))
    rows = rows.withColumn("__plain", F.col("__zoned") | (F.col("__tz").isNull() if zone is None else F.lit(False)))
    rows = rows.withColumn("__own_year", F.when(F.col("__tz").isNotNull(), F.year(F.date_from_unix_date("__day"))))
    rows = rows.withColumn("__year", _calendar_year(F.col("__own_year")))
    # A time of a later year is looked up at its place in the year with the same calendar; one before the table, at the table's start.
    days = lambda y: F.unix_date(F.make_date(y, F.lit(1), F.lit(1))).cast("bigint")
    shift = F.when(F.col("__own_year") > YEARS[1], (days(F.col("__own_year")) - days(F.col("__year"))) * DAY_US).otherwise(F.lit(0))
    rows = rows.withColumn("__seek", F.when(F.col("__own_year") < YEARS[0], days(F.lit(YEARS[0])) * DAY_US).otherwise(F.col("__at") - shift))
    # Zones written into the text itself, without an offset, are rare: only such texts are parsed for them.
    bare = df.select(F.trim(F.col(stamp)).alias("s")).where(F.col("s").endswith("]") & ~F.col("s").rlike(r"(Z|[A-Z]|[+-]\d{2}(:?\d{2})?)\["))
    found = bare.select(F.regexp_extract("s", r"\[([^\]]+)\]$", 1).alias("tz")).distinct()
    if zone:
        found = found.unionByName(zones.select("tz") if zones is not None else df.select(F.col(zone).alias("tz")))
    spans = offset_intervals(found).select(F.col("tz").alias("__tz"), F.col("local_year").alias("__year"), F.col("intervals").alias("__intervals"))
    # Zones times years bound this side, whatever the rows: see offset_intervals.
    joined = rows.join(F.broadcast(spans), ["__tz", "__year"], "left")
    at, seek = F.col("__at"), F.col("__seek")
    hits = F.filter(F.col("__intervals"), lambda i: (i.local_from <= seek) & (seek < i.local_until))
    joined = joined.withColumn("__hits", F.when(F.col("__intervals").isNotNull(), hits))
    case = (
        F.when(at.isNull(), "unreadable").when(F.col("__plain"), "zoned").when(F.col("__intervals").isNull(), "unknown zone")
        .when(F.size("__hits") == 0, "skipped").when(F.size("__hits") == 1, "local").otherwise("ambiguous")
    )
    # The first of two occurrences is the one with the greater offset.
    by_interval = at - F.array_max(F.transform(F.col("__hits"), lambda i: i.offset))
    utc = F.when(F.col("__plain"), at).when(F.size("__hits") > 0, by_interval)
    return joined.withColumn("utc_us", utc).withColumn("utc_case", case).drop(*[c for c in joined.columns if c.startswith("__")])
