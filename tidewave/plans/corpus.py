"""Queries of the general data-preparation problems (2, 3, 4) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators import places, skew, timestamps
from tidewave.plans.tables import Query, table
from tidewave.storage import materialize


# -- problem 3 ---------------------------------------------------------------------------------------------------------

def snippet_totals(spark: SparkSession, d: str) -> DataFrame:
    snippets = table(spark, d, "radio_snippet")
    return skew.totals_by_key(
        snippets, "snippet_id", ["station_id", "show_id"], "diary_speaker_id",
        {"airtime_us": F.round(F.col("duration") * 1_000_000), "n_words": F.col("wordcount")},
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(snippet_totals(spark, d), "station_id", 0.04).select("key_name", "key_value")


def p3_key_totals(spark: SparkSession, d: str) -> DataFrame:
    t = snippet_totals(spark, d)
    return t.select("key_name", "key_value", F.col("n_rows").alias("n_snippets"), F.col("n_distinct").alias("n_speakers"), "airtime_us", "n_words")


P3_TOTALS_SQL = """
with once as (
  select snippet_id, any_value(station_id) as station_id, any_value(show_id) as show_id, any_value(diary_speaker_id) as speaker,
         any_value(cast(round(duration * 1000000) as bigint)) as us, any_value(wordcount) as words
  from radio_snippet group by snippet_id),
keyed as (select 'station_id' as key_name, station_id as key_value, * from once union all select 'show_id', show_id, * from once)
select key_name, key_value, count(*) as n_snippets, count(distinct speaker) as n_speakers,
       cast(coalesce(sum(us), 0) as bigint) as airtime_us, cast(coalesce(sum(words), 0) as bigint) as n_words
from keyed group by key_name, key_value"""

P3_FOUND_SQL = f"""
with totals as ({P3_TOTALS_SQL}),
everything as (select count(distinct snippet_id) as n from radio_snippet)
select key_name, key_value from totals, everything where key_value is not null and n_snippets > 0.04 * n"""


# -- problem 4 ---------------------------------------------------------------------------------------------------------

def _station_zones(spark: SparkSession, d: str) -> DataFrame:
    zones = table(spark, d, "station_timezone").groupBy(F.upper(F.trim("callsign")).alias("call")).agg(F.min("tz_name").alias("tz"))
    stations = table(spark, d, "radio_station").groupBy("station_id").agg(F.min(F.upper(F.trim("callsign"))).alias("call"))
    return stations.join(zones, "call").select("station_id", "tz")


def utc_times(spark: SparkSession, d: str, drop_finished: bool = False) -> DataFrame:
    """Every distinct stamp of the three tables with its instant: src_table, record_key, utc_us, utc_case."""
    zones = _station_zones(spark, d)
    radio = table(spark, d, "radio_snippet").select("station_id", F.col("snippet_id").cast("string").alias("record_key"), F.col("start_dt").alias("stamp"))
    radio = radio.join(zones, "station_id", "left")
    posts = table(spark, d, "twitter_tweet").select(F.col("tweet_id").cast("string").alias("record_key"), F.col("tweet_create_dt").alias("stamp"))
    sample = table(spark, d, "auto_sample").select(F.col("id").alias("record_key"), F.col("sample_timestamp").alias("stamp"))
    done = [
        timestamps.to_utc(radio, "stamp", "tz", zones, drop_finished=drop_finished).withColumn("src_table", F.lit("radio_snippet")),
        timestamps.to_utc(posts, "stamp", drop_finished=drop_finished).withColumn("src_table", F.lit("twitter_tweet")),
        timestamps.to_utc(sample, "stamp", drop_finished=drop_finished).withColumn("src_table", F.lit("auto_sample")),
    ]
    out = [x.select("src_table", "record_key", "utc_us", "utc_case") for x in done]
    return out[0].unionByName(out[1]).unionByName(out[2])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return utc_times(spark, d, drop_finished=True).where(F.col("utc_us").isNotNull()).select("src_table", "record_key", "utc_us").distinct()


def p4_cases(spark: SparkSession, d: str) -> DataFrame:
    """How many stamps of each table were read in which way."""
    return utc_times(spark, d).groupBy("src_table", "utc_case").agg(F.count("*").alias("n"))


# -- problem 2 ---------------------------------------------------------------------------------------------------------

def _located(spark: SparkSession, d: str) -> DataFrame:
    maps = table(spark, d, "stg_station_map").groupBy("station_map_id").agg(F.min("station_id").alias("station_id"))
    coordinates = table(spark, d, "stg_station_map_coordinate").select(F.col("station_map_coordinate_id").alias("point_id"), "station_map_id", "latitude", "longitude").dropDuplicates(["point_id"])
    return coordinates.join(maps, "station_map_id").where(F.col("station_id").isNotNull()).select("point_id", F.col("station_id").alias("owner"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def _areas(spark: SparkSession, d: str, strength: str = "strong") -> DataFrame:
    areas = table(spark, d, "radio_station_map").where(F.col("strength") == strength)
    return areas.select(F.col("station_map_id").alias("region_id"), F.col("station_id").alias("owner"), "wkt").dropDuplicates(["region_id"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    points = materialize(places.clean_points(_located(spark, d)), "points")
    near = places.near_pairs(points, 1.0, other_owner=True).select(F.lit("near").alias("relation"), F.col("point_id").alias("coordinate_id"), F.col("other_id").alias("target_id"))
    within = places.points_in_regions(points, _areas(spark, d), other_owner=True)
    return near.unionByName(within.select(F.lit("within").alias("relation"), F.col("point_id").alias("coordinate_id"), F.col("region_id").alias("target_id")))


# Rings of any spelling, their edges, and the even-odd count of edges right of a point; points lie on no border by more than chance.
P2_SQL = r"""
with maps as (select station_map_id, min(station_id) as station_id from stg_station_map group by 1),
points as (
  select station_map_coordinate_id as id, station_id as owner, latitude as lat, case when longitude > 180 then longitude - 360 when longitude < -180 then longitude + 360 else longitude end as lon
  from (select distinct station_map_coordinate_id, station_map_id, latitude, longitude from stg_station_map_coordinate) join maps using (station_map_id)
  where station_id is not null and latitude is not null and longitude is not null and not (latitude = 0 and longitude = 0) and abs(latitude) <= 90 and abs(longitude) <= 360),
near as (
  select a.id as coordinate_id, b.id as target_id from points a join points b on a.id < b.id and a.owner <> b.owner and abs(a.lat - b.lat) <= 0.01
  where 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 1.0),
areas as (select distinct station_map_id as region, station_id as owner, wkt from radio_station_map where strength = 'strong' and regexp_matches(upper(wkt), '^ *(SRID *= *[0-9]+ *;)? *(MULTI)?POLYGON')),
rings as (select region, owner, unnest(regexp_extract_all(wkt, '\(([^()]+)\)', 1)) as ring from areas),
corners as (
  select region, owner, ring, list_transform(string_split(ring, ','), lambda p: regexp_extract_all(p, '[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?')) as c from rings),
edges as (
  select region, owner, unnest(list_transform(range(1, len(c) + 1), lambda i: [cast(c[i][1] as double), cast(c[i][2] as double), cast(c[i % len(c) + 1][1] as double), cast(c[i % len(c) + 1][2] as double)])) as e from corners where len(c) >= 3),
inside as (
  select p.id as coordinate_id, region as target_id from points p join edges x on x.owner <> p.owner and (e[2] > p.lat) <> (e[4] > p.lat)
  cross join (select unnest([0.0, 360.0, -360.0]) as turn) where p.lon + turn < (e[3] - e[1]) * (p.lat - e[2]) / (e[4] - e[2]) + e[1]
  group by p.id, region, turn having count(*) % 2 = 1)
select 'near' as relation, coordinate_id, target_id from near union all select distinct 'within', coordinate_id, target_id from inside"""

# Each shape read by its own format; a local time that occurs twice is the first, one the clocks skipped is none.
_P4 = r"""
with zones as (select station_id, min(tz_name) as tz from radio_station s join (select upper(trim(callsign)) as call, min(tz_name) as tz_name from station_timezone group by 1) z on z.call = upper(trim(s.callsign)) group by 1),
stamps as (
  select 'radio_snippet' as src_table, cast(snippet_id as varchar) as record_key, trim(start_dt) as s, tz as local from radio_snippet left join zones using (station_id)
  union all select 'twitter_tweet', cast(tweet_id as varchar), trim(tweet_create_dt), 'UTC' from twitter_tweet
  union all select 'auto_sample', id, trim(sample_timestamp), 'UTC' from auto_sample),
kinds as (
  select *, case when regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z') then 'done' when regexp_full_match(s, '[0-9]{10}(\.[0-9]+)?') then 'seconds' when regexp_full_match(s, '[0-9]{13}') then 'millis'
    when regexp_full_match(s, '[0-9]{8}T[0-9]{6}Z') then 'compact' when regexp_full_match(s, '[A-Z][a-z]{2} [A-Z][a-z]{2} [0-9 ]?[0-9] .*[+-][0-9]{4} [0-9]{4}') then 'post' when regexp_full_match(s, '[A-Z][a-z]{2}, .* [+-][0-9]{4}') then 'mail'
    when regexp_full_match(s, '[0-9]{2}/[0-9]{2}/[0-9]{4} .* [AP]M') then 'slashed' when regexp_full_match(s, '[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4} .* [AP]M') then 'worded' when regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}.*') then 'iso' end as kind
  from stamps),
walls as (
  select *, case kind when 'compact' then try_strptime(s, '%Y%m%dT%H%M%SZ') when 'post' then try_strptime(regexp_replace(substring(s, 5), ' [+-][0-9]{4} ', ' '), '%b %d %H:%M:%S %Y') when 'mail' then try_strptime(regexp_replace(substring(s, 6), ' [+-][0-9]{4}$', ''), '%d %b %Y %H:%M:%S')
      when 'slashed' then try_strptime(s, '%m/%d/%Y %I:%M:%S %p') when 'worded' then try_strptime(s, '%B %d, %Y %I:%M %p') when 'iso' then try_strptime(replace(substring(s, 1, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S') end as wall,
    case when kind = 'iso' then cast(rpad(substring(regexp_extract(s, '^.{19}\.([0-9]+)', 1), 1, 6), 6, '0') as bigint) else 0 end as micros,
    case when kind in ('compact') then 'Z' when kind in ('post', 'mail') then regexp_extract(s, '[+-][0-9]{4}') when kind = 'iso' then regexp_extract(regexp_replace(substring(s, 20), '^\.[0-9]+', ''), '^ ?([A-Z]+|[+-][0-9]{2}:?[0-9]{0,2})', 1) else '' end as zone
  from kinds),
offsets as (
  select *, case zone when 'Z' then 0 when 'UTC' then 0 when 'GMT' then 0 when 'EST' then -300 when 'EDT' then -240 when 'CST' then -360 when 'CDT' then -300 when 'MST' then -420 when 'MDT' then -360 when 'PST' then -480 when 'PDT' then -420
      when 'AKST' then -540 when 'AKDT' then -480 when 'HST' then -600 else case when regexp_full_match(zone, '[+-][0-9]{2}:?([0-9]{2})?') then (case when zone[1] = '-' then -1 else 1 end) * (cast(substring(zone, 2, 2) as int) * 60 + coalesce(try_cast(right(replace(zone, ':', ''), 2) as int), 0) * cast(length(zone) > 3 as int)) end end as minutes,
    wall at time zone local as later
  from walls),
firsts as (select *, case when (later - interval 1 hour) at time zone local = wall then later - interval 1 hour when later at time zone local = wall then later end as instant from offsets)
"""
P4_FOUND_SQL = _P4 + r"""
select distinct src_table, record_key, case kind when 'seconds' then cast(substring(s, 1, 10) as bigint) * 1000000 + cast(rpad(substring(regexp_extract(s, '\.([0-9]+)', 1), 1, 6), 6, '0') as bigint) when 'millis' then cast(s as bigint) * 1000
    else case when zone <> '' then epoch_us(wall) - cast(minutes as bigint) * 60000000 else epoch_us(instant) end + micros end as utc_us
from firsts where kind in ('seconds', 'millis') or (kind <> 'done' and wall is not null and (minutes is not null or (zone = '' and instant is not null)))"""

P4_CASES_SQL = _P4 + r"""
select src_table, utc_case, count(*) as n from (
  select src_table, case when kind in ('done', 'seconds', 'millis') then 'zoned' when kind is null or wall is null or (zone <> '' and minutes is null) then 'unreadable' when zone <> '' or src_table <> 'radio_snippet' then 'zoned'
    when local is null then 'unknown zone' when instant is null then 'skipped' when (later - interval 1 hour) at time zone local = wall and later at time zone local = wall then 'ambiguous' else 'local' end as utc_case from firsts)
group by 1, 2"""


QUERIES: dict[str, Query] = {"p2_found": p2_found, "p3_found": p3_found, "p3_key_totals": p3_key_totals, "p4_found": p4_found, "p4_cases": p4_cases}
SQL = {"p2_found": P2_SQL, "p4_found": P4_FOUND_SQL, "p4_cases": P4_CASES_SQL, "p3_found": P3_FOUND_SQL, "p3_key_totals": P3_TOTALS_SQL}
