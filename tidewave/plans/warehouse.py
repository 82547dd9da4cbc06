"""Warehouse queries over the project's tables, each with the SQL that checks it.

Show and state attributes that the tables lack are derived by rule: a show's name is its greatest raw name, every 23rd show is
excluded, states fall into five regions by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators import warehouse as wh
from tidewave.operators import windows as win
from tidewave.plans.tables import Query, table

REGIONS = ["northeast", "midwest", "south", "west", "pacific"]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- the base tables ---------------------------------------------------------------------------------------------------

def snippets(spark: SparkSession, d: str) -> DataFrame:
    cols = ["snippet_id", "station_id", "show_id", "content", "approxhash", "audio_key", "raw_show_name", "show_confidence", "mean_word_confidence", "diary_speaker_id", "diary_gender", "duration", "wordcount", "insert_dt"]
    return table(spark, d, "radio_snippet").select(*cols).dropDuplicates(["snippet_id"]).withColumn("date", F.to_date("insert_dt"))


def stations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "radio_station")


def shows(sn: DataFrame) -> DataFrame:
    return sn.where(F.col("show_id").isNotNull()).groupBy("show_id").agg(F.max("raw_show_name").alias("name")).withColumn("exclude", F.col("show_id") % 23 == 0)


def states(spark: SparkSession, d: str) -> DataFrame:
    ids = stations(spark, d).select("state_id").where(F.col("state_id").isNotNull()).distinct()
    region = F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (F.col("state_id") % 5 + 1).cast("int"))
    return ids.select("state_id", F.concat(F.lit("S"), F.col("state_id")).alias("postal_code"), region.alias("census_region"))


def data(spark: SparkSession, d: str) -> DataFrame:
    sn = snippets(spark, d)
    return wh.snippet_data(sn, stations(spark, d), states(spark, d), shows(sn), wh.syndication(sn, "insert_dt"))


def posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "twitter_tweet").dropDuplicates(["tweet_id"])


BASE = """with snippet as (
  select distinct snippet_id, station_id, show_id, content, approxhash, audio_key, raw_show_name, show_confidence, mean_word_confidence,
         diary_speaker_id, diary_gender, duration, wordcount, insert_dt, cast(insert_dt as date) as date from radio_snippet),
show_dim as (select show_id, max(raw_show_name) as name, show_id % 23 = 0 as exclude from snippet where show_id is not null group by show_id),
state as (select distinct state_id, 'S' || state_id as postal_code,
          list_extract(['northeast', 'midwest', 'south', 'west', 'pacific'], state_id % 5 + 1) as census_region from radio_station where state_id is not null),
ms_show as (select show_id from snippet where show_id is not null group by show_id having count(distinct station_id) > 1),
ms_hash as (select distinct approxhash from (select approxhash from snippet where approxhash is not null
            group by extract(year from insert_dt), extract(week from insert_dt), approxhash having count(distinct station_id) > 1)),
snippet_data as (
  select sn.*, st.station_format, st.band as station_band, st.std_owner as station_std_owner, st.station_format = 'Public Radio' as is_public,
         ds.postal_code, ds.census_region, sh.name as show_name,
         case when sn.show_id is not null then ms_show.show_id is not null end as syndicated_show, ms_hash.approxhash is not null as syndicated_approxhash
  from snippet sn join radio_station st using (station_id) join state ds using (state_id) left join show_dim sh on sh.show_id = sn.show_id
       left join ms_show on ms_show.show_id = sn.show_id left join ms_hash on ms_hash.approxhash = sn.approxhash
  where not st.is_excluded and not coalesce(sh.exclude, false) and sn.content <> ''),
episode as (select date, show_id, station_id, count(*) as cnt, sum(duration) as duration, avg(show_confidence) as show_confidence, avg(mean_word_confidence) as word_confidence
  from snippet_data where show_id is not null group by date, show_id, station_id),
tweet as (select distinct * from twitter_tweet)
"""


# -- dimensions and facts ----------------------------------------------------------------------------------------------

@query("""select cast(d as date) as date, cast(extract(year from d) as int) as year, cast(extract(month from d) as int) as month, cast(extract(day from d) as int) as day, cast(extract(week from d) as int) as week
from unnest(generate_series(timestamp '1990-01-01', timestamp '2030-12-31', interval 1 day)) t(d)""")
def d1_dates(spark: SparkSession, d: str) -> DataFrame:
    return wh.dates(spark, "1990-01-01", "2030-12-31")


@query("select range as n from range(1000)")
def d1_integers(spark: SparkSession, d: str) -> DataFrame:
    return wh.integers(spark, 1000)


@query("""select station_id, callsign, upper(trim(coalesce(std_owner, raw_owner))) as owner, case when ingested then is_excluded end as exclude, 'S' || state_id as postal_code from radio_station""")
def d3_stations(spark: SparkSession, d: str) -> DataFrame:
    st = stations(spark, d)
    staged = st.select("station_id", "callsign", F.concat(F.lit("S"), F.col("state_id")).alias("state"))
    owners = st.select("station_id", F.upper(F.trim(F.coalesce("std_owner", "raw_owner"))).alias("owner"), F.col("is_excluded").alias("exclude"))
    out = wh.stations(staged, states(spark, d), st.where("ingested"), owners)
    return out.join(states(spark, d).select("state_id", "postal_code"), "state_id", "left").select("station_id", "callsign", "owner", "exclude", "postal_code")


@query(r"""with line as (select line_id, json_extract_string(line_json, '$.callsign') as callsign, json_extract_string(line_json, '$.show_name') as show_name,
  json_extract_string(line_json, '$.content') as content, cast(json_extract(line_json, '$.segment_start_relative') as double) + 1600000000 as s from snippet_line),
st as (select station_id, callsign from radio_station), sh as (select show_id, max(raw_show_name) as name from radio_snippet where show_id is not null group by show_id)
select line_id, st.station_id, sh.show_id, coalesce(len(regexp_split_to_array(content, '\s+')), 0) as wordcount, cast(to_timestamp(s) at time zone 'UTC' as date) as date
from line left join st on st.callsign = line.callsign left join sh on trim(lower(sh.name)) = trim(lower(line.show_name))""")
def d4_snippets(spark: SparkSession, d: str) -> DataFrame:
    fields = "callsign string, show_name string, content string, segment_start_relative double"
    line = table(spark, d, "snippet_line").select("line_id", F.from_json("line_json", fields).alias("j")).select("line_id", "j.*")
    start = F.col("segment_start_relative") + 1600000000
    line = line.withColumn("segment_start_global", start).withColumn("segment_end_global", start + 10)
    show_names = shows(snippets(spark, d)).select("show_id", "name", F.lit(None).cast("bigint").alias("parent_show_id"))
    out = wh.transformed_snippets(line, stations(spark, d).select(F.col("callsign").alias("corpus_callsign"), "station_id"), show_names)
    return out.select("line_id", "station_id", "show_id", F.col("wordcount").cast("bigint").alias("wordcount"), "date")


@query(BASE + "select snippet_id, 'show' as syndication_method, ms_show.show_id is not null as syndicated from snippet left join ms_show using (show_id) where show_id is not null union all select snippet_id, 'approxhash', ms_hash.approxhash is not null from snippet left join ms_hash using (approxhash)")
def d5_syndication(spark: SparkSession, d: str) -> DataFrame:
    return wh.syndication(snippets(spark, d), "insert_dt")


@query(BASE + "select snippet_id, date, show_id, station_id, show_name, station_format, station_band, is_public, postal_code, census_region, syndicated_show, syndicated_approxhash from snippet_data")
def d6_snippet_data(spark: SparkSession, d: str) -> DataFrame:
    return data(spark, d).select("snippet_id", "date", "show_id", "station_id", "show_name", "station_format", "station_band", "is_public", "postal_code", "census_region", "syndicated_show", "syndicated_approxhash")


EPISODE_COLS = "date, show_id, station_id, cnt, round(duration, 4) as duration, round(show_confidence, 9) as show_confidence, round(word_confidence, 9) as word_confidence"


def _rounded(e: DataFrame) -> DataFrame:
    return e.select("date", "show_id", "station_id", "cnt", F.round("duration", 4).alias("duration"), F.round("show_confidence", 9).alias("show_confidence"), F.round("word_confidence", 9).alias("word_confidence"))


def _best_sql(where: str) -> str:
    return BASE + f"select {EPISODE_COLS} from (select *, row_number() over (partition by date, show_id order by round(show_confidence, 9) desc nulls first, cnt desc nulls first, round(word_confidence, 9) desc nulls first, station_id) as q from episode where {where}) where q = 1"


def _steady(e: DataFrame) -> DataFrame:
    """Means rounded before they are ranked, so that two engines' last bits cannot change the order."""
    return e.withColumn("show_confidence", F.round("show_confidence", 9)).withColumn("word_confidence", F.round("word_confidence", 9))




@query(BASE + f"select {EPISODE_COLS} from episode")
def d7_episodes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(wh.episodes(data(spark, d)))


@query(_best_sql("word_confidence >= 0.8 and show_confidence >= 0.6 and cnt >= 2 and cnt <= 2000 and duration >= 20 and duration <= 18000"))
def d7_best_episodes(spark: SparkSession, d: str) -> DataFrame:
    confident = (F.col("word_confidence") >= 0.8) & (F.col("show_confidence") >= 0.6)
    sized = F.col("cnt").between(2, 2000) & F.col("duration").between(20, 18000)
    return _rounded(wh.best_episodes(_steady(wh.episodes(data(spark, d))), confident, sized))


@query(_best_sql("word_confidence >= 0.8 and show_confidence >= 0.6"))
def d7_best_episodes_confident(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(wh.best_episodes(_steady(wh.episodes(data(spark, d))), (F.col("word_confidence") >= 0.8) & (F.col("show_confidence") >= 0.6)))


@query(_best_sql("true"))
def d7_best_episodes_all(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(wh.best_episodes(_steady(wh.episodes(data(spark, d)))))


@query(BASE + """select show_id, station_id, cnt_overlap, round(cnt_overlap / sum(cnt_overlap) over (partition by show_id), 9) as station_frac_of_show
from (select show_id, station_id, count(*) as cnt_overlap from snippet join radio_station st using (station_id) join show_dim sh using (show_id) where not st.is_excluded and not sh.exclude group by 1, 2)""")
def d8_show_station_fractions(spark: SparkSession, d: str) -> DataFrame:
    sn = snippets(spark, d)
    kept = sn.join(stations(spark, d).where(~F.col("is_excluded")).select("station_id"), "station_id", "left_semi").join(shows(sn).where(~F.col("exclude")).select("show_id"), "show_id", "left_semi")
    return wh.show_station_fractions(kept).withColumn("station_frac_of_show", F.round("station_frac_of_show", 9))


@query(BASE + r"""select show_id, year, month, word, cnt from (
  select *, row_number() over (partition by show_id, year, month order by cnt desc, word) as rn from (
    select show_id, cast(extract(year from insert_dt) as int) as year, cast(extract(month from insert_dt) as int) as month, word, count(*) as cnt
    from (select show_id, insert_dt, unnest(regexp_split_to_array(lower(content), '\s')) as word from snippet where show_id is not null) group by 1, 2, 3, 4)) where rn <= 1000""")
def d12_top_words(spark: SparkSession, d: str) -> DataFrame:
    return wh.top_words(snippets(spark, d), "insert_dt")


STAGED_USERS = """accounts as (select distinct user_id, 'user' || user_id as screen_name from tweet),
staged as (select show_id, 'User' || (5000000 + show_id) || ', user' || (5000100 + show_id) as twitter, 'user' || (5000100 + show_id) as host, 'USER' || (5000000 + show_id) as show_name from show_dim),
"""


def _user_show(spark: SparkSession, d: str) -> DataFrame:
    users = posts(spark, d).select("user_id").distinct().select("user_id", F.concat(F.lit("user"), "user_id").alias("screen_name"))
    own, host = (F.col("show_id") + 5000000).cast("string"), (F.col("show_id") + 5000100).cast("string")
    staged = shows(snippets(spark, d)).select("show_id", F.concat(F.lit("User"), own, F.lit(", user"), host).alias("twitter"), F.concat(F.lit("user"), host).alias("host"), F.concat(F.lit("USER"), own).alias("show"))
    return wh.user_shows(staged, users)


USER_SHOW_SQL = BASE + ", " + STAGED_USERS + """names as (select distinct show_id, lower(unnest(string_split(replace(twitter, ' ', ''), ','))) as name, lower(replace(host, ' ', '')) as host, lower(replace(show_name, ' ', '')) as own from staged)
select user_id, show_id, name = host as is_host, name = own as is_show from names join accounts on lower(screen_name) = name"""


@query(USER_SHOW_SQL)
def d13_user_show(spark: SparkSession, d: str) -> DataFrame:
    return _user_show(spark, d)


# -- pairs and contents ------------------------------------------------------------------------------------------------

def _lcg(x: str) -> str:
    return f"((({x}) % 2147483647) * 1103515245 + 12345) % 2147483648"


def _station_pairs_sql(n: int) -> str:
    return BASE + f"""select date, station_id1, station_id2, cnt1, cnt2 from (
  select *, row_number() over (partition by date order by {_lcg('station_id1 * 100003 + station_id2')}, station_id1, station_id2) as rn
  from (select date, station_id as station_id1, count(*) as cnt1 from snippet_data group by 1, 2)
  join (select date, station_id as station_id2, count(*) as cnt2 from snippet_data group by 1, 2) using (date) where station_id1 > station_id2) where rn <= {n}"""


@query(_station_pairs_sql(200))
def d14_station_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Samples of the source's size."""
    return wh.station_pairs(data(spark, d))


def _best_for_pairs(spark: SparkSession, d: str, *sizes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    all_data = data(spark, d)
    best = wh.best_episodes(_steady(wh.episodes(all_data)))
    with_account = _user_show(spark, d).select("show_id").distinct().withColumn("__t", F.lit(True))
    attributes = all_data.groupBy("show_id").agg(F.max("show_name").alias("show_name"), F.bool_or("is_public").alias("is_public")).join(with_account, "show_id", "left").withColumn("twitter", F.col("__t").isNotNull()).drop("__t")
    return all_data, best, wh.show_pairs(best, attributes, *sizes)


_PAIR_KEY = _lcg("show_id1 * 7919 + show_id2 * 31 + (date1 - date '2019-01-01') * 17 + (date2 - date '2019-01-01')")
def _pairs_cte(n_mixed: int, n_other: int) -> str:
    return ", " + STAGED_USERS + f"""usershow as (select distinct show_id from (select distinct show_id, lower(unnest(string_split(replace(twitter, ' ', ''), ','))) as name from staged) join accounts on lower(screen_name) = name),
best as (select * from (select *, row_number() over (partition by date, show_id order by round(show_confidence, 9) desc nulls first, cnt desc nulls first, round(word_confidence, 9) desc nulls first, station_id) as q from episode) where q = 1),
attrs as (select s.show_id, max(show_name) as show_name, bool_or(is_public) as is_public, max(u.show_id) is not null as twitter from snippet_data s left join usershow u on u.show_id = s.show_id group by 1),
ep as (select date, show_id, station_id, cnt, show_name, is_public, twitter from best join attrs using (show_id)),
pair as (select a.date as date1, b.date as date2, a.show_id as show_id1, b.show_id as show_id2, a.station_id as station_id1, b.station_id as station_id2, a.cnt as cnt1, b.cnt as cnt2,
   a.show_name as show_name1, b.show_name as show_name2, a.is_public as is_public1, b.is_public as is_public2, a.twitter as twitter1, b.twitter as twitter2
   from ep a join ep b on (a.date = b.date and a.show_id > b.show_id) or (a.show_id = b.show_id and a.date > b.date)),
ranked as (select *, row_number() over (partition by twitter1, twitter2, date1 = date2, case when date1 = date2 then cast(date1 as varchar) else cast(show_id1 as varchar) end
   order by {_PAIR_KEY}, date1, date2, show_id1, show_id2) as rn from pair),
pairs as (select *, cast(date1 = date2 as int) as within_day, cast(show_id1 = show_id2 as int) as within_show, cast(twitter1 as int) + cast(twitter2 as int) as twitter_count from ranked
   where (twitter1 and twitter2) or (twitter1 <> twitter2 and rn <= {n_mixed}) or (not twitter1 and not twitter2 and rn <= {n_other}))
"""


_SHOW_PAIRS = "select * exclude (rn) from pairs"
_PAIR_CONTENTS = """select date, show_id, station_id, bool_or(is_public) as is_public, md5(string_agg(content, ' ' order by snippet_id)) as content_md5
from snippet_data join (select date1 as date, show_id1 as show_id, station_id1 as station_id from pairs union select date2, show_id2, station_id2 from pairs) using (date, show_id, station_id) group by 1, 2, 3"""


@query(BASE + _pairs_cte(50, 100) + _SHOW_PAIRS)
def d14_show_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Samples of the source's sizes."""
    return _best_for_pairs(spark, d)[2]


def _pair_contents(all_data: DataFrame, pairs: DataFrame) -> DataFrame:
    return wh.pair_contents(all_data, pairs).select("date", "show_id", "station_id", "is_public", F.md5("content").alias("content_md5"))


@query(BASE + _pairs_cte(50, 100) + _PAIR_CONTENTS)
def d14_pair_contents(spark: SparkSession, d: str) -> DataFrame:
    """The contents of the samples of the source's sizes."""
    all_data, _, pairs = _best_for_pairs(spark, d)
    return _pair_contents(all_data, pairs)


def _contents(flag: str) -> str:
    return BASE + f"select date, station_id, md5(string_agg(content, ' ' order by snippet_id)) as content_md5, count(*) as n from snippet_data where {flag} group by 1, 2"


@query(_contents("not syndicated_approxhash"))
def d15_local_content(spark: SparkSession, d: str) -> DataFrame:
    return data(spark, d).where(~F.col("syndicated_approxhash")).groupBy("date", "station_id").agg(F.md5(wh.ordered_text("content", "snippet_id")).alias("content_md5"), F.count("*").alias("n"))


@query(_contents("syndicated_approxhash"))
def d15_syndicated_content(spark: SparkSession, d: str) -> DataFrame:
    return data(spark, d).where(F.col("syndicated_approxhash")).groupBy("date", "station_id").agg(F.md5(wh.ordered_text("content", "snippet_id")).alias("content_md5"), F.count("*").alias("n"))


# -- extracts ----------------------------------------------------------------------------------------------------------

@query(BASE + """select show_id, max(show_name) as show_name, bool_and(syndicated_show) as syndicated_show, count(*) as nsnippets, round(sum(duration), 3) as duration,
cast(sum(cast(is_public as int)) as bigint) as nsnippets_public, round(sum(cast(is_public as int)) / count(*), 9) as public_fraction from snippet_data where show_id is not null group by 1""")
def d16_show_data(spark: SparkSession, d: str) -> DataFrame:
    return wh.show_data(data(spark, d)).withColumn("duration", F.round("duration", 3)).withColumn("public_fraction", F.round("public_fraction", 9))


@query(BASE + """, s as (select station_id, count(distinct date) as ndates, count(*) as nsnippets, round(sum(duration), 3) as duration from snippet_data group by 1)
select st.station_id, ndates, nsnippets, duration, s.station_id is not null as in_sample, station_format, std_owner, band, station_format = 'Public Radio' as is_public, postal_code, census_region
from radio_station st left join s using (station_id) left join state using (state_id)""")
def d16_station_data(spark: SparkSession, d: str) -> DataFrame:
    return wh.station_data(stations(spark, d), states(spark, d), data(spark, d)).withColumn("duration", F.round("duration", 3))


@query(BASE + """select station_std_owner, count(distinct station_id) as nstations, count(distinct show_id) as nshows, count(*) as nsnippets, round(sum(duration) / 3600, 6) as hours,
round(sum(case when syndicated_approxhash then duration else 0 end) / sum(duration), 9) as syndicated_share from snippet_data group by 1""")
def d16_owners(spark: SparkSession, d: str) -> DataFrame:
    share = F.try_divide(F.sum(F.when(F.col("syndicated_approxhash"), F.col("duration")).otherwise(0)), F.sum("duration"))
    return data(spark, d).groupBy("station_std_owner").agg(F.countDistinct("station_id").alias("nstations"), F.countDistinct("show_id").alias("nshows"), F.count("*").alias("nsnippets"), F.round(F.sum("duration") / 3600, 6).alias("hours"), F.round(share, 9).alias("syndicated_share"))


@query(BASE + "select date, show_id, min(insert_dt) as first_dt, max(insert_dt) as last_dt, round(sum(duration), 3) as airtime from snippet_data where show_id is not null group by 1, 2")
def d16_airtime(spark: SparkSession, d: str) -> DataFrame:
    return data(spark, d).where("show_id is not null").groupBy("date", "show_id").agg(F.min("insert_dt").alias("first_dt"), F.max("insert_dt").alias("last_dt"), F.round(F.sum("duration"), 3).alias("airtime"))


@query(BASE + """select snippet_id, station_id, date, case when diary_gender = 'F' then 'female' when diary_gender = 'M' then 'male' else 'unknown' end as gender,
cast(coalesce(syndicated_approxhash, false) as int) as syndicated, cast(is_public as int) as public from snippet_data where date between date '2020-03-01' and date '2020-04-30'""")
def d17_paper_snippets(spark: SparkSession, d: str) -> DataFrame:
    gender = F.when(F.col("diary_gender") == "F", "female").when(F.col("diary_gender") == "M", "male").otherwise("unknown")
    period = data(spark, d).where(F.col("date").between(F.lit("2020-03-01").cast("date"), F.lit("2020-04-30").cast("date")))
    return period.select("snippet_id", "station_id", "date", gender.alias("gender"), F.coalesce("syndicated_approxhash", F.lit(False)).cast("int").alias("syndicated"), F.col("is_public").cast("int").alias("public"))


@query(BASE + "select distinct audio_key from snippet_data where date between date '2020-03-01' and date '2020-04-30'")
def d17_audio_keys(spark: SparkSession, d: str) -> DataFrame:
    return data(spark, d).where(F.col("date").between(F.lit("2020-03-01").cast("date"), F.lit("2020-04-30").cast("date"))).select("audio_key").distinct()


@query(BASE + """select count(*) as nsnippets, count(distinct station_id) as nstations, count(distinct show_id) as nshows, count(distinct date) as ndates, round(sum(duration) / 3600, 4) as hours,
cast(sum(wordcount) as bigint) as nwords, count(distinct case when is_public then station_id end) as npublic, round(count(show_id) / count(*), 9) as with_show,
round(sum(case when syndicated_approxhash then duration else 0 end) / sum(duration), 9) as syndicated_time from snippet_data""")
def d18_overall(spark: SparkSession, d: str) -> DataFrame:
    return data(spark, d).agg(
        F.count("*").alias("nsnippets"), F.countDistinct("station_id").alias("nstations"), F.countDistinct("show_id").alias("nshows"), F.countDistinct("date").alias("ndates"), F.round(F.sum("duration") / 3600, 4).alias("hours"),
        F.sum("wordcount").alias("nwords"), F.countDistinct(F.when(F.col("is_public"), F.col("station_id"))).alias("npublic"), F.round(F.count("show_id") / F.count("*"), 9).alias("with_show"),
        F.round(F.sum(F.when(F.col("syndicated_approxhash"), F.col("duration")).otherwise(0)) / F.sum("duration"), 9).alias("syndicated_time"),
    )


@query(BASE + """select count(*) as ntweets, count(distinct user_id) as nusers, count(retweeted_status_id) as nretweets, round(count(retweeted_status_id) / count(*), 9) as retweet_share,
round(avg(retweet_count), 6) as mean_retweets, count(*) filter (where user_id in (select user_id from tweet group by user_id having count(*) >= 20)) as by_busy_users from tweet""")
def d18_tweets(spark: SparkSession, d: str) -> DataFrame:
    t = posts(spark, d)
    busy = t.groupBy("user_id").count().where("count >= 20").select("user_id", F.lit(1).alias("busy"))
    return t.join(busy, "user_id", "left").agg(
        F.count("*").alias("ntweets"), F.countDistinct("user_id").alias("nusers"), F.count("retweeted_status_id").alias("nretweets"), F.round(F.count("retweeted_status_id") / F.count("*"), 9).alias("retweet_share"),
        F.round(F.avg("retweet_count"), 6).alias("mean_retweets"), F.count("busy").alias("by_busy_users"),
    )


@query(f"select user_id, count(*) as nshows, string_agg(show_id, ',' order by show_id) as shows from ({USER_SHOW_SQL}) group by user_id order by nshows desc, user_id limit 20")
def d19_user_extremes(spark: SparkSession, d: str) -> DataFrame:
    by_user = _user_show(spark, d).groupBy("user_id").agg(F.count("*").alias("nshows"), F.array_join(F.sort_array(F.collect_list("show_id")).cast("array<string>"), ",").alias("shows"))
    return by_user.orderBy(F.col("nshows").desc(), "user_id").limit(20)


@query(BASE + r"""select tweet_id, user_id, regexp_replace(content, '[\n\r]+', ' ', 'g') as content, cast(insert_dt as date) as date, retweeted_status_id is not null as is_retweet,
case when lang = 'en' then 'english' when lang is null then 'unknown' else 'other' end as language from tweet
where insert_dt >= (select max(insert_dt) - interval 365 day from tweet) and length(content) > 0""")
def d20_tweets(spark: SparkSession, d: str) -> DataFrame:
    t = posts(spark, d)
    since = t.agg(F.max("insert_dt") - F.expr("interval 365 days")).scalar()
    language = F.when(F.col("lang") == "en", "english").when(F.col("lang").isNull(), "unknown").otherwise("other")
    kept = t.where((F.col("insert_dt") >= since) & (F.length("content") > 0))
    return kept.select("tweet_id", "user_id", F.regexp_replace("content", r"[\n\r]+", " ").alias("content"), F.to_date("insert_dt").alias("date"), F.col("retweeted_status_id").isNotNull().alias("is_retweet"), language.alias("language"))


@query(BASE + """, last as (select * from (select *, row_number() over (partition by user_id order by insert_dt desc, tweet_id desc) as rn from tweet) where rn = 1),
c as (select user_id, count(*) as ntweets, count(retweeted_status_id) as nretweets, cast(sum(retweet_count) as bigint) as retweets, min(insert_dt) as first_dt from tweet group by 1),
r as (select retweeted_status_id as tweet_id, count(*) as n from tweet where retweeted_status_id is not null group by 1),
m as (select t.user_id, cast(sum(r.n) as bigint) as was_retweeted from tweet t join r using (tweet_id) group by 1)
select c.user_id, ntweets, nretweets, retweets, first_dt, last.insert_dt as last_dt, last.source as last_source, coalesce(was_retweeted, 0) as was_retweeted
from c join last using (user_id) left join m using (user_id)""")
def d21_user_data(spark: SparkSession, d: str) -> DataFrame:
    t = posts(spark, d)
    last = win.latest(t, ["user_id"], "insert_dt", "tweet_id").select("user_id", F.col("insert_dt").alias("last_dt"), F.col("source").alias("last_source"))
    counts = t.groupBy("user_id").agg(F.count("*").alias("ntweets"), F.count("retweeted_status_id").alias("nretweets"), F.sum("retweet_count").alias("retweets"), F.min("insert_dt").alias("first_dt"))
    again = t.where("retweeted_status_id is not null").groupBy(F.col("retweeted_status_id").alias("tweet_id")).agg(F.count("*").alias("n"))
    was = t.join(again, "tweet_id").groupBy("user_id").agg(F.sum("n").alias("was_retweeted"))
    return counts.join(last, "user_id").join(was, "user_id", "left").withColumn("was_retweeted", F.coalesce("was_retweeted", F.lit(0)))


DAYS = ("2020-03-01", "2020-03-31")


@query(BASE + f"""select date, user_id, coalesce(n, 0) as ntweets, coalesce(date_diff('day', max(case when n > 0 then date end) over (partition by user_id order by date rows unbounded preceding), date), 100) as days_since
from (select cast(unnest(generate_series(timestamp '{DAYS[0]}', timestamp '{DAYS[1]}', interval 1 day)) as date) as date) cross join (select user_id from tweet group by 1 having count(*) >= 5)
left join (select user_id, cast(insert_dt as date) as date, count(*) as n from tweet where insert_dt >= timestamp '{DAYS[0]}' and insert_dt <= timestamp '{DAYS[1]}' group by 1, 2) using (user_id, date)""")
def d22_activity_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Tweets of every active user on every day of a period; the upper bound is midnight of its last day."""
    t = posts(spark, d)
    days = F.explode(F.sequence(F.lit(DAYS[0]).cast("date"), F.lit(DAYS[1]).cast("date")))
    frame = t.groupBy("user_id").count().where("count >= 5").select("user_id", days.alias("date"))
    per_day = t.where(F.col("insert_dt").between(F.lit(DAYS[0]).cast("timestamp"), F.lit(DAYS[1]).cast("timestamp"))).groupBy("user_id", F.to_date("insert_dt").alias("date")).agg(F.count("*").alias("ntweets"))
    out = frame.join(per_day, ["user_id", "date"], "left").withColumn("ntweets", F.coalesce("ntweets", F.lit(0)))
    return win.days_since_last(out, ["user_id"], "date", F.col("ntweets") > 0).withColumn("days_since", F.col("days_since").cast("bigint")).select("date", "user_id", "ntweets", "days_since")


@query(BASE + f"""select tweet_id, content from tweet where {_lcg('tweet_id')} < 214748364 and (insert_dt between timestamp '2019-09-01' and timestamp '2019-10-31' or insert_dt between timestamp '2020-03-01' and timestamp '2020-04-30')""")
def d23_sample(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the posts of two periods, chosen by their id."""
    t = posts(spark, d)
    within = lambda a, b: F.col("insert_dt").between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp"))
    return win.bernoulli(t.where(within("2019-09-01", "2019-10-31") | within("2020-03-01", "2020-04-30")), "tweet_id", 0.1).select("tweet_id", "content")


@query(BASE + """select s.snippet_id, st.station_id, sh.show_id as mapped_show, s.date from snippet s join (select station_id, callsign from radio_station where ingested) st using (station_id)
join (select name, min(show_id) as show_id from show_dim where name is not null group by name) sh on lower(sh.name) = lower(s.raw_show_name)""")
def d24_new_snippets(spark: SparkSession, d: str) -> DataFrame:
    """New recognizer rows with their station and show looked up; rows without either are dropped."""
    sn = snippets(spark, d)
    names = shows(sn).where("name is not null").groupBy("name").agg(F.min("show_id").alias("mapped_show")).select(F.lower("name").alias("n"), "mapped_show")
    st = stations(spark, d).where("ingested").select("station_id")
    return sn.withColumn("n", F.lower("raw_show_name")).join(st, "station_id").join(names, "n").select("snippet_id", "station_id", "mapped_show", "date")


@query(f"""with item as (select *, cast(substring(id, 2) as bigint) as k from auto_sample where content is not null and length(content) > 0),
n as (select sample_year, min(c) as n from (select sample_year, kind, count(*) as c from item where kind in ('elite', 'radio') group by 1, 2) group by 1)
select id, kind, sample_year from (select *, row_number() over (partition by sample_year, kind order by {_lcg('k')}, k) as rn from item join n using (sample_year)) where rn <= n * case kind when 'decahose' then 6 else 1 end""")
def d25_rebalanced(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "auto_sample").where("content is not null and length(content) > 0").withColumn("k", F.substring("id", 2, 20).cast("bigint"))
    return win.rebalanced(items, ["sample_year"], "kind", "k", {"decahose": 6}, ["elite", "radio"]).select("id", "kind", "sample_year")
