"""Election, census and post marts, each with the SQL that checks it.

The tables hold no precincts, census or mentions, so they are derived by rule: precincts are customers, geographies suppliers and census values their
lineitem quantities, with boxes of degrees placed by id; station maps keep their stations and strengths on boxes of their own. Mentions and replies are read off the posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators import geometry, graphs, stats
from tidewave.operators import windows as win
from tidewave.plans import warehouse
from tidewave.plans.tables import Query, table
from tidewave.sources import files

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# -- staged tables -----------------------------------------------------------------------------------------------------

def _boxed(df: DataFrame, key: str, a: int, b: int, wide: float, high: float) -> DataFrame:
    """A box for each row, placed by its id, as text."""
    x, y = F.col(key) * a % 5000 / 100.0 - 120.0, F.col(key) * b % 2000 / 100.0 + 25.0
    corner = lambda u, v: F.concat_ws(" ", u.cast("string"), v.cast("string"))
    ring = F.concat_ws(",", corner(x, y), corner(x + wide, y), corner(x + wide, y + high), corner(x, y + high), corner(x, y))
    return df.withColumn("wkt", F.concat(F.lit("POLYGON(("), ring, F.lit("))")))


def _box_sql(key: str, a: int, b: int, wide: float, high: float) -> str:
    x, y = f"({key} * {a} % 5000 / 100.0 - 120.0)", f"({key} * {b} % 2000 / 100.0 + 25.0)"
    return f"cast({x} as double) as x0, cast({y} as double) as y0, cast({x} as double) + {wide} as x1, cast({y} as double) + {high} as y1"


PRECINCT_BOX, MAP_BOX, GEO_BOX = (37, 53, 0.5, 0.25), (41, 29, 2.0, 1.5), (23, 71, 1.0, 0.5)


def states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").where("n_nationkey < 20").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("fips"), (F.col("n_nationkey") + 100).alias("state_id"))


def staged_precincts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("precinct_id"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("state_fips"), (F.col("c_custkey") % 997).alias("dem"), (F.col("c_custkey") % 883).alias("rep"))
    return _boxed(c, "precinct_id", *PRECINCT_BOX).withColumn("total", F.col("dem") + F.col("rep") + F.col("precinct_id") % 101)


def staged_geographies(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("n"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("geoid"), F.lit("T").alias("tract_code"), F.when(F.col("s_suppkey") % 3 != 0, F.lit("G")).alias("block_group_code"))
    return _boxed(s, "n", *GEO_BOX).drop("n")


# The variables of the made-up census, by line number of the orders.
VARIABLES = ["B01003e1", "B01001e2", "B02001e2", "B19013e1", "B09001e1", "B23020e1", "unused"]


def staged_census(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(v) for v in VARIABLES]), F.col("l_linenumber").cast("int"))
    return table(spark, d, "lineitem").groupBy(F.lpad(F.col("l_suppkey").cast("string"), 8, "0").alias("geoid"), name.alias("variable")).agg(F.sum("l_quantity").cast("double").alias("value"))


def maps(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "radio_station_map").select(F.col("station_map_id").alias("map_id"), "station_id", "time_of_day", "strength").dropDuplicates(["map_id"])
    return _boxed(m, "map_id", *MAP_BOX)


STAGED = f"""with states as (select lpad(cast(n_nationkey as varchar), 2, '0') as fips, n_nationkey + 100 as state_id from nation where n_nationkey < 20),
precinct as (select c_custkey as precinct_id, lpad(cast(c_nationkey as varchar), 2, '0') as state_fips, c_custkey % 997 as dem, c_custkey % 883 as rep, c_custkey % 997 + c_custkey % 883 + c_custkey % 101 as total,
  {_box_sql('c_custkey', *PRECINCT_BOX)} from customer),
geo as (select s_suppkey as geography_id, lpad(cast(s_suppkey as varchar), 8, '0') as geoid, s_suppkey % 3 <> 0 as is_group, {_box_sql('s_suppkey', *GEO_BOX)} from supplier),
cv as (select variable, row_number() over (order by variable) as variable_id from (select unnest({VARIABLES}) as variable) where variable <> 'unused'),
census as (select lpad(cast(l_suppkey as varchar), 8, '0') as geoid, {VARIABLES}[l_linenumber] as variable, cast(sum(l_quantity) as double) as value from lineitem group by 1, 2),
map as (select station_map_id as map_id, station_id, time_of_day, strength, {_box_sql('station_map_id', *MAP_BOX)} from (select distinct station_map_id, station_id, time_of_day, strength from radio_station_map)),
"""


def _walk_sql(region: str, key: str) -> str:
    return f"""(select map_id, {key}, x0 >= rx0 and x1 <= rx1 and y0 >= ry0 and y1 <= ry1 as contained, (least(x1, rx1) - greatest(x0, rx0)) * (least(y1, ry1) - greatest(y0, ry0)) / ((x1 - x0) * (y1 - y0)) as fraction
  from {region} join (select map_id, x0 as rx0, y0 as ry0, x1 as rx1, y1 as ry1 from map) on x0 < rx1 and rx0 < x1 and y0 < ry1 and ry0 < y1)"""


# -- loads -------------------------------------------------------------------------------------------------------------

def precinct_results(spark: SparkSession, d: str) -> DataFrame:
    """Precincts with their state by code; those of unknown states stay, without one."""
    return staged_precincts(spark, d).join(states(spark, d).withColumnRenamed("fips", "state_fips"), "state_fips", "left").drop("state_fips")


@query(STAGED + "z as (select 1) select precinct_id, state_id, dem, rep, total from precinct left join states on fips = state_fips")
def d2_precincts(spark: SparkSession, d: str) -> DataFrame:
    return precinct_results(spark, d).select("precinct_id", "state_id", "dem", "rep", "total")


def census_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Geographies and variables with numbers, and the data of the variables kept, by number."""
    geographies = staged_geographies(spark, d).withColumn("geography_id", F.col("geoid").cast("bigint"))
    variables = spark.createDataFrame([(v, i + 1) for i, v in enumerate(sorted(set(VARIABLES) - {"unused"}))], "variable string, variable_id bigint")
    data = staged_census(spark, d).join(variables, "variable").join(geographies.select("geoid", "geography_id"), "geoid", "left")
    return geographies, variables, data.select("geography_id", "variable_id", "variable", "value")


@query(STAGED + "z as (select 1) select geography_id, variable_id, value from census join cv using (variable) left join geo using (geoid)")
def d2_census(spark: SparkSession, d: str) -> DataFrame:
    return census_tables(spark, d)[2].drop("variable")


# -- crosswalks and votes ----------------------------------------------------------------------------------------------

VOTES = ["dem", "rep", "total"]
_SUMS = ", ".join(f"round(sum(fraction * {v}), 6) as {v}" for v in VOTES)
_VOTES = STAGED + f"walk as {_walk_sql('precinct', 'precinct_id')}, votes as (select map_id, count(distinct precinct_id) as n_regions, {', '.join(f'sum(fraction * {v}) as {v}' for v in VOTES)} from walk join precinct using (precinct_id) group by 1)"


def _rounded(df: DataFrame, columns: list[str], n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if c in columns else F.col(c) for c in df.columns])


@query(STAGED + f"walk as {_walk_sql('precinct', 'precinct_id')} select map_id, precinct_id as region_id, contained, round(fraction, 6) as fraction from walk where fraction > 1e-9")
def d9_precinct_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """Fractions are rounded once a pair of shapes; rows can be many times as many."""
    m, r = maps(spark, d).select("map_id", "wkt"), precinct_results(spark, d).select(F.col("precinct_id").alias("region_id"), "wkt")
    walk = geometry.shape_crosswalk(m, r).where("fraction > 1e-9").select("map_shape", "region_shape", "contained", "fraction")
    return geometry.of_rows(_rounded(walk, ["fraction"]), m, r)


def votes_of(spark: SparkSession, d: str, of: DataFrame) -> DataFrame:
    """Votes of the given maps, whose other columns stay."""
    return geometry.weighted_by_overlap(of, precinct_results(spark, d).select(F.col("precinct_id").alias("region_id"), "wkt", *VOTES), VOTES)


def map_votes(spark: SparkSession, d: str) -> DataFrame:
    return votes_of(spark, d, maps(spark, d).select("map_id", "wkt"))


@query(_VOTES + " select map_id, n_regions, " + ", ".join(f"round({v}, 4) as {v}" for v in VOTES) + " from votes")
def d10_votes_by_map(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(map_votes(spark, d), VOTES, 4)


def _shares(df: DataFrame) -> DataFrame:
    return df.withColumn("d_share", F.try_divide("dem", "total")).withColumn("d_share_2way", F.try_divide(F.col("dem"), F.col("dem") + F.col("rep")))


def _fractions(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.d8_show_station_fractions(spark, d)


_MAP_SHARES = "map_id, station_id, time_of_day, strength, " + ", ".join(f"round({v}, 4) as {v}" for v in VOTES) + ", round(dem / nullif(total, 0), 6) as d_share, round(dem / nullif(dem + rep, 0), 6) as d_share_2way"


@query(_VOTES + f" select {_MAP_SHARES} from map join votes using (map_id)")
def d16_election_stations(spark: SparkSession, d: str) -> DataFrame:
    out = _shares(votes_of(spark, d, maps(spark, d)).drop("n_regions"))
    return _rounded(_rounded(out, VOTES, 4), ["d_share", "d_share_2way"])


def _of_stations(by_map: str, columns: list[str]) -> str:
    return f"(select station_id, {', '.join(f'avg({c}) as {c}' for c in columns)} from {by_map} join map using (map_id) where strength = 'moderate' and time_of_day in ('A', 'D', 'N') group by 1)"


_BY_SHOW = _VOTES + f", f as ({warehouse.SQL['d8_show_station_fractions']}), st as {_of_stations('votes', VOTES)}, sv as (select show_id, {', '.join(f'sum(station_frac_of_show * {v}) as {v}' for v in VOTES)} from f join st using (station_id) group by 1)"


def show_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes of each show, as sums of its stations' votes by their share of it. Only the maps that count for a station meet the precincts."""
    m = geometry.maps_of(maps(spark, d))
    return geometry.by_show(geometry.by_station(votes_of(spark, d, m.select("map_id", "wkt")), m, VOTES), _fractions(spark, d), VOTES)


@query(_BY_SHOW + f" select show_id, {', '.join(f'round({v}, 4) as {v}' for v in VOTES)} from sv")
def d10_votes_by_show(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(show_votes(spark, d), VOTES, 4)


@query(_BY_SHOW + f" select show_id, {', '.join(f'round({v}, 4) as {v}' for v in VOTES)}, round(dem / nullif(total, 0), 6) as d_share, round(dem / nullif(dem + rep, 0), 6) as d_share_2way from sv")
def d16_election_shows(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rounded(_shares(show_votes(spark, d)), VOTES, 4), ["d_share", "d_share_2way"])


# -- census ------------------------------------------------------------------------------------------------------------

COUNTS = {"n_male": ["B01001e2"], "n_white": ["B02001e2"], "n_children": ["B09001e1"]}
MEDIANS = {"median_hh_income": "B19013e1", "mean_hours_worked": "B23020e1"}
OF_TRACTS = ("n_children", "mean_hours_worked")


def map_census(spark: SparkSession, d: str) -> DataFrame:
    geographies, _, data = census_tables(spark, d)
    wide = geometry.census_wide(data, geographies, COUNTS, MEDIANS, "B01003e1", OF_TRACTS)
    return geometry.census_by_map(maps(spark, d).select("map_id", "wkt"), geographies.select("geography_id", "wkt"), wide, list(COUNTS), list(MEDIANS))


def _wide_sql() -> str:
    value = lambda names, tract: f"sum(case when {'not ' if tract else ''}is_group and variable in ({', '.join(repr(n) for n in names)}) then value else 0 end)"
    measures = [f"{value(v, k in OF_TRACTS)} as {k}" for k, v in COUNTS.items()] + [f"{value([v], k in OF_TRACTS)} as {k}" for k, v in MEDIANS.items()]
    return f"(select geography_id, is_group, sum(case when variable = 'B01003e1' then value else 0 end) as population, {', '.join(measures)} from census join cv using (variable) join geo using (geoid) group by 1, 2)"


_ALL = ["population", *COUNTS, *MEDIANS]
_CENSUS = (
    STAGED + f"walk as {_walk_sql('geo', 'geography_id')}, wide as {_wide_sql()}, mc as (select map_id, count(distinct geography_id) as n_geos, sum(case when is_group then fraction * population else 0 end) as population, "
    + ", ".join(f"sum(fraction * {c}) as {c}" for c in COUNTS) + ", " + ", ".join(f"sum(fraction * population * {m}) / nullif(sum(fraction * population), 0) as {m}" for m in MEDIANS)
    + " from walk join wide using (geography_id) where fraction > 1e-12 group by 1)"
)


@query(_CENSUS + f" select map_id, n_geos, {', '.join(f'round({c}, 4) as {c}' for c in _ALL)} from mc")
def d11_census_by_map(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(map_census(spark, d), _ALL, 4)


@query(_CENSUS + " select map_id, n_geos, round(population, 4) as population from mc")
def d11_population_by_map(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(map_census(spark, d).select("map_id", "n_geos", "population"), ["population"], 4)


_CENSUS_SHOW = (
    _CENSUS + f", f as ({warehouse.SQL['d8_show_station_fractions']}), sc as {_of_stations('mc', _ALL)} select show_id, round(sum(station_frac_of_show * population), 4) as population, "
    + ", ".join(f"round(sum(station_frac_of_show * {c}) / nullif(sum(station_frac_of_show * population), 0), 6) as frac_{c[2:]}" for c in COUNTS) + ", "
    + ", ".join(f"round(sum(station_frac_of_show * {m}), 4) as {m}" for m in MEDIANS) + " from f join sc using (station_id) group by 1"
)


@query(_CENSUS_SHOW)
def d11_census_by_show(spark: SparkSession, d: str) -> DataFrame:
    stations = geometry.by_station(map_census(spark, d), maps(spark, d), _ALL)
    out = geometry.census_by_show(stations, _fractions(spark, d), list(COUNTS), list(MEDIANS))
    return _rounded(_rounded(out, ["population", *MEDIANS], 4), [f"frac_{c[2:]}" for c in COUNTS])


@query(_CENSUS + " select map_id, station_id, time_of_day, strength, round(population, 4) as population from map join mc using (map_id)")
def d16_census_stations(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(maps(spark, d).drop("wkt").join(map_census(spark, d).select("map_id", "population"), "map_id"), ["population"], 4)


# -- station extracts --------------------------------------------------------------------------------------------------

@query("""with heard as (select distinct station_id from radio_snippet where station_id is not null), m as (select distinct station_map_id, station_id, time_of_day, strength, wkt from radio_station_map)
select station_id, time_of_day, strength, wkt from (select *, row_number() over (partition by station_id order by time_of_day, station_map_id) as rn from m where strength = 'moderate' and station_id in (from heard)) where rn = 1""")
def d16_station_maps(spark: SparkSession, d: str) -> DataFrame:
    """The preferred moderate map of every station that is heard."""
    heard = table(spark, d, "radio_snippet").select("station_id").where("station_id is not null").distinct()
    m = table(spark, d, "radio_station_map").dropDuplicates(["station_map_id"]).where("strength = 'moderate'").join(heard, "station_id", "left_semi")
    return win.top_per_group(m, ["station_id"], [F.col("time_of_day").asc_nulls_last(), F.col("station_map_id")]).select("station_id", "time_of_day", "strength", "wkt")


@query(warehouse.BASE + f""", us as ({warehouse.USER_SHOW_SQL}) select station_id, callsign, band, freq, station_format, postal_code from radio_station join state using (state_id)
where not is_excluded and station_id in (select station_id from snippet join show_dim using (show_id) where not exclude and show_id in (select show_id from us))""")
def d16_matched_stations(spark: SparkSession, d: str) -> DataFrame:
    """Stations that carry a show with an account."""
    sn = warehouse.snippets(spark, d)
    with_account = warehouse._user_show(spark, d).select("show_id").distinct()
    heard = sn.join(warehouse.shows(sn).where("not exclude").select("show_id"), "show_id", "left_semi").join(with_account, "show_id", "left_semi").select("station_id").distinct()
    st = warehouse.stations(spark, d).where(~F.col("is_excluded")).join(heard, "station_id", "left_semi")
    return st.join(warehouse.states(spark, d).select("state_id", "postal_code"), "state_id").select("station_id", "callsign", "band", "freq", "station_format", "postal_code")


_ELIGIBLE = warehouse.BASE + f""", us as (select distinct show_id from ({warehouse.USER_SHOW_SQL})), el as (select sn.*, us.show_id as with_account from snippet sn join radio_station st using (station_id)
left join show_dim sh on sh.show_id = sn.show_id left join us on us.show_id = sn.show_id where not st.is_excluded and not coalesce(sh.exclude, false))"""
_STATS = """count(distinct station_id) as stations, count(distinct show_id) as shows, round(sum(duration), 3) as seconds, cast(sum(wordcount) as bigint) as words, round(count(with_account) / nullif(count(show_id), 0), 6) as account_share,
round(sum(case when with_account is not null then wordcount else 0 end) / nullif(sum(case when show_id is not null then wordcount else 0 end), 0), 6) as account_share_words, round(count(show_id) / count(*), 6) as part_with_show,
round(count(with_account) / count(*), 6) as part_with_account, round(sum(case when show_id is not null then wordcount else 0 end) / nullif(sum(wordcount), 0), 6) as words_with_show,
round(sum(case when with_account is not null then duration else 0 end) / nullif(sum(duration), 0), 6) as time_with_account"""


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of stations and shows that are not excluded, empty ones too, marked by whether their show has an account."""
    sn = warehouse.snippets(spark, d)
    us = warehouse._user_show(spark, d).select("show_id").distinct().withColumn("with_account", F.col("show_id"))
    sn = sn.join(warehouse.stations(spark, d).where(~F.col("is_excluded")).select("station_id"), "station_id", "left_semi")
    sn = sn.join(warehouse.shows(sn).where("exclude").select("show_id"), "show_id", "left_anti")
    return sn.join(us, "show_id", "left")


def _overall() -> list[Column]:
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    of = lambda c, v: F.sum(F.when(F.col(c).isNotNull(), F.col(v)).otherwise(0))
    return [
        F.countDistinct("station_id").alias("stations"), F.countDistinct("show_id").alias("shows"), F.round(F.sum("duration"), 3).alias("seconds"), F.sum("wordcount").alias("words"),
        share(F.count("with_account"), F.count("show_id")).alias("account_share"), share(of("with_account", "wordcount"), of("show_id", "wordcount")).alias("account_share_words"), share(F.count("show_id"), F.count("*")).alias("part_with_show"),
        share(F.count("with_account"), F.count("*")).alias("part_with_account"), share(of("show_id", "wordcount"), F.sum("wordcount")).alias("words_with_show"), share(of("with_account", "duration"), F.sum("duration")).alias("time_with_account"),
    ]


@query(_ELIGIBLE + f" select 'all' as year, {_STATS} from el union all select cast(extract(year from insert_dt) as varchar), {_STATS} from el group by extract(year from insert_dt)")
def d18_by_year(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of all eligible snippets and of each year's."""
    e = _eligible(spark, d)
    return e.agg(*_overall()).select(F.lit("all").alias("year"), "*").unionByName(e.groupBy(F.year("insert_dt").cast("string").alias("year")).agg(*_overall()))


@query(_ELIGIBLE + f", pairs as ({warehouse.USER_SHOW_SQL}) select count(distinct user_id) as users, count(distinct show_id) as shows_with_account from pairs where show_id in (select show_id from el where show_id is not null)")
def d18_accounts(spark: SparkSession, d: str) -> DataFrame:
    us = warehouse._user_show(spark, d).select("user_id", "show_id").join(_eligible(spark, d).select("show_id").distinct(), "show_id", "left_semi")
    return us.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("show_id").alias("shows_with_account"))


# -- posts -------------------------------------------------------------------------------------------------------------

@query(warehouse.BASE + f", us as ({warehouse.USER_SHOW_SQL}) select distinct user_id, show_id, name as show_name from us join show_dim using (show_id) where not exclude")
def d20_user_show(spark: SparkSession, d: str) -> DataFrame:
    sh = warehouse.shows(warehouse.snippets(spark, d)).where("not exclude").select("show_id", F.col("name").alias("show_name"))
    return warehouse._user_show(spark, d).select("user_id", "show_id").distinct().join(sh, "show_id")


@query("select distinct actor_id as user_id, 'u' || actor_id as screen_name from elite_tweet_2022 where actor_id is not null")
def d20_elite_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elite_tweet_2022").where("actor_id is not null").select(F.col("actor_id").alias("user_id"), F.concat(F.lit("u"), "actor_id").alias("screen_name")).distinct()


# Clients by the device they stand for.
CLIENTS = {"Twitter for iPhone": "iPhone", "Twitter for Android": "Android", "Twitter Web App": "Desktop", "Twitter Web Client": "Desktop", "TweetDeck": "Desktop"}
_CLIENT = "case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in CLIENTS.items()) + " else 'Other' end"


def client(source: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in CLIENTS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, source), F.lit("Other"))


@query(warehouse.BASE + f"""select tweet_id as id, user_id, insert_dt as timestamp, lang, source, retweeted_status_id is not null as is_retweet, retweet_count, favorite_count, {_CLIENT.format(c='source')} as source_collapsed, replace(content, chr(9), ' ') as content
from tweet where insert_dt >= timestamp '2021-01-01' and insert_dt <= timestamp '2021-03-01'""")
def d20_tweets_2021(spark: SparkSession, d: str) -> DataFrame:
    t = warehouse.posts(spark, d).where("insert_dt >= timestamp'2021-01-01' and insert_dt <= timestamp'2021-03-01'")
    return t.select(F.col("tweet_id").alias("id"), "user_id", F.col("insert_dt").alias("timestamp"), "lang", "source", F.col("retweeted_status_id").isNotNull().alias("is_retweet"), "retweet_count", "favorite_count", client(F.col("source")).alias("source_collapsed"), F.replace("content", F.lit("\t"), F.lit(" ")).alias("content"))


@query(f"""select activity_id, actor_id as user_id, generator_name as source, {_CLIENT.format(c='generator_name')} as source_collapsed, in_reply_to is not null as is_reply
from (select distinct activity_id, actor_id, generator_name, in_reply_to from elite_tweet_2022)""")
def f8_activity_fields(spark: SparkSession, d: str) -> DataFrame:
    """Activities whose fields are nested, as delivered: the actor's and the activity's number behind their prefixes, the generator's name."""
    t = table(spark, d, "elite_tweet_2022").select("activity_id", "actor_id", "generator_name", "in_reply_to").distinct()
    nested = t.select(F.concat(F.lit("tag:search.twitter.com,2005:"), "activity_id").alias("id"), F.struct(F.concat(F.lit("id:twitter.com:"), "actor_id").alias("id")).alias("actor"), F.struct(F.col("generator_name").alias("displayName")).alias("generator"), F.col("in_reply_to").alias("inReplyTo"))
    return files.activity_fields(nested).select(F.col("id").alias("activity_id"), "user_id", "source", client(F.col("source")).alias("source_collapsed"), "is_reply")


_MENTIONS = r"m as (select distinct tweet_id, user_id, insert_dt, unnest(list_distinct(regexp_extract_all(content, '@([A-Za-z]+[A-Za-z_]*)[0-9_]*', 1))) as name from tweet)"


@query(warehouse.BASE + f""", {_MENTIONS}, who as (select 'name' || (user_id % 40) as handle, user_id from tweet group by user_id)
select user_id as source, name as target, cast(extract(year from insert_dt) as int) as year, cast(extract(month from insert_dt) as int) as month, count(*) as n from m group by 1, 2, 3, 4""")
def g3_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Who mentions which handle, by month."""
    t = warehouse.posts(spark, d)
    m = t.select("user_id", "insert_dt", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("@([A-Za-z]+[A-Za-z_]*)[0-9_]*"), F.lit(1)))).alias("name"))
    return graphs.interactions(m, "insert_dt", "user_id", "name")


@query("""with e as (select distinct activity_id, actor_id, in_reply_to, posted_time from elite_tweet_2022) select actor_id as source, in_reply_to % 50 as target, cast(extract(year from posted_time) as int) as year, cast(extract(month from posted_time) as int) as month, count(*) as n
from e where in_reply_to is not null and actor_id is not null group by 1, 2, 3, 4""")
def g3_replies(spark: SparkSession, d: str) -> DataFrame:
    """Who answers whom, by month; the account answered is read off the post's number, as the tables lack it."""
    e = table(spark, d, "elite_tweet_2022").select("activity_id", "actor_id", "in_reply_to", "posted_time").distinct().withColumn("whose", F.col("in_reply_to") % 50)
    return graphs.interactions(e, "posted_time", "actor_id", "whose")


# -- small operators ---------------------------------------------------------------------------------------------------

_STOP = "', '".join(files.STOP_LINES)


@query(f"select distinct snippet_id from radio_snippet where content not in ('{_STOP}')")
def stop_lines_p9(spark: SparkSession, d: str) -> DataFrame:
    """Snippets that are more than a filler line."""
    return files.without_stop_lines(table(spark, d, "radio_snippet"), "content").select("snippet_id").distinct()


@query("select event_id, event_type, round(value - m, 6) as away from (select *, quantile_cont(value, 0.5) over (partition by event_type) as m from events)")
def a19_from_median(spark: SparkSession, d: str) -> DataFrame:
    return stats.with_median(table(spark, d, "events"), ["event_type"], "value", "m").select("event_id", "event_type", F.round(F.col("value") - F.col("m"), 6).alias("away"))


@query("select count(distinct user_id) as n_users from (select user_id from twitter_tweet union all select actor_id from elite_tweet_2022)")
def a23_users_of_both(spark: SparkSession, d: str) -> DataFrame:
    return stats.count_of_union([table(spark, d, "twitter_tweet").select("user_id"), table(spark, d, "elite_tweet_2022").select("actor_id")], "n_users")


@query(r"""with l as (select json_extract_string(line_json, '$.content') as content, json_extract_string(line_json, '$.callsign') as callsign, json_extract_string(line_json, '$.show_name') as show_name from snippet_line)
select count(*) as n, cast(coalesce(sum(len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> ''))), 0) as bigint) as n_words, count(show_name) as has_show, count(distinct callsign) as stations, count(distinct show_name) as shows, round(count(show_name) / count(*), 9) as show_part from l""")
def a22_line_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals over recognizer records as they are scanned, in one aggregate."""
    field = lambda name: F.get_json_object("line_json", f"$.{name}")
    l = table(spark, d, "snippet_line").select(field("content").alias("content"), field("callsign").alias("callsign"), field("show_name").alias("show_name"))
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    return l.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("content").isNotNull(), words)), F.lit(0)).cast("bigint").alias("n_words"), F.count("show_name").alias("has_show"), F.countDistinct("callsign").alias("stations"), F.countDistinct("show_name").alias("shows"), F.round(F.count("show_name") / F.count("*"), 9).alias("show_part")
    )


@query("""with t as (select cast(ts as date) as day, event_type, user_id % 3 as side, count(*) as n from events group by 1, 2, 3)
select day, coalesce(sum(n) filter (where event_type = 'view' and side = 0), 0) as view_0, coalesce(sum(n) filter (where event_type = 'view' and side = 1), 0) as view_1, coalesce(sum(n) filter (where event_type = 'click' and side = 0), 0) as click_0, coalesce(sum(n) filter (where event_type = 'click' and side = 1), 0) as click_1 from t group by 1""")
def t7_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts with a column for each kind and side."""
    from tidewave.operators.ticks import pivot_by_side

    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type", (F.col("user_id") % 3).cast("string").alias("side")).agg(F.count("*").alias("n"))
    return pivot_by_side(e, ["day"], "event_type", "side", "n", ["view", "click"], ["0", "1"])


@query("select cast(substring(id, 2) as bigint) as id, sample_year from auto_sample where kind = 'elite' and sample_year <= 2021 group by 1, 2")
def s20_elite_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of one kind of items up to a year, for a replication set that holds no content."""
    return files.replication_ids(table(spark, d, "auto_sample").where("sample_year <= 2021"), "kind", "elite", "id", "E", ["sample_year"])


@query("""with best as (select show_id, max(raw_show_name) as show_name from radio_snippet where show_id is not null group by 1), sn as (select distinct snippet_id, station_id, show_id, content from radio_snippet), st as (select station_id, min(callsign) as callsign, min(band) as band from radio_station group by 1)
select snippet_id, callsign, band, show_name, length(content) as n_chars from sn left join st using (station_id) left join best using (show_id)""")
def u4_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Snippets with their station, show and readable text."""
    from tidewave.operators.segments import enriched

    sn = table(spark, d, "radio_snippet").select("snippet_id", "station_id", "show_id", "content").distinct()
    names = table(spark, d, "radio_snippet").where("show_id is not null").groupBy("show_id").agg(F.max("raw_show_name").alias("show_name"))
    st = table(spark, d, "radio_station").groupBy("station_id").agg(F.min("callsign").alias("callsign"), F.min("band").alias("band"))
    return enriched(sn, st, names).select("snippet_id", "callsign", "band", "show_name", F.length("content").alias("n_chars"))
