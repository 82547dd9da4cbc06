"""Queries of the smaller operators over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.functions import text as tx
from tidewave.operators import graphs, joins, models, segments, series, stats, stories, ticks
from tidewave.operators import windows as win
from tidewave.plans import analysis
from tidewave.plans.tables import Query, table
from tidewave.sources import files
from tidewave.storage import shared_path

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 6):
    return F.round(c, n)


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


_LCG = "((({k} % 2147483647) * 1103515245 + {seed}) % 2147483648)"


# -- aggregates, windows, samples --------------------------------------------------------------------------------------

@query("select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value) / sqrt(count(value)), 6) as sem from events group by 1")
def a16_standard_errors(spark: SparkSession, d: str) -> DataFrame:
    return stats.standard_errors(events(spark, d), ["event_type"], "value").select("event_type", "n", _r("mean").alias("mean"), _r("sem").alias("sem"))


@query(f"select event_id, event_type from (select *, row_number() over (partition by event_type order by {_LCG.format(k='event_id', seed=12345)}, event_id) as rn from events) where rn <= 10")
def a24_sample(spark: SparkSession, d: str) -> DataFrame:
    return win.sample_per_group(events(spark, d), ["event_type"], "event_id", 10).select("event_id", "event_type")


@query("select event_id, count(case when event_type = 'purchase' then 1 end) over (partition by user_id order by event_id rows unbounded preceding) as group_no from events")
def w7_groups(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("bought", F.when(F.col("event_type") == "purchase", 1))
    return joins.running_groups(e, ["user_id"], "event_id", "bought").select("event_id", "group_no")


@query("select event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as position from events")
def w10_position(spark: SparkSession, d: str) -> DataFrame:
    return win.position(events(spark, d), ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id", F.col("position").cast("bigint").alias("position"))


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events) where rn = 1")
def o12_first(spark: SparkSession, d: str) -> DataFrame:
    return win.drop_duplicates_keep_first(events(spark, d), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query(f"select event_id from events where {_LCG.format(k='event_id', seed=12345)} < cast(0.25 * 2147483648 as bigint)")
def o11_sample(spark: SparkSession, d: str) -> DataFrame:
    return win.bernoulli(events(spark, d), "event_id", 0.25).select("event_id")


@query("""with h as (select event_id, sha256('E' || event_id) as h from events)
select event_id, list_reduce(list_prepend(cast(0 as bigint), list_transform(range(16), lambda i: cast('0x' || substring(h, cast(4 * i + 1 as bigint), 4) as bigint))), lambda a, b: (a * 65536 + b) % 7) as shard from h""")
def o15_shard(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", win.shard(F.concat(F.lit("E"), F.col("event_id").cast("string")), 7).cast("bigint").alias("shard"))


@query("select event_id, round((value - min(value) over ()) / (max(value) over () - min(value) over ()), 9) as part, round(-1 * value, 6) as flipped, value > 20 as high from events")
def m13_rescaled(spark: SparkSession, d: str) -> DataFrame:
    e = stats.rescaled(events(spark, d), "value", "part")
    return e.select("event_id", _r("part", 9).alias("part"), _r(-F.col("value")).alias("flipped"), (F.col("value") > 20).alias("high"))


@query("select event_id, round((value - avg(value) over (partition by event_type)) / stddev_samp(value) over (partition by event_type), 6) as z, round(case when p > 0 and p < 1 then ln(p / (1 - p)) end, 6) as odds from (select *, value / 200 as p from events)")
def f14_scaled(spark: SparkSession, d: str) -> DataFrame:
    e = stats.standardized(events(spark, d), ["event_type"], "value", "z")
    return e.select("event_id", _r("z").alias("z"), _r(tx.log_odds(F.col("value") / 200)).alias("odds"))


# -- text --------------------------------------------------------------------------------------------------------------

@query(r"select doc_id, len(list_filter(regexp_split_to_array(trim(lower(text), ' '), '\s+'), lambda w: w in ('the', 'virus', 'school'))) as n from documents where text is not null")
def f17_listed_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.list_count(F.col("text"), ["the", "virus", "school"]).cast("bigint").alias("n"))


@query(r"""with n as (select distinct raw_show_name as name from radio_snippet where raw_show_name is not null)
select name, array_to_string(list_transform(string_split(name, ' '), lambda w: case when length(w) >= 2 and upper(w) = w then array_to_string(list_filter(string_split(lower(w), ''), lambda c: c <> ''), '._') || '.' else replace(lower(w), ',', '') end), ' ') as form from n""")
def f19_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "radio_snippet").select(F.col("raw_show_name").alias("name")).where("name is not null").distinct()
    return n.select("name", tx.normal_form(F.col("name")).alias("form"))


@query("""with t as (select doc_id, replace(replace(text, ' of ', '_of_'), ' the ', ' the_') as t from documents where text is not null)
select doc_id, md5(array_to_string(list_transform(string_split(t, ' '), lambda w: case when contains(w, '_') and w not in ('the_mayor', 'all_of_them') then array_to_string(string_split(w, '_'), ' ') else w end), ' ')) as md5 from t""")
def f28_split_compounds(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").withColumn("t", F.replace(F.replace("text", F.lit(" of "), F.lit("_of_")), F.lit(" the "), F.lit(" the_")))
    return t.select("doc_id", F.md5(tx.split_unknown_compounds(F.col("t"), ["the_mayor", "all_of_them"])).alias("md5"))


@query("""with f as (select distinct 'state_code=S' || state_id as facet from radio_station where state_id is not null union select distinct 'diary_band=' || coalesce(diary_band, 'x') from radio_snippet union select distinct 'diary_gender=' || diary_gender from radio_snippet where diary_gender is not null union select 'top_of_hour')
select facet, case when facet = 'state_code=S3' then 'Three' when facet like 'state_code=%' then substring(facet, 12) when facet = 'diary_gender=F' then 'All clips with predicted gender Female' when facet like 'diary_gender=%' then 'All clips with predicted gender Male'
when facet = 'diary_band=T' then 'All clips with telephone speech' when facet = 'diary_band=S' then 'All clips with studio speech' when facet like 'diary_band=%' then 'All clips with Unclassified speech' else replace(facet, '_', ' ') end as display from f""")
def f31_facets(spark: SparkSession, d: str) -> DataFrame:
    sn = table(spark, d, "radio_snippet")
    of = lambda name, c: F.concat(F.lit(f"{name}="), c).alias("facet")
    f = table(spark, d, "radio_station").where("state_id is not null").select(of("state_code", F.concat(F.lit("S"), F.col("state_id").cast("string"))))
    f = f.union(sn.select(of("diary_band", F.coalesce("diary_band", F.lit("x"))))).union(sn.where("diary_gender is not null").select(of("diary_gender", F.col("diary_gender")))).union(spark.range(1).select(F.lit("top_of_hour")))
    return f.distinct().select("facet", tx.facet_display(F.col("facet"), {"S3": "Three"}).alias("display"))


@query("select station_id from radio_station where band = 'AM' or std_owner = 'Junudran Transit'")
def f31_station_group(spark: SparkSession, d: str) -> DataFrame:
    groups = {"mine": ["band=AM", "std_owner=Junudran Transit", "unknown=1"]}
    return table(spark, d, "radio_station").where(tx.group_filter("mine", groups, ["band", "std_owner"])).select("station_id")


@query("""with s as (select distinct snippet_id, diary_band, show_id, insert_dt from radio_snippet)
select snippet_id, round((case when diary_band = 'T' then 2 else 0 end + case when show_id is null then 1 else 0 end) * 1e8 + epoch_us(insert_dt) / 1e12, 6) as score from s""")
def f32_scores(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "radio_snippet").select("snippet_id", "diary_band", "show_id", "insert_dt").distinct()
    return s.select("snippet_id", _r(tx.search_score(F.col("diary_band"), F.when(F.col("show_id").isNull(), "unique"), F.col("insert_dt"))).alias("score"))


@query("""with c as (select distinct cast(floor(abs(latitude)) as bigint) as a, cast(floor(abs(latitude) * 60) % 60 as bigint) as b, cast(floor(abs(latitude) * 3600) % 60 as bigint) as c, latitude < 0 as south from stg_station_map where latitude is not null)
select a || '-' || b || '-' || c || case when south then ' S' else ' N' end as place, round((a + b / 60.0 + c / 3600.0) * case when south then -1 else 1 end, 9) as degrees from c""")
def f33_degrees(spark: SparkSession, d: str) -> DataFrame:
    lat = F.abs("latitude")
    part = lambda k: (F.floor(lat * k) % 60).cast("string") if k > 1 else F.floor(lat).cast("string")
    m = table(spark, d, "stg_station_map").where("latitude is not null")
    place = F.concat(F.concat_ws("-", part(1), part(60), part(3600)), F.when(F.col("latitude") < 0, " S").otherwise(" N"))
    return m.select(place.alias("place")).distinct().select("place", _r(tx.degrees(F.col("place")), 9).alias("degrees"))


@query("select distinct show_source, case when show_source = 'schedule' then 0.5 when starts_with(show_source, 'man') then 0.9 else 0.1 end as confidence from radio_snippet")
def f35_source_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "radio_snippet").select("show_source").distinct()
    return s.select("show_source", tx.source_confidence(F.col("show_source"), {"schedule": 0.5}, {"man": 0.9}, 0.1).alias("confidence"))


@query("""select event_id, case when a >= 0.05 and b >= 0.05 then 'Neither' when a < 0.05 and b < 0.05 then 'T <-> R' when a < 0.05 then 'T -> R' when b < 0.05 then 'R -> T' end as effect from (select event_id, (event_id % 20) / 100.0 as a, (event_id % 13) / 100.0 as b from events)""")
def f38_effects(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", tx.effect_type(F.col("event_id") % 20 / 100.0, F.col("event_id") % 13 / 100.0).alias("effect"))


@query(r"""with w as (select unnest(list_filter(regexp_split_to_array(trim(text, ' '), '\s+'), lambda w: w <> '')) as form from documents) select lower(form) as norm, form, count(*) as n from w group by 1, 2""")
def f22_casing(spark: SparkSession, d: str) -> DataFrame:
    return tx.casing_counts(table(spark, d, "documents"), "text")


# -- joins -------------------------------------------------------------------------------------------------------------

@query("""with a as (select user_id, count(*) as n_view from events where event_type = 'view' group by 1), b as (select user_id, count(*) as n_click from events where event_type = 'click' group by 1), c as (select user_id, max(value) as top from events where event_type = 'error' group by 1)
select coalesce(a.user_id, b.user_id, c.user_id) as user_id, n_view, n_click, top from a full join b on a.user_id = b.user_id full join c on c.user_id = coalesce(a.user_id, b.user_id)""")
def j18_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Also J5: tables of metrics side by side, every key kept."""
    of = lambda kind: events(spark, d).where(F.col("event_type") == kind).groupBy("user_id")
    return joins.full_outer([of("view").agg(F.count("*").alias("n_view")), of("click").agg(F.count("*").alias("n_click")), of("error").agg(F.max("value").alias("top"))], ["user_id"])


@query("select distinct station_id, case band when 'AM' then 'amplitude' when 'FM' then 'frequency' else 'other' end as band, substring(station_format, 1, 1) as letter from radio_station")
def mapped_p12(spark: SparkSession, d: str) -> DataFrame:
    s = joins.map_values(table(spark, d, "radio_station"), "band", {"AM": "amplitude", "FM": "frequency"}, "other")
    return s.select("station_id", "band", F.substring("station_format", 1, 1).alias("letter")).distinct()


# -- stories and graphs ------------------------------------------------------------------------------------------------

_MEMBERS = "m as (select vec_id as node, vec_id % 40 // 4 as component, vec_id % 40 as community, case when label % 2 = 0 then 'elite' else 'radio' end as kind from embeddings)"


def members(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with a component of several communities each, of two kinds."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("node"), F.floor(F.col("vec_id") % 40 / 4).alias("component"), (F.col("vec_id") % 40).alias("community"), F.when(F.col("label") % 2 == 0, "elite").otherwise("radio").alias("kind"))


@query(f"with {_MEMBERS} select node, component from m where component in (select component from m group by 1 having count(*) >= 40)")
def n6_large_components(spark: SparkSession, d: str) -> DataFrame:
    return graphs.large_components(members(spark, d).select("node", "component"), 40).select("node", "component")


@query(f"""with {_MEMBERS}, s as (select kind, component, count(distinct node) as size from m group by 1, 2), g as (select distinct kind, component, community, size from m join s using (kind, component)),
r as (select kind, component, community, dense_rank() over (partition by kind order by size desc, component, community) - 1 as group_no from g) select node, kind, group_no from m join r using (kind, component, community)""")
def n8_numbered(spark: SparkSession, d: str) -> DataFrame:
    return stories.numbered(members(spark, d), ["kind"]).select("node", "kind", F.col("group_no").cast("bigint").alias("group_no"))


@query(f"with {_MEMBERS}, s as (select kind, community, count(*) as c from m group by 1, 2) select kind, cast(sum(c) as bigint) as n_before, count(*) as n_after, cast(sum(c) as bigint) - count(*) as n_merged, max(c) as largest from s group by 1")
def n11_merges(spark: SparkSession, d: str) -> DataFrame:
    return stories.merge_report(members(spark, d).select("kind", F.col("community").alias("merged_into")), ["kind"])


@query("""with p as (select list_transform(embedding, lambda x: cast(x as double)) as e, vec_id from embeddings) select vec_id, round(list_cosine_similarity(e, list_transform(range(64), lambda i: cast((i % 3) - 1 as double))), 6) as probe_sim from p""")
def n12_probe(spark: SparkSession, d: str) -> DataFrame:
    return stories.probe_similarity(table(spark, d, "embeddings"), "embedding", [float(i % 3 - 1) for i in range(64)]).select("vec_id", _r("probe_sim").alias("probe_sim"))


@query("""with c as (select distinct user_id, user_id % 4 as community from twitter_tweet), i as (select snippet_id as id, 'radio' as kind, cast(null as bigint) as user_id, station_id % 3 = 0 as is_public from (select distinct snippet_id, station_id from radio_snippet)
union all select tweet_id, 'elite', case when tweet_id % 5 = 0 then -1 else user_id end, null from (select distinct tweet_id, user_id from twitter_tweet))
select id, kind, case when case when kind = 'radio' then not is_public else coalesce(community = 3, false) end then 'conservative' else 'liberal' end as side from i left join c using (user_id)""")
def n18_sides(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "twitter_tweet").select("tweet_id", "user_id").distinct()
    radio = table(spark, d, "radio_snippet").select("snippet_id", "station_id").distinct().select(F.col("snippet_id").alias("id"), F.lit("radio").alias("kind"), F.lit(None).cast("bigint").alias("user_id"), (F.col("station_id") % 3 == 0).alias("is_public"))
    posts = t.select(F.col("tweet_id").alias("id"), F.lit("elite").alias("kind"), F.when(F.col("tweet_id") % 5 == 0, -1).otherwise(F.col("user_id")).alias("user_id"), F.lit(None).cast("boolean").alias("is_public"))
    known = t.select("user_id").distinct().withColumn("community", F.col("user_id") % 4)
    return stories.ideology(radio.unionByName(posts), known, 3).select("id", "kind", "side")


@query(f"with {_MEMBERS}, g as (select node, node // 7 as grp from m), l as (select node, community // 10 as community from m) select grp as \"group\", min(community) as community from g join l using (node) group by 1 having min(community) = max(community)")
def g10_agreed(spark: SparkSession, d: str) -> DataFrame:
    m = members(spark, d)
    return graphs.agreed_communities(m.select("node", F.floor(F.col("community") / 10).alias("community")), m.select("node", F.floor(F.col("node") / 7).alias("group")))


@query(f"""with recursive e0 as ({analysis._EDGES}), u as (select distinct least(source, target) as a, greatest(source, target) as b from e0 where source <> target), n as (select a as node, b as other from u union all select b, a from u),
d as (select node, count(*) as degree from n group by 1), t as (select x.a, x.b, y.b as c from u x join u y on x.b = y.a join u z on z.a = x.a and z.b = y.b), tt as (select unnest([a, b, c]) as node from t), c as (select node, count(*) as n from tt group by 1),
k as (select node, degree, coalesce(n, 0) as t, case when degree > 1 then coalesce(n, 0) * 2.0 / (degree * (degree - 1)) else 0 end as clustering from d left join c using (node)),
r as (select node, node as seen from (select node from d order by node limit 1) union select r.node, n.other from r join n on n.node = r.seen)
select count(*) as n_nodes, cast(sum(degree) / 2 as bigint) as n_edges, round(avg(degree), 6) as mean_degree, round(sum(t) / sum(degree * (degree - 1) / 2.0), 6) as transitivity, round(avg(clustering), 6) as mean_clustering, (select count(*) from r) = count(*) as connected from k""")
def g13_summary(spark: SparkSession, d: str) -> DataFrame:
    s = graphs.summary(analysis.supplier_edges(spark, d))
    return s.select("n_nodes", "n_edges", _r("mean_degree").alias("mean_degree"), _r("transitivity").alias("transitivity"), _r("mean_clustering").alias("mean_clustering"), (F.col("n_components") == 1).alias("connected"))


# -- events in time ----------------------------------------------------------------------------------------------------

@query("select event_id, cast(value > 100 as int) as high, cast(contains(props, '\"k\": 8') as int) as eights from events")
def t1_matches(spark: SparkSession, d: str) -> DataFrame:
    return ticks.matched(events(spark, d), {"high": F.col("value") > 100, "eights": F.col("props").contains('"k": 8')}).select("event_id", "high", "eights")


@query("select show_id as story, count(*) as n, round(avg(coalesce(cast(regexp_matches(content, 'mayor|council') as int), 0)), 9) as city, round(avg(coalesce(cast(regexp_matches(content, 'school') as int), 0)), 9) as school from (select distinct snippet_id, show_id, content from radio_snippet) group by 1")
def t12_event_rates(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "radio_snippet").select("snippet_id", F.col("show_id").alias("story"), "content").distinct()
    return ticks.event_rates(items, "story", "content", {"city": "mayor|council", "school": "school"}).select("story", "n", _r("city", 9).alias("city"), _r("school", 9).alias("school"))


_SERIES = "s as (select event_type, cast(floor(epoch_us(ts) / 1e6 / 21600) as bigint) as b, count(*) as n from events group by 1, 2), x as (select *, n - avg(n) over (partition by event_type) as v, row_number() over (partition by event_type order by b) as t from s)"


@query(f"with {_SERIES}, z as (select event_type, sum(v * v) as q, count(*) as len from x group by 1) select a.event_type, cast(k as int) as lag, round(sum(a.v * b.v) / any_value(q), 6) as acf from range(25) r(k) join x a on true join x b on b.event_type = a.event_type and b.t = a.t + k join z on z.event_type = a.event_type where k < len group by 1, 2")
def t9_autocorrelations(spark: SparkSession, d: str) -> DataFrame:
    return series.correlograms(analysis._hourly(spark, d), "event_type", "bucket", "n", 24).select("event_type", "lag", _r("acf").alias("acf"))


# -- models ------------------------------------------------------------------------------------------------------------

@query("select vec_id % 4 as label_index, 't' || vec_id as term, round(cast(embedding[1] as double), 6) as coef from (select *, row_number() over (partition by vec_id % 4 order by cast(embedding[1] as double) desc, vec_id) as u, row_number() over (partition by vec_id % 4 order by cast(embedding[1] as double), vec_id) as w from embeddings) where u <= 5 or w <= 5")
def o3_extremes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "embeddings").select((F.col("vec_id") % 4).alias("label_index"), F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("term"), F.get("embedding", F.lit(0)).cast("double").alias("coef"))
    return models.extremes(c, 5).select("label_index", "term", _r("coef").alias("coef"))


@query("select 'user_id' as term, round(regr_slope(value, user_id), 5) as coef, round(regr_r2(value, user_id), 6) as r2 from events")
def m10_regression(spark: SparkSession, d: str) -> DataFrame:
    e = models.dense(events(spark, d).select(F.col("user_id"), F.col("value").cast("double").alias("value")), ["user_id"])
    m = models.regressor(e, "value")
    r2 = models.r_squared(m.transform(e), "value", "prediction")
    return models.coefficients(m, spark, ["user_id"]).select("term", _r("coef", 5).alias("coef")).join(r2.select(_r("r2").alias("r2")), F.lit(True))


_JUDGED = "j as (select event_type as label, case when user_id % 3 = 0 then 'view' else event_type end as prediction from events)"


@query(f"with {_JUDGED} select label, prediction, count(*) as n from j group by 1, 2")
def m11_confusion(spark: SparkSession, d: str) -> DataFrame:
    return models.confusion(_predicted(spark, d), "label", "prediction")


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("event_type").alias("label"), F.when(F.col("user_id") % 3 == 0, "view").otherwise(F.col("event_type")).alias("prediction"))


@query(f"with {_JUDGED}, a as (select label, count(*) as support, sum(cast(label = prediction as int)) as hits from j group by 1), b as (select prediction as label, count(*) as predicted from j group by 1) select label, round(hits / predicted, 9) as precision, round(hits / support, 9) as recall, round(2 * (hits / predicted) * (hits / support) / (hits / predicted + hits / support), 9) as f1, support from a left join b using (label)")
def m11_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    p = models.precision_recall(_predicted(spark, d), "label", "prediction")
    return p.select("label", _r("precision", 9).alias("precision"), _r("recall", 9).alias("recall"), _r("f1", 9).alias("f1"), "support")


@query("""with s as (select event_type = 'view' as y, value as x from events), r as (select *, avg(rn) over (partition by x) as rank from (select *, row_number() over (order by x) as rn from s))
select round((sum(rank) filter (where y) - count(*) filter (where y) * (count(*) filter (where y) + 1) / 2) / (count(*) filter (where y) * count(*) filter (where not y)), 9) as auc from r""")
def m11_auc(spark: SparkSession, d: str) -> DataFrame:
    return models.auc(events(spark, d).select((F.col("event_type") == "view").cast("int").alias("y"), "value"), "y", "value").select(_r("auc", 9).alias("auc"))


_TERMS = r"""b as (select doc_id, translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') as t from documents where text is not null and lang = 'en'), w as (select doc_id, regexp_extract_all(t, '[\p{L}\p{N}_]{2,}') as w from b),
terms as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from w), df as (select term, count(distinct doc_id) as df from terms group by 1),
kept as (select term, df from df where df >= 5 and df <= 0.5 * (select count(*) from b) and term not in ('the mayor', 'school'))"""


@query(f"with {_TERMS} select term, round(ln((1 + (select count(*) from b)) / (1 + df)) + 1, 9) as idf from (select * from kept order by df desc, term limit 2000)")
def m12_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the documents without a list of excluded ones."""
    return _vocabulary(spark, d).select("term", _r("idf", 9).alias("idf"))


def _english(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null and lang = 'en'")


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    excluded = spark.createDataFrame([("the mayor",), ("school",)], "term string")
    return models.vocabulary(_english(spark, d), "text", 5, 0.5, excluded, 2000)


@query(f"with {_TERMS}, v as (select term, ln((1 + (select count(*) from b)) / (1 + df)) + 1 as idf from (select * from kept order by df desc, term limit 2000)), c as (select doc_id, term, (1 + ln(count(*))) * any_value(idf) as w from terms join v using (term) group by 1, 2) select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from c")
def m9_weights(spark: SparkSession, d: str) -> DataFrame:
    v = _vocabulary(spark, d)
    return models.tf_idf(_english(spark, d), "doc_id", "text", v).join(v.select("index", "term"), "index").select("doc_id", "term", _r("weight").alias("weight"))


# -- segments and files ------------------------------------------------------------------------------------------------

@query("""with s as (select distinct snippet_id, content from radio_snippet) select snippet_id, snippet_id % 4 = 0 as has_whisper, case when snippet_id % 4 = 0 then 'W' || snippet_id else content end as content from s""")
def u7_transcripts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "radio_snippet").select("snippet_id", "content").distinct()
    newer = s.where("snippet_id % 4 = 0").select("snippet_id", F.concat(F.lit("W"), F.col("snippet_id").cast("string")).alias("text"))
    return segments.with_transcripts(s, newer, "snippet_id").select("snippet_id", "has_whisper", "content")


@query("select event_id, user_id, event_type, props from events")
def s2_delimited(spark: SparkSession, d: str) -> DataFrame:
    """Written as compressed delimited text and read back."""
    path = shared_path(spark, "delimited")
    files.write_delimited(events(spark, d).select("event_id", "user_id", "event_type", "props"), path, sep="\t")
    return files.read_delimited(spark, path, "event_id bigint, user_id bigint, event_type string, props string", sep="\t")


@query("select line_id, json_extract_string(line_json, '$.callsign') as callsign, cast(json_extract(line_json, '$.segment_idx') as int) as segment_idx from snippet_line")
def s4_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines written as text and read back with a schema."""
    path = shared_path(spark, "lines")
    l = table(spark, d, "snippet_line")
    l.select(F.to_json(F.struct("line_id", F.get_json_object("line_json", "$.callsign").alias("callsign"), F.get_json_object("line_json", "$.segment_idx").cast("int").alias("segment_idx")), {"ignoreNullFields": "false"})).write.text(path)
    return files.read_json_lines(spark, path, "line_id bigint, callsign string, segment_idx int").where("_corrupt is null").select("line_id", "callsign", "segment_idx")


_MINE = "mine as (select event_id, (epoch_us(ts) - min(epoch_us(ts)) over ()) / 1e6 as reltime from events where user_id in (3, 7))"


@query(f"with {_MINE} select * from (select event_id, round(reltime, 6) as reltime, 'first' as which from mine order by mine.reltime, event_id limit 10) union all select * from (select event_id, round(reltime, 6), 'sample' from mine order by {_LCG.format(k='event_id', seed=12345)}, event_id limit 10)")
def n20_example_items(spark: SparkSession, d: str) -> DataFrame:
    """What one shows of a story: its first items and a sample."""
    return _example(spark, d)[0].select("event_id", _r("reltime").alias("reltime"), "which")


def _example(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d).withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return stories.example(e, "user_id", [3, 7], "sec", "event_id", 10, 3600.0, 200)


@query(f"with {_MINE}, g as (select unnest(range(200)) as point), c as (select point, (select count(*) from mine where reltime <= point * 3600.0) / (select count(*) from mine) as value from g), n as (select *, lag(value) over (order by point) as b, lead(value) over (order by point) as a from c) select cast(point as int) as point, round(value, 9) as value, round(case when b is null then a - value when a is null then value - b else (a - b) / 2 end, 9) as density from n")
def n20_example_curve(spark: SparkSession, d: str) -> DataFrame:
    return _example(spark, d)[1].select("point", _r("value", 9).alias("value"), _r("density", 9).alias("density"))
