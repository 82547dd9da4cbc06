"""Queries of the text, time, graph, vector, statistics and geometry operators over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.functions import text as tx
from tidewave.operators import geometry, graphs, joins, models, places, segments, series, stats, stories, ticks, vectors
from tidewave.operators import windows as win
from tidewave.plans.tables import Query, table
from tidewave.sources import files

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 6):
    return F.round(c, n)


# -- text --------------------------------------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(r"""select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) as n_words, coalesce(len(regexp_split_to_array(text, '\s+')), 0) as n_split,
  length(text) as n_characters, regexp_replace(text, '[\n\r]+', ' ', 'g') = text as one_line from documents where text is not null""")
def f1_lengths(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d).where("text is not null")
    return t.select("doc_id", F.size(tx.words(F.col("text"))).cast("bigint").alias("n_words"), tx.word_count(F.col("text")).cast("bigint").alias("n_split"), F.length("text").cast("bigint").alias("n_characters"), (tx.one_line(F.col("text")) == F.col("text")).alias("one_line"))


@query(rf"""select doc_id, base64(unhex(md5(array_to_string(list_transform(list_filter(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: w not in ({STOP})), lambda w: lower(w)), ' ')))) as hash
from documents where text is not null""")
def f21_approxhash(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where("text is not null").select("doc_id", tx.approxhash_tokens(F.col("text")).alias("hash"))


@query()
def f21_approxhash_chars(spark: SparkSession, d: str) -> DataFrame:
    """The hashes of every text; no SQL, as its characters and lower case are other ones beyond ASCII."""
    return docs(spark, d).where("text is not null").select("doc_id", tx.approxhash_chars(F.col("text")).alias("hash"))


@query(rf"""with w as (select doc_id, substring(array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'),
  lambda w: w <> '' and w <> '<unk>' and w not in ({STOP}) and not contains(w, '[') and length(w) > 2), lambda w: substring(w, 1, 4)), ''), 1, 32) as s from documents where text is not null)
select doc_id, case when s = '' then '0' else substring(sha256(s), 1, 8) end as signature from w""")
def f20_signature(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where("text is not null").select("doc_id", tx.signature(F.col("text")).alias("signature"))


@query(r"""select snippet_id, cast(contains(lower(content), 'listener') as int) + cast(contains(lower(content), 'caller') as int) as by_substring,
  len(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda w: w in ('mayor', 'council'))) as by_token, cast(regexp_matches(lower(content), 'vaccin|quarantin') as int) as by_regex
from (select distinct snippet_id, content from radio_snippet)""")
def f16_keywords(spark: SparkSession, d: str) -> DataFrame:
    sn = table(spark, d, "radio_snippet").select("snippet_id", "content").dropDuplicates(["snippet_id"])
    c = F.col("content")
    return sn.select("snippet_id", tx.keyword_hits(c, ["listener", "caller"]).alias("by_substring"), tx.keyword_hits(c, ["mayor", "council"], "token").cast("bigint").alias("by_token"), tx.keyword_hits(c, ["vaccin", "quarantin"], "regex").alias("by_regex"))


@query(r"""with w as (select unnest(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda w: w <> '')) as word from (select distinct snippet_id, content from radio_snippet)),
c as (select word, count(*) as n from w group by 1) select word, n from c where n >= 0.001 * (select sum(n) from c)""")
def f24_frequent_words(spark: SparkSession, d: str) -> DataFrame:
    sn = table(spark, d, "radio_snippet").select("snippet_id", "content").dropDuplicates(["snippet_id"])
    return tx.frequent_words(sn, "content")


@query(r"""with s as (select snippet_id, list_filter(regexp_split_to_array(lower(content), '\s+'), lambda w: w <> '') as w from (select distinct snippet_id, content from radio_snippet)),
one as (select word, count(*) as n from (select unnest(w) as word from s) group by 1), t as (select cast(sum(n) as double) as t from one),
two as (select a, b, count(*) as n from (select unnest(list_zip(w[:-2], w[2:])) as p from s where len(w) > 1) cross join lateral (select p[1] as a, p[2] as b) group by 1, 2 having count(*) >= 50)
select a, b, two.n as n, round(ln(two.n / t / (x.n / t * y.n / t)) / -ln(two.n / t), 6) as score from two join one x on x.word = a join one y on y.word = b cross join t
where ln(two.n / t / (x.n / t * y.n / t)) / -ln(two.n / t) >= 0.75""")
def f26_phrases(spark: SparkSession, d: str) -> DataFrame:
    sn = table(spark, d, "radio_snippet").select("snippet_id", "content").dropDuplicates(["snippet_id"])
    return tx.phrases(sn, "content").withColumn("score", _r("score"))


@query(r"""with s as (select snippet_id, ' ' || array_to_string(list_filter(regexp_split_to_array(trim(lower(content), ' '), '\s+'), lambda w: w <> ''), '  ') || ' ' as t from (select distinct snippet_id, content from radio_snippet))
select snippet_id, trim(replace(replace(replace(replace(t, ' radio  group ', ' radio_group '), ' health  board ', ' health_board '), ' farm  union ', ' farm_union '), '  ', ' '), ' ') as content from s""")
def f27_joined_phrases(spark: SparkSession, d: str) -> DataFrame:
    sn = table(spark, d, "radio_snippet").select("snippet_id", "content").dropDuplicates(["snippet_id"])
    return sn.select("snippet_id", tx.join_phrases(F.lower("content"), [("radio", "group"), ("health", "board"), ("farm", "union")]).alias("content"))


@query()
def f23_display_text(spark: SparkSession, d: str) -> DataFrame:
    show = tx.displayer({"health board": "Health Board", "radio group": "Radio Group", "council": "Council"})
    sn = table(spark, d, "radio_snippet").select("snippet_id", "content").dropDuplicates(["snippet_id"])
    return sn.select("snippet_id", show("content").alias("display"), tx.repair_acronyms(F.col("content")).alias("repaired"))


@query(r"""with t as (select activity_id, any_value(body) as body, any_value(long_body) as long_body, any_value(object_body) as object_body from elite_tweet_2022 group by 1),
l as (select activity_id, list_filter([long_body, object_body, body], lambda b: b is not null) as b from t), m as (select *, list_filter(b, lambda x: not contains(x, '…') and not ends_with(x, '...')) as w, list_max(list_transform(b, lambda x: length(x))) as n from l)
select activity_id, coalesce(w[1], list_filter(b, lambda x: length(x) = n)[1]) as body from m""")
def f7_best_body(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "elite_tweet_2022").dropDuplicates(["activity_id"])
    return t.select("activity_id", tx.best_body(F.array("long_body", "object_body", "body")).alias("body"))


@query(r"""select event_id, cast(json_extract(props, '$.k') as int) as k, isodow(ts) * 1440 - 1440 + hour(ts) * 60 + minute(ts) as minute, 'https://x.example/play?k=' || cast(json_extract(props, '$.k') as int) || '&t=' || event_type as url,
'2024-' || event_type || '-' || user_id as story from events""")
def f_scalars(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", k.alias("k"), tx.minute_of_week(F.col("ts")).cast("bigint").alias("minute"), tx.url("https://x.example/play", k=k, t=F.col("event_type")).alias("url"), tx.story_id(F.lit(2024), F.col("event_type"), F.col("user_id")).alias("story"))


@query(r"""with s as (select distinct snippet_id, lower(content) as c from radio_snippet) select snippet_id, contains(' ' || c || ' ', ' school ') or contains(' ' || c || ' ', ' mayor ') as hit from s""")
def f30_query_match(spark: SparkSession, d: str) -> DataFrame:
    sn = table(spark, d, "radio_snippet").select("snippet_id", "content").dropDuplicates(["snippet_id"])
    return sn.select("snippet_id", tx.matches_query(F.col("content"), F.lit("school, mayor")).alias("hit"))


@query(r"""with s as (select snippet_id, list_filter(regexp_split_to_array(lower(regexp_replace(content, '[^0-9A-Za-z''_.@% ]', '', 'g')), ' +'), lambda x: x <> '') as w from (select distinct snippet_id, content from radio_snippet)),
p as (select snippet_id, w, list_transform(range(1, greatest(len(w), 1) + 1), lambda i: len(list_filter(range(1, 15), lambda k: left(array_to_string(w[i:i + 14], ' '), k) = left('the mayor said', k)))) as n from s)
select snippet_id, array_to_string(w[greatest(list_position(n, list_max(n)) - 2, 1):list_position(n, list_max(n)) + 2], ' ') as "window" from p""")
def f29_match_window(spark: SparkSession, d: str) -> DataFrame:
    sn = table(spark, d, "radio_snippet").select("snippet_id", "content").dropDuplicates(["snippet_id"])
    return sn.select("snippet_id", tx.match_window(F.col("content"), F.lit("the mayor said")).alias("window"))


# -- sources -----------------------------------------------------------------------------------------------------------

@query(r"""select line_id, json_extract_string(line_json, '$.audio_key') as audio_key, json_extract_string(line_json, '$.callsign') as callsign from snippet_line""")
def s3_json_columns(spark: SparkSession, d: str) -> DataFrame:
    out, _ = files.json_lines_to_columns(table(spark, d, "snippet_line"), "line_json", strict=False)
    return out.select("line_id", "audio_key", "callsign")


@query("select 'snippet_id not null' as \"constraint\", count(*) filter (where snippet_id is null) as n from radio_snippet union all select 'unique snippet_id', (select count(*) from (select snippet_id from radio_snippet group by 1 having count(*) > 1)) union all select 'check confidence', count(*) filter (where not (mean_word_confidence between 0 and 1)) from radio_snippet union all select 'station_id references station_id', count(*) filter (where station_id not in (select station_id from radio_station)) from radio_snippet")
def s18_constraints(spark: SparkSession, d: str) -> DataFrame:
    return files.violations(table(spark, d, "radio_snippet"), ["snippet_id"], [["snippet_id"]], {"confidence": F.col("mean_word_confidence").between(0, 1)}, [("station_id", table(spark, d, "radio_station"), "station_id")])


@query("select audio_key, string_split(audio_key, '/')[1] as prefix, case when len(string_split(audio_key, '/')) > 3 then string_split(audio_key, '/')[4] else 'unknown' end as station from (select distinct audio_key from radio_snippet)")
def s16_key_parts(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "radio_snippet").select("audio_key").distinct()
    return k.select("audio_key", F.get(F.split("audio_key", "/"), F.lit(0)).alias("prefix"), files.key_station(F.col("audio_key")).alias("station"))


# -- time --------------------------------------------------------------------------------------------------------------

WIDTHS = ["15 minutes", "6 hours", "1 day"]


def _ticks_sql(width: str) -> str:
    b = f"time_bucket(interval {width}, ts)"
    spine = f"(select unnest(generate_series((select min({b}) from e), (select max({b}) from e), interval {width})) as bucket)"
    return (
        f"select '{width}' as width, bucket, null as event_type, coalesce(n, 0) as n, coalesce(v, 0) as big from {spine} left join (select {b} as bucket, count(*) as n, cast(sum(v) as bigint) as v from e group by 1) using (bucket) "
        f"union all select '{width}', {b}, event_type, count(*), cast(sum(v) as bigint) from e group by 2, 3"
    )


@query("with e as (select ts, event_type, cast(value > 50 as int) as v from events) " + " union all ".join(map(_ticks_sql, WIDTHS)))
def t2_ticks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("big", (F.col("value") > 50).cast("int"))
    return ticks.ticks(e, "ts", ["big"], list(WIDTHS), ["event_type"])


@query("""select e.event_id, v.event, round(epoch_us(e.ts) / 1e6 - epoch_us(v.moment) / 1e6, 3) as rel_s from events e, (values ('a', timestamp '2024-01-05 12:00:00'), ('b', timestamp '2024-01-20 00:00:00')) v(event, moment)
where e.ts >= v.moment - interval 6 hours and e.ts <= v.moment + interval 3 days""")
def t4_around_events(spark: SparkSession, d: str) -> DataFrame:
    ev = spark.createDataFrame([("a", "2024-01-05 12:00:00"), ("b", "2024-01-20 00:00:00")], "event string, at string").withColumn("at", F.col("at").cast("timestamp"))
    return ticks.around_events(table(spark, d, "events"), ev, "ts", 6 * 3600, 3 * 86400).select("event_id", "event", _r("rel_s", 3).alias("rel_s"))


@query("""with e as (select event_type, user_id as w, value as x from events where user_id > 0), p as (select event_type, x from e, range(w) r(i))
select event_type, count(*) as n, round(avg(x), 5) as mean, round(stddev_samp(x), 5) as sd, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 5) as iqr from p group by 1""")
def t5_weighted_moments(spark: SparkSession, d: str) -> DataFrame:
    m = ticks.weighted_moments(table(spark, d, "events"), ["event_type"], "value", "user_id")
    return m.select("event_type", "n", _r("mean", 5).alias("mean"), _r("sd", 5).alias("sd"), _r("iqr", 5).alias("iqr"))


@query("""with e as (select event_type, epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) over (partition by event_type) as x from events),
g as (select event_type, count(*) as n, list(x) as xs from e group by 1)
select event_type, cast(i as int) as point, round(len(list_filter(xs, lambda x: x <= i * 21600)) / n, 9) as value from g, range(120) r(i)""")
def t6_ecdf(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    from pyspark.sql import Window

    rel = e.withColumn("rel", F.col("sec") - F.min("sec").over(Window.partitionBy("event_type")))
    return ticks.ecdf(rel, ["event_type"], "rel", 21600.0, 120).select("event_type", "point", _r("value", 9).alias("value"))


@query("""with c as (select user_id, cast(day as int) as day, n from (select user_id, dayofmonth(ts) as day, count(*) as n from events group by 1, 2)),
w as (select *, lag(n) over (partition by user_id order by day) as b, lead(n) over (partition by user_id order by day) as a from c)
select user_id, day, round(case when b is null then a - n when a is null then n - b else (a - b) / 2.0 end, 6) as gradient from w""")
def w11_gradient(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    return win.gradient(c, ["user_id"], "day", "n").select("user_id", "day", _r("gradient").alias("gradient"))


@query("""with e as (select event_type, epoch_us(ts) as t, event_id from events), w as (select *, min(t) over (partition by event_type) as a, max(t) over (partition by event_type) as b, count(*) over (partition by event_type) as n from e)
select event_id, t - a as from_start, b - a as span, n as n_items, round((t - a) / (b - a), 9) as part from w""")
def w9_relative(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return win.relative_to_group(e, ["event_type"], "t").select("event_id", "from_start", "span", "n_items", _r("part", 9).alias("part"))


# -- joins -------------------------------------------------------------------------------------------------------------

@query("""with o as (select o_custkey as k, o_orderdate as day, o_orderkey as id from orders) select a.id as id1, b.id as id2 from o a join o b using (k) where a.id < b.id and abs(date_diff('day', a.day, b.day)) < 7""")
def j8_within_days(spark: SparkSession, d: str) -> DataFrame:
    return _orders_within_week(table(spark, d, "orders"))


def _orders_within_week(o: DataFrame) -> DataFrame:
    a = o.select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day1"), F.col("o_orderkey").alias("id1"))
    b = o.select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day2"), F.col("o_orderkey").alias("id2"))
    return joins.within_days(a, b, ["k"], "day1", "day2", 7).where("id1 < id2").select("id1", "id2")


@query("""with s as (select user_id, event_type, cast(ts as date) as day, min(epoch_us(ts) / 1e6) as s, max(epoch_us(ts) / 1e6) as e from events group by 1, 2, 3)
select a.user_id as user_id, a.event_type as event_type1, a.day as day1, b.event_type as event_type2, b.day as day2 from s a join s b on a.user_id = b.user_id and b.s < a.e and b.e > a.s where a.event_type < b.event_type or (a.event_type = b.event_type and a.day < b.day)""")
def j10_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Spans are named by what they are of, as numbering all of them would take one task."""
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    s = table(spark, d, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.min(sec).alias("s"), F.max(sec).alias("e"))
    side = lambda i: s.select("user_id", F.col("s").alias(f"start{i}"), F.col("e").alias(f"end{i}"), F.col("event_type").alias(f"event_type{i}"), F.col("day").alias(f"day{i}"))
    return joins.overlapping(side(1), side(2), ["user_id"], 21600.0, F.struct("event_type1", "day1") < F.struct("event_type2", "day2")).select("user_id", "event_type1", "day1", "event_type2", "day2")


_EDGES = "select distinct o_custkey as source, l_suppkey as target from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'P'"


def supplier_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers to the suppliers of their part-shipped orders, as a follow graph."""
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("source"))
    return table(spark, d, "lineitem").join(o, "l_orderkey").select("source", F.col("l_suppkey").alias("target")).distinct()


@query(f"""with e as ({_EDGES}) select x.source as a, y.source as b, count(*) as n_mutual from e x join e y using (target) where x.source < y.source group by 1, 2""")
def o7_mutual(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that share a neighbour, found through it; every other pair has 0."""
    return joins.cooccurring(supplier_edges(spark, d), "source", ["target"]).toDF("a", "b", "n_mutual")


@query(f"""with e as ({_EDGES}) select x.target as item1, y.target as item2, count(*) as n_groups from e x join e y using (source) where x.target < y.target group by 1, 2 having count(*) >= 3""")
def g6_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return joins.cooccurring(supplier_edges(spark, d), "target", ["source"], 3)


@query("""with s as (select distinct station_id, show_id, insert_dt from radio_snippet where show_id is not null),
sched as (select station_id as station, isodow(insert_dt) * 1440 - 1440 + hour(insert_dt) * 60 as a, show_id, count(*) / 100.0 as confidence, row_number() over (order by station_id, isodow(insert_dt) * 1440 - 1440 + hour(insert_dt) * 60, show_id) as row_no from s group by 1, 2, 3),
best as (select station, a, arg_max(show_id, confidence * 1000000 + row_no / 1000000.0) as "show" from sched group by 1, 2),
item as (select distinct snippet_id, station_id as station, isodow(insert_dt) * 1440 - 1440 + hour(insert_dt) * 60 + minute(insert_dt) as minute from radio_snippet)
select snippet_id, "show" from item left join best on best.station = item.station and best.a = item.minute - item.minute % 60""")
def j15_schedule(spark: SparkSession, d: str) -> DataFrame:
    sn = table(spark, d, "radio_snippet").select("snippet_id", "station_id", "show_id", "insert_dt").dropDuplicates(["snippet_id"])
    sched = sn.where("show_id is not null").select("station_id", "show_id", "insert_dt").distinct().groupBy(F.col("station_id").alias("station"), (F.weekday("insert_dt") * 1440 + F.hour("insert_dt") * 60).alias("from_minute"), F.col("show_id").alias("show")).agg((F.count("*") / 100.0).alias("confidence"))
    sched = sched.withColumn("row_no", F.col("show")).withColumn("until_minute", F.col("from_minute") + 60)
    items = sn.select("snippet_id", F.col("station_id").alias("station"), tx.minute_of_week(F.col("insert_dt")).alias("minute"))
    return joins.schedule_lookup(items, sched, "station", "minute").select("snippet_id", "show")


# -- graphs ------------------------------------------------------------------------------------------------------------

_RING = "ring as (select vec_id as a, (vec_id * 7 + 3) % 500 as b from embeddings)"


def ring_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each vector points to one other."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("source"), ((F.col("vec_id") * 7 + 3) % 500).alias("target"))


@query(f"with recursive {_RING}, e as (select a, b from ring where a <> b union select b, a from ring where a <> b), r as (select a as node, a as seen from e union select r.node, e.b from r join e on e.a = r.seen) select node, min(seen) as component from r group by 1")
def n5_components(spark: SparkSession, d: str) -> DataFrame:
    return graphs.components(ring_edges(spark, d))


@query(f"with recursive {_RING}, r as (select a as x, a as y from (select a from ring union select b from ring) union select r.x, e.b from r join ring e on e.a = r.y) select p.x as node, min(p.y) as component from r p join r q on p.x = q.y and p.y = q.x group by 1")
def g7_strong_components(spark: SparkSession, d: str) -> DataFrame:
    return graphs.strong_components(ring_edges(spark, d))


@query(f"with e as ({_EDGES}) select coalesce(a.source, b.target) as node, coalesce(o, 0) as out_degree, coalesce(i, 0) as in_degree from (select source, count(*) as o from e group by 1) a full join (select target, count(*) as i from e group by 1) b on a.source = b.target")
def g12_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graphs.degrees(supplier_edges(spark, d))


_UND = f"u as (select distinct least(source, target) as a, greatest(source, target) as b from ({_EDGES}) where source <> target)"


@query(f"""with {_UND}, n as (select a as node, b as other from u union all select b, a from u), d as (select node, count(*) as degree from n group by 1),
t as (select x.a, x.b, y.b as c from u x join u y on x.b = y.a join u z on z.a = x.a and z.b = y.b), tt as (select unnest([a, b, c]) as node from t), c as (select node, count(*) as n from tt group by 1)
select node, degree, coalesce(n, 0) as n_triangles, round(case when degree > 1 then coalesce(n, 0) * 2.0 / (degree * (degree - 1)) else 0 end, 9) as clustering from d left join c using (node)""")
def g12_triangles(spark: SparkSession, d: str) -> DataFrame:
    return graphs.triangles(supplier_edges(spark, d)).withColumn("clustering", _r("clustering", 9))


_PR = "".join(f", r{i + 1} as (select n.node, 0.15 / k + 0.85 * (coalesce(g.got, 0) + l.loose / k) as rank from n cross join k cross join (select coalesce(sum(rank), 0) as loose from r{i} where node not in (select source from e)) l left join (select e.target as node, sum(r.rank / o.outs) as got from e join o using (source) join r{i} r on r.node = e.source group by 1) g using (node))" for i in range(5))


@query(f"with e as ({_EDGES}), n as (select source as node from e union select target from e), k as (select cast(count(*) as double) as k from n), o as (select source, count(*) as outs from e group by 1), r0 as (select node, 1 / k as rank from n cross join k)" + _PR + " select node, round(rank, 9) as rank from r5")
def g12_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graphs.pagerank(supplier_edges(spark, d), 5).withColumn("rank", _r("rank", 9))


# A shortest path has fewer steps than the graph has nodes.
@query(f"""with recursive {_RING}, n as (select a from ring union select b from ring), r as (select a as source, a as node, 0 as distance from n
union select r.source, e.b, r.distance + 1 from r join ring e on e.a = r.node where r.distance < (select count(*) from n)) select source, node, min(distance) as distance from r group by 1, 2""")
def g15_distances(spark: SparkSession, d: str) -> DataFrame:
    e = ring_edges(spark, d)
    return graphs.distances(e, e.select(F.col("source").alias("node")).union(e.select("target")).distinct())


@query(f"with e as ({_EDGES}), g as (select distinct target as node, target % 5 as grp from e), m as (select grp, min(node) as name from g group by 1), f as (select node, name from g join m using (grp)) select distinct coalesce(a.name, source) as source, coalesce(b.name, target) as target from e left join f a on a.node = source left join f b on b.node = target where coalesce(a.name, source) <> coalesce(b.name, target)")
def g8_quotient(spark: SparkSession, d: str) -> DataFrame:
    e = supplier_edges(spark, d)
    g = e.select(F.col("target").alias("node")).distinct().withColumn("group", F.col("node") % 5)
    return graphs.quotient(e, g)


@query(f"with e as ({_EDGES}), o as (select distinct source as user_id, source % 7 as show_id from e union select distinct target, target % 7 from e) select a.show_id as source, b.show_id as target, count(*) as n from e join (select distinct * from o) a on a.user_id = source join (select distinct * from o) b on b.user_id = target group by 1, 2")
def g17_projection(spark: SparkSession, d: str) -> DataFrame:
    e = supplier_edges(spark, d)
    o = e.select(F.col("source").alias("user_id")).union(e.select("target")).distinct().withColumn("show_id", F.col("user_id") % 7)
    return graphs.projected(e, o)


@query("""with t as (select distinct tweet_id, user_id, retweeted_status_id, insert_dt from twitter_tweet) select user_id as source, retweeted_status_id % 50 as target, cast(extract(year from insert_dt) as int) as year, cast(extract(month from insert_dt) as int) as month, count(*) as n
from t where retweeted_status_id is not null group by 1, 2, 3, 4""")
def g3_retweets(spark: SparkSession, d: str) -> DataFrame:
    """Who reposts whom, by month; the reposted posts are not in the tables, so their author is read off the post's number."""
    t = table(spark, d, "twitter_tweet").select("tweet_id", "user_id", "retweeted_status_id", "insert_dt").dropDuplicates(["tweet_id"]).withColumn("whose", F.col("retweeted_status_id") % 50)
    return graphs.interactions(t, "insert_dt", "user_id", "whose")


_FOLLOWS = "f as (select o_custkey as source, l_suppkey as target, o_orderdate as fetched from orders join lineitem on l_orderkey = o_orderkey), tagged as (select s_suppkey as user_id from supplier)"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """The tagged users of the follow graph are the suppliers."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"))


def _follows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("source"), F.col("o_orderdate").alias("fetched"))
    return table(spark, d, "lineitem").join(o, "l_orderkey").select("source", F.col("l_suppkey").alias("target"), "fetched")


@query(f"with {_FOLLOWS}, l as (select source, max(fetched) as fetched from f group by 1) select distinct source, target from f join l using (source, fetched) where source in (from tagged) and target in (from tagged)")
def g1_follow_graph(spark: SparkSession, d: str) -> DataFrame:
    return graphs.follow_graph(_follows(spark, d), _tagged(spark, d))


@query(f"with {_FOLLOWS}, t as (select distinct source, target from f where target in (from tagged)) select source, target from t where source in (select source from t group by 1 having count(*) >= 2)")
def g2_followers_of_several(spark: SparkSession, d: str) -> DataFrame:
    return graphs.followers_of_several(_follows(spark, d), _tagged(spark, d))


@query(f"with {_FOLLOWS} select target, count(distinct source) as n_followers from f where source in (select source from f where target in (from tagged)) group by 1")
def g4_friends_of_followers(spark: SparkSession, d: str) -> DataFrame:
    return graphs.friends_of_followers(_follows(spark, d), _tagged(spark, d))


@query()
def g11_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graphs.betweenness(ring_edges(spark, d))


# Every vector is pointed to by the two whose ids are a seventh and a third of it: nodes share in-neighbours.
_SHARED = "e as (select distinct a, b from (select vec_id // 7 as a, vec_id as b from embeddings union all select vec_id // 3 + 1, vec_id from embeddings))"


def _sim_round(i: int) -> str:
    pairs = "select x.b as a, y.b as b, sum(s) as s from (select u, v, s from r{i} union all select x as u, x as v, 1.0 as s from n) p join e x on x.a = p.u join e y on y.a = p.v where x.b <> y.b group by 1, 2".replace("{i}", str(i))
    return f", r{i + 1} as (select q.a as u, q.b as v, 0.9 * s / (i.c * j.c) as s from ({pairs}) q join c i on i.b = q.a join c j on j.b = q.b)"


@query(f"with {_SHARED}, n as (select a as x from e union select b from e), c as (select b, count(*) as c from e group by 1), r0 as (select a as u, a as v, 0.0 as s from e where false)" + "".join(map(_sim_round, range(3))) + " select u as a, v as b, round(s, 9) as score from r3 where u < v")
def g14_simrank(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    e = v.select(F.floor(F.col("vec_id") / 7).alias("source"), F.col("vec_id").alias("target")).union(v.select(F.floor(F.col("vec_id") / 3) + 1, "vec_id")).distinct()
    return graphs.simrank(e, 3).withColumn("score", _r("score", 9))


@query()
def n7_communities(spark: SparkSession, d: str) -> DataFrame:
    e = graphs.undirected(supplier_edges(spark, d)).withColumn("sim", F.lit(1.0))
    return graphs.communities(e, graphs.components(e))


@query(f"with {_UND}, n as (select distinct target as node from ({_EDGES})) select x.node as a, y.node as b, exists(select 1 from u where u.a = x.node and u.b = y.node) as linked from n x, n y where x.node < y.node")
def g18_dyads(spark: SparkSession, d: str) -> DataFrame:
    """The dyads of all suppliers, as many as half their square: no pair is left out of the frame."""
    e = supplier_edges(spark, d)
    return graphs.dyads(e.select(F.col("target").alias("node")).distinct(), {"linked": e})


# -- vectors and stories -----------------------------------------------------------------------------------------------

_VEC = "v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings)"


@query(f"with {_VEC} select query_id, id, score, rank from (select q.vec_id as query_id, c.vec_id as id, round(list_cosine_similarity(q.e, c.e), 6) as score, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.e, c.e), 12) desc, c.vec_id) as rank from v q, v c where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id) where rank <= 5")
def o4_top_k(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return vectors.top_k(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", 5).select("query_id", "id", _r("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"with {_VEC} select label, pos, round(avg(x), 6) as mean, count(*) as n from (select label, unnest(e) as x, unnest(range(len(e))) as pos from v) group by 1, 2")
def a17_mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    m = vectors.mean_vectors(table(spark, d, "embeddings"), ["label"], "embedding")
    return m.select("label", F.posexplode("embedding").alias("pos", "mean"), "n").select("label", F.col("pos").cast("bigint").alias("pos"), _r("mean").alias("mean"), "n")


def timed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as items of one kind, 200 seconds apart."""
    return table(spark, d, "embeddings").select(F.lit("elite").alias("kind"), "vec_id", (F.col("vec_id") * 200.0).alias("t"), "embedding", "label")


_LIMIT = 0.3


@query(f"with {_VEC} select 'elite' as kind, a.vec_id as source, b.vec_id as target, round(list_dot_product(a.e, b.e), 6) as sim from v a join v b on b.vec_id > a.vec_id and b.vec_id * 200.0 <= (floor(a.vec_id * 200.0 / 4000) + 4) * 4000 where list_dot_product(a.e, b.e) >= {_LIMIT}")
def n3_similarity_edges(spark: SparkSession, d: str) -> DataFrame:
    limits = spark.createDataFrame([("elite", _LIMIT)], "kind string, threshold double")
    return vectors.similarity_edges(timed_vectors(spark, d), ["kind"], "vec_id", "t", "embedding", limits).withColumn("sim", _r("sim"))


def _block_sample(seed: int) -> str:
    return f"(select * from (select *, row_number() over (partition by b order by (((vec_id % 2147483647) * 1103515245 + {12345 + seed}) % 2147483648), vec_id) as rn from w) where rn <= 100)"


@query(f"with {_VEC}, w as (select *, floor(vec_id * 200.0 / 4000) as b from v), s as (select list_dot_product(x.e, y.e) as sim from {_block_sample(1)} x join {_block_sample(2)} y using (b)) select 'elite' as kind, round(avg(sim), 6) as mean, round(stddev_samp(sim), 6) as sd, round(avg(sim) + 3 * stddev_samp(sim), 6) as threshold from s")
def n2_thresholds(spark: SparkSession, d: str) -> DataFrame:
    t = vectors.thresholds(timed_vectors(spark, d), ["kind"], "vec_id", "t", "embedding", 3.0)
    return t.select("kind", *[_r(c).alias(c) for c in ("mean", "sd", "threshold")])


def _stories(spark: SparkSession, d: str) -> DataFrame:
    """Groups of ten consecutive vectors, of three kinds in turn."""
    items = table(spark, d, "embeddings").withColumn("story", F.floor(F.col("vec_id") / 10).cast("bigint")).withColumn("kind", F.element_at(F.array(F.lit("elite"), F.lit("radio"), F.lit("decahose")), (F.floor(F.col("vec_id") / 10) % 3 + 1).cast("int")))
    items = items.withColumn("t", F.col("vec_id") * 37.0 % 1000 + F.floor(F.col("vec_id") / 50) * 300.0).withColumn("year", F.lit(2020))
    return stories.story_vectors(items, ["year", "kind"], "story", "t", "embedding")


_STORY = """it as (select vec_id, floor(vec_id / 10) as story, ['elite', 'radio', 'decahose'][cast(floor(vec_id / 10) % 3 as int) + 1] as kind, vec_id * 37.0 % 1000 + floor(vec_id / 50) * 300.0 as t, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
dims as (select story, kind, pos, avg(x) as m from (select story, kind, unnest(e) as x, unnest(range(len(e))) as pos from it) group by 1, 2, 3),
st as (select story, kind, list(m order by pos) as v from dims group by 1, 2), sp as (select story, count(*) as n, min(t) as a, max(t) as b from it group by 1),
s as (select cast(story as bigint) as story, kind, v, n, a, b, b - a as dur from st join sp using (story))"""


@query(f"with {_STORY} select cast(2020 as int) as year, x.story as id1, y.story as id2, x.kind as kind1, y.kind as kind2, round(list_cosine_similarity(x.v, y.v), 6) as sim, round(greatest(x.n, y.n) / least(x.n, y.n), 6) as count_ratio, round(greatest(x.dur, y.dur) / nullif(least(x.dur, y.dur), 0), 6) as dur_ratio from s x join s y on x.story < y.story and x.kind <> y.kind and y.a < x.b and y.b > x.a")
def n14_story_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = stories.similar_overlapping(_stories(spark, d), ["year"], "story", "embedding", 200.0)
    return p.select("year", "id1", "id2", "kind1", "kind2", *[_r(c).alias(c) for c in ("sim", "count_ratio", "dur_ratio")])


@query(f"with {_STORY}, p as (select distinct y.story from s x join s y on x.kind = 'elite' and y.kind <> 'elite' and y.a < x.b and y.b > x.a where list_cosine_similarity(x.v, y.v) >= 0.1) select story, kind from s where kind = 'elite' union all select story, kind from s join p using (story)")
def n13_news(spark: SparkSession, d: str) -> DataFrame:
    s = _stories(spark, d)
    pairs = stories.similar_overlapping(s, ["year"], "story", "embedding", 200.0)
    return stories.news(s, pairs, "story", least=0.1).select("story", "kind")


@query()
def n15_matching(spark: SparkSession, d: str) -> DataFrame:
    s = _stories(spark, d)
    p = stories.similar_overlapping(s, ["year"], "story", "embedding", 200.0).where("kind1 in ('elite', 'radio') and kind2 in ('elite', 'radio') and count_ratio <= 7 and dur_ratio <= 3")
    elite = F.col("kind1") == "elite"
    return stories.best_matching(p.select(F.when(elite, F.col("id1")).otherwise(F.col("id2")).alias("left"), F.when(elite, F.col("id2")).otherwise(F.col("id1")).alias("right"), F.col("sim").alias("weight")))


@query(f"""with recursive {_STORY}, p as (select x.kind, x.story as a, y.story as b, list_cosine_similarity(x.v, y.v) as sim from s x join s y on x.story < y.story and x.kind = y.kind and not (y.a < x.b and y.b > x.a)),
q as (select kind, quantile_cont(sim, 0.97) as lim from p group by 1), e as (select a, b from p join q using (kind) where sim > lim), u as (select a, b from e union select b, a from e),
r as (select a as node, a as seen from u union select r.node, u.b from r join u on u.a = r.seen), c as (select node, max(seen) as top from r group by 1)
select story, kind, coalesce(top, story) as merged_into from s left join c on c.node = s.story""")
def n10_merged(spark: SparkSession, d: str) -> DataFrame:
    return stories.merged(_stories(spark, d), ["year", "kind"], "story", "embedding", 0.97).select("story", "kind", "merged_into")


@query("""with i as (select user_id as story, epoch_us(ts) / 1e6 as t, case when value > 20 then 'high' else 'low' end as side0, event_type as txt from events),
x as (select story, t, unnest(['all', side0]) as side, txt, min(t) over (partition by story) as t0 from i), y as (select *, t - t0 as abs, t - min(t) over (partition by story, side) as rel from x),
st as (select story, side, count(*) as count, round(max(t) - min(t), 3) as dur, round(avg(rel), 3) as avg, round(stddev_samp(rel), 3) as std, round(quantile_cont(rel, 0.75) - quantile_cont(rel, 0.25), 3) as iqr, round(avg(abs), 3) as avg_abs, round(avg(cast(txt = 'view' as int)), 6) as topic_share, round(avg(length(txt)), 6) as char_mean from y group by 1, 2)
select * from (select distinct story from y) cross join (select distinct side from y) left join st using (story, side)""")
def n16_story_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumnRenamed("user_id", "story")
    s = stories.story_stats(e, "story", "t", F.when(F.col("value") > 20, "high").otherwise("low"), "event_type", F.col("event_type") == "view")
    return s.select("story", "side", "count", *[_r(c, 3).alias(c) for c in ("dur", "avg", "std", "iqr", "avg_abs")], *[_r(c).alias(c) for c in ("topic_share", "char_mean")])


# -- statistics --------------------------------------------------------------------------------------------------------

@query("select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, min(value) + 0.0 as min, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.75), 6) as q75, max(value) + 0.0 as max from events group by 1")
def a15_describe(spark: SparkSession, d: str) -> DataFrame:
    s = stats.describe(table(spark, d, "events"), ["event_type"], "value")
    return s.select("event_type", "n", *[_r(c).alias(c) for c in ("mean", "sd")], (F.col("min") + 0.0).alias("min"), *[_r(c).alias(c) for c in ("q25", "q50", "q75")], (F.col("max") + 0.0).alias("max"))


@query("""with g as (select count(*) filter (where event_type = 'view') as na, avg(value) filter (where event_type = 'view') as ma, var_samp(value) filter (where event_type = 'view') as va, count(*) filter (where event_type = 'click') as nb, avg(value) filter (where event_type = 'click') as mb, var_samp(value) filter (where event_type = 'click') as vb from events)
select na as n_a, nb as n_b, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 6) as t, cast(na + nb - 2 as double) as df from g""")
def m1_t_test(spark: SparkSession, d: str) -> DataFrame:
    return stats.t_test(table(spark, d, "events"), [], "event_type", "view", "click", "value").select("n_a", "n_b", _r("t").alias("t"), "df")


@query("""with x as (select user_id, avg(value) filter (where event_type = 'view') as a, avg(value) filter (where event_type = 'click') as b from events group by 1) select count(*) as n, round(avg(a - b), 6) as mean_diff, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) as t from x where a is not null and b is not null""")
def m2_paired_t_test(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("b"))
    return stats.paired_t_test(x, [], "a", "b").select("n", _r("mean_diff").alias("mean_diff"), _r("t").alias("t"))


@query("""with e as (select event_type, value from events where event_type in ('view', 'click')), r as (select *, avg(rn) over (partition by value) as rank from (select *, row_number() over (order by value) as rn from e))
select cast(count(*) filter (where event_type = 'view') as double) as na, sum(rank) filter (where event_type = 'view') - count(*) filter (where event_type = 'view') * (count(*) filter (where event_type = 'view') + 1) / 2 as u from r""")
def m4_mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    return stats.mann_whitney(table(spark, d, "events"), "event_type", "view", "click", "value").select("na", "u")


@query("""with e as (select event_type, value as a, user_id as b from events), r as (select *, avg(ra0) over (partition by event_type, a) as ra, avg(rb0) over (partition by event_type, b) as rb from (select *, row_number() over (partition by event_type order by a) as ra0, row_number() over (partition by event_type order by b) as rb0 from e))
select event_type, count(*) as n, round(corr(a, b), 6) as pearson, round(corr(ra, rb), 6) as spearman from r group by 1""")
def m5_correlations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "value", F.col("user_id").cast("double").alias("user_id"))
    return stats.correlations(e, ["event_type"], "value", "user_id").select("event_type", "n", _r("pearson").alias("pearson"), _r("spearman").alias("spearman"))


@query("select event_type, round(regr_slope(value, user_id), 8) as slope, round(regr_intercept(value, user_id), 6) as intercept, round(regr_r2(value, user_id), 8) as r2 from events group by 1")
def m16_line_fit(spark: SparkSession, d: str) -> DataFrame:
    f = stats.line_fit(table(spark, d, "events"), ["event_type"], "user_id", "value")
    return f.select("event_type", _r("slope", 8).alias("slope"), _r("intercept").alias("intercept"), _r("r2", 8).alias("r2"))


@query("select 'intercept' as term, round(regr_intercept(value, user_id), 6) as coef, count(*) as n from events union all select 'user_id', round(regr_slope(value, user_id), 6), count(*) from events")
def m6_least_squares(spark: SparkSession, d: str) -> DataFrame:
    return stats.least_squares(table(spark, d, "events"), ["user_id"], "value").select("term", _r("coef").alias("coef"), "n")


@query("with e as (select value - avg(value) over (partition by event_type) as y, user_id - avg(user_id) over (partition by event_type) as x from events) select 'user_id' as term, round(sum(x * y) / sum(x * x), 6) as coef, count(*) as n from e")
def m6_fixed_effects(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("user_id", F.col("user_id").cast("double"))
    return stats.least_squares(e, ["user_id"], "value", cluster="event_type", fixed="event_type").select("term", _r("coef").alias("coef"), "n")


@query("select event_type, b as bin, count(*) as n from (select event_type, cast(greatest(least(ceil((value - lo) * 10 / (hi - lo)) - 1, 9), 0) as int) as b from events, (select min(value) as lo, max(value) as hi from events)) group by 1, 2")
def a20_equal_width(spark: SparkSession, d: str) -> DataFrame:
    return stats.equal_width(table(spark, d, "events"), "value", 10).groupBy("event_type", "bin").agg(F.count("*").alias("n"))


@query("select b as bin, count(*) as n, round(avg(value), 6) as mean from (select value, cast((value > q[1])::int + (value > q[2])::int + (value > q[3])::int + (value > q[4])::int as int) as b from events, (select quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) as q from events)) group by 1")
def a20_equal_frequency(spark: SparkSession, d: str) -> DataFrame:
    return stats.equal_frequency(table(spark, d, "events"), "value", 5).groupBy("bin").agg(F.count("*").alias("n"), _r(F.avg("value")).alias("mean"))


@query("select event_type, d, n, round(n / sum(n) over (partition by event_type), 9) as share from (select event_type, user_id % 4 as d, count(*) as n from events group by 1, 2)")
def a14_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return stats.crosstab(table(spark, d, "events").withColumn("d", F.col("user_id") % 4), "event_type", "d", True).withColumn("share", _r("share", 9))


@query()
def m3_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """10,000 resamples of curves on 192 points a quarter of an hour apart."""
    e = table(spark, d, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).where("event_type in ('view', 'click')")
    curves = stories.story_curves(e, "user_id", "event_type", "sec", 900.0, 192).withColumnRenamed("user_id", "story")
    return stats.bootstrap_p(stats.resampled_means(curves, "event_type", 10_000), "event_type", "view", "click")


@query()
def t8_unit_roots(spark: SparkSession, d: str) -> DataFrame:
    return series.unit_roots(_hourly(spark, d), "event_type", "bucket", "n")


@query()
def t9_correlograms(spark: SparkSession, d: str) -> DataFrame:
    return series.correlograms(_hourly(spark, d), "event_type", "bucket", "n", 24)


@query()
def t11_causality(spark: SparkSession, d: str) -> DataFrame:
    e = _hourly(spark, d).groupBy("bucket").pivot("event_type", ["view", "click", "error"]).agg(F.max("n")).na.fill(0).withColumn("all", F.lit("all"))
    return series.causality(e, "all", "bucket", ["view", "click", "error"])


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    return ticks.ticks(table(spark, d, "events"), "ts", [], ["6 hours"], ["event_type"]).where("event_type is not null")


@query()
def m10_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Held-out quality of a bag-of-terms classifier of the documents' kind."""
    t = docs(spark, d).where("text is not null").withColumn("label", (F.col("kind") == "radio").cast("double"))
    terms = models.vocabulary(t, "text", 5, 0.5, size=500)
    x = models.feature_vectors(models.tf_idf(t, "doc_id", "text", terms), "doc_id", 500).join(t.select("doc_id", "label", "source"), "doc_id")
    train = win.group_split(F.col("doc_id"))
    model = models.classifier(x.where(train), "label", 0.01, 30)
    return models.auc(models.scored(model, x.where(~train)), "label", "score").select(_r("auc", 4).alias("auc"))


# -- geometry ----------------------------------------------------------------------------------------------------------

@query()
def d3_station_hulls(spark: SparkSession, d: str) -> DataFrame:
    """The convex hull of each map's coordinates by strength."""
    c = table(spark, d, "stg_station_map_coordinate").dropDuplicates(["station_map_coordinate_id"])
    pts = places.clean_points(c.select(F.col("station_map_coordinate_id").alias("point_id"), F.lit(0).alias("owner"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "station_map_id", "strength"))
    return geometry.hulls(pts, ["station_map_id", "strength"], "lon", "lat")


def _walk(spark: SparkSession, d: str) -> DataFrame:
    """How far each station's strong areas cover the moderate areas around, as a crosswalk of maps and regions."""
    m = table(spark, d, "radio_station_map")
    return geometry.crosswalk(m.where("strength = 'strong'").select(F.col("station_map_id").alias("map_id"), "wkt"), m.where("strength = 'moderate'").select(F.col("station_map_id").alias("region_id"), "wkt"))


@query()
def d9_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d)


@query("select station_id, station_map_id as map_id, time_of_day from (select *, row_number() over (partition by station_id order by time_of_day, station_map_id) as rn from radio_station_map) where rn = 1")
def w4_preferred_maps(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "radio_station_map").select("station_id", F.col("station_map_id").alias("map_id"), "time_of_day")
    return geometry.preferred_maps(m)


# -- segments ----------------------------------------------------------------------------------------------------------

def _timed_words(spark: SparkSession, d: str) -> DataFrame:
    """The documents' words as recognizer words, 0.4 s apart with a pause every twelfth."""
    w = docs(spark, d).select(F.col("doc_id").cast("string").alias("audio_key"), F.posexplode(tx.words(F.col("text"))).alias("pos", "word"))
    start = F.col("pos") * 0.4 + F.floor(F.col("pos") / 12) * 1.0
    return w.select("audio_key", "word", start.alias("start"), (start + 0.3).alias("stop"), (F.col("pos") % 10 / 10.0).alias("confidence"))


@query()
def u3_silence_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.by_silence(_timed_words(spark, d))


# Words by number: word i starts at 0.4 i and one second later for every twelve before it; segments are 18 of every 20 seconds.
_TIMED = r"""w0 as (select cast(doc_id as varchar) as audio_key, list_filter(regexp_split_to_array(trim(text, ' '), '\s+'), lambda w: w <> '') as ws from documents), w1 as (select audio_key, unnest(ws) as word, unnest(range(len(ws))) as pos from w0),
words as (select audio_key, word, pos, pos * 0.4::double + (pos // 12) * 1.0::double as start, (pos % 10) / 10.0::double as confidence from w1)"""


@query(f"""with {_TIMED}, m as (select audio_key, max(start + 0.3::double) as m from words group by 1), seg as (select audio_key, unnest(range(cast(floor(m / 20) as bigint) + 1)) as segment_idx from m), z as (select audio_key, segment_idx, segment_idx * 20.0::double as a, segment_idx * 20.0::double + 18 as b from seg)
select z.audio_key, cast(z.segment_idx as int) as segment_idx, z.a as segment_start, md5(coalesce(string_agg(word, ' ' order by start, word), '')) as md5, round(coalesce(sum(confidence) / count(word), -1), 6) as mean_word_confidence from z left join words w on w.audio_key = z.audio_key and z.a <= w.start and w.start < z.b group by z.audio_key, z.segment_idx, z.a""")
def u2_diarized_segments(spark: SparkSession, d: str) -> DataFrame:
    w = _timed_words(spark, d)
    spans = w.groupBy("audio_key").agg(F.max("stop").alias("m")).select("audio_key", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / 20).cast("int"))).alias("i")).select("audio_key", (F.col("i") * 20.0).alias("segment_start"), (F.col("i") * 20.0 + 18.0).alias("segment_end"))
    out = segments.by_diarization(w, spans)
    return out.select("audio_key", F.col("segment_idx").cast("int").alias("segment_idx"), "segment_start", F.md5("content").alias("md5"), _r("mean_word_confidence").alias("mean_word_confidence"))


@query(r"""with s as (select distinct snippet_id, station_id, content, cast(insert_dt as date) as date from radio_snippet) select station_id, date, cast(sum(len(list_filter(regexp_split_to_array(trim(content, ' '), '\s+'), lambda w: w <> ''))) as bigint) as n_words from s group by 1, 2""")
def u5_words_per_day(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "radio_snippet").dropDuplicates(["snippet_id"]).withColumn("date", F.to_date("insert_dt"))
    return segments.words_per_day(s, "content")
