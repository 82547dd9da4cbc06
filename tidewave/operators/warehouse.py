"""The star schema's derived tables, as functions of the tables they are made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.operators.windows import hash_order, share_of_group, top_per_group


def dates(spark, first: str, last: str) -> DataFrame:
    """One row a day with its parts."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("date"))
    return days.select("date", F.year("date").alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"), F.weekofyear("date").alias("week"))


def integers(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("n"))


def stations(staged: DataFrame, states: DataFrame, ingested: DataFrame, owners: DataFrame) -> DataFrame:
    """Stations with their state, cleaned owner and whether they were ingested; exclude is null for the others."""
    there = ingested.select("station_id").distinct().withColumn("__in", F.lit(True))
    out = staged.join(states.select(F.col("postal_code").alias("state"), "state_id"), "state", "left").join(owners, "station_id", "left").join(there, "station_id", "left")
    return out.withColumn("ingested", F.col("__in").isNotNull()).withColumn("exclude", F.when(F.col("ingested"), F.col("exclude"))).drop("__in", "state")


def transformed_snippets(staged: DataFrame, callsigns: DataFrame, shows: DataFrame) -> DataFrame:
    """Staged recognizer rows as facts: station by callsign, show by trimmed name (its parent if it has one), word count, times."""
    names = shows.select(F.trim(F.lower("name")).alias("__name"), F.coalesce("parent_show_id", "show_id").alias("show_id"))
    out = staged.join(callsigns.select(F.col("corpus_callsign").alias("callsign"), "station_id"), "callsign", "left").withColumn("__name", F.trim(F.lower("show_name"))).join(names, "__name", "left")
    return out.select(
        "*",
        F.coalesce(F.size(F.split("content", r"\s+")), F.lit(0)).alias("wordcount"),
        F.to_date(F.timestamp_seconds("segment_start_global")).alias("date"),
        F.timestamp_seconds("segment_start_global").alias("start_dt"),
        F.timestamp_seconds("segment_end_global").alias("end_dt"),
        (F.col("segment_end_global") - F.col("segment_start_global")).alias("duration"),
    ).drop("__name")


def multi_station_shows(snippets: DataFrame) -> DataFrame:
    return snippets.where(F.col("show_id").isNotNull()).groupBy("show_id").agg(F.min("station_id").alias("a"), F.max("station_id").alias("b")).where(F.col("a") != F.col("b")).select("show_id")


def multi_station_hashes(snippets: DataFrame, time: str) -> DataFrame:
    """Content hashes heard on more than one station within a week (ISO week with the calendar year)."""
    weeks = snippets.where(F.col("approxhash").isNotNull()).groupBy(F.year(time).alias("y"), F.weekofyear(time).alias("w"), "approxhash")
    return weeks.agg(F.min("station_id").alias("a"), F.max("station_id").alias("b")).where(F.col("a") != F.col("b")).select("approxhash").distinct()


def syndication(snippets: DataFrame, time: str) -> DataFrame:
    """snippet_id, syndication_method ('show' for snippets with a show, 'approxhash' for all), syndicated."""
    shows = multi_station_shows(snippets).withColumn("hit", F.lit(True))
    hashes = multi_station_hashes(snippets, time).withColumn("hit", F.lit(True))
    by_show = snippets.where(F.col("show_id").isNotNull()).join(shows, "show_id", "left").select("snippet_id", F.lit("show").alias("syndication_method"), F.col("hit").isNotNull().alias("syndicated"))
    # Rows without a hash match nothing; in the join they would all be one task.
    unhashed = snippets.where(F.col("approxhash").isNull()).select("snippet_id", F.lit("approxhash").alias("syndication_method"), F.lit(False).alias("syndicated"))
    by_hash = snippets.where(F.col("approxhash").isNotNull()).join(hashes, "approxhash", "left").select("snippet_id", F.lit("approxhash").alias("syndication_method"), F.col("hit").isNotNull().alias("syndicated"))
    return by_show.unionByName(by_hash).unionByName(unhashed)


def snippet_data(snippets: DataFrame, stations: DataFrame, states: DataFrame, shows: DataFrame, syndicated: DataFrame) -> DataFrame:
    """The fact view: spoken snippets of stations and shows that are not excluded, with their attributes.

    `exclude` of a station must be known and false (null is not false); that of a missing show counts as false."""
    st = stations.select("station_id", "state_id", F.col("station_format"), F.col("band").alias("station_band"), F.col("std_owner").alias("station_std_owner"), F.col("is_excluded").alias("__st"))
    sh = shows.select("show_id", F.col("name").alias("show_name"), F.col("exclude").alias("__sh"))
    by = lambda m, c: syndicated.where(F.col("syndication_method") == m).select("snippet_id", F.col("syndicated").alias(c))
    out = snippets.where(F.col("content") != "").join(st, "station_id").join(states, "state_id").join(sh, "show_id", "left")
    out = out.where(~F.col("__st") & ~F.coalesce("__sh", F.lit(False))).drop("__st", "__sh")
    out = out.join(by("show", "syndicated_show"), "snippet_id", "left").join(by("approxhash", "syndicated_approxhash"), "snippet_id", "left")
    return out.withColumn("is_public", F.col("station_format") == "Public Radio")


def episodes(snippets: DataFrame) -> DataFrame:
    return snippets.where(F.col("show_id").isNotNull()).groupBy("date", "show_id", "station_id").agg(
        F.count("*").alias("cnt"), F.sum("duration").alias("duration"), F.avg("show_confidence").alias("show_confidence"), F.avg("mean_word_confidence").alias("word_confidence")
    )


def best_episodes(episodes: DataFrame, confident: Column | None = None, sized: Column | None = None) -> DataFrame:
    """The best attributed episode of each day and show among those that pass; unknown confidences rank first, as in the source's order."""
    for test in (confident, sized):
        if test is not None:
            episodes = episodes.where(test)
    order = [F.col("show_confidence").desc_nulls_first(), F.col("cnt").desc_nulls_first(), F.col("word_confidence").desc_nulls_first(), F.col("station_id")]
    return top_per_group(episodes, ["date", "show_id"], order)


def show_station_fractions(snippets: DataFrame) -> DataFrame:
    counts = snippets.groupBy("show_id", "station_id").agg(F.count("*").alias("cnt_overlap"))
    out = share_of_group(counts, "cnt_overlap", ["show_id"], "station_frac_of_show")
    return out


def top_words(snippets: DataFrame, time: str, n: int = 1000) -> DataFrame:
    """The n most frequent words of each show and month; single white space separates, so runs of it give empty words."""
    words = snippets.where(F.col("show_id").isNotNull()).select("show_id", F.year(time).alias("year"), F.month(time).alias("month"), F.explode(F.split(F.lower("content"), r"\s")).alias("word"))
    counts = words.groupBy("show_id", "year", "month", "word").agg(F.count("*").alias("cnt"))
    return top_per_group(counts, ["show_id", "year", "month"], [F.col("cnt").desc(), F.col("word")], n)


def user_shows(staged: DataFrame, users: DataFrame) -> DataFrame:
    """Shows' account lists ('a, b') matched to users without case: user_id, show_id, is_host, is_show."""
    names = lambda c: staged.select("show_id", F.explode(F.split(F.replace(F.col(c), F.lit(" "), F.lit("")), ",")).alias("screen_name")).where("screen_name <> ''").select("show_id", F.lower("screen_name").alias("name")).distinct()
    known = users.select("user_id", F.lower("screen_name").alias("name"))
    host, show = names("host").withColumn("h", F.lit(True)), names("show").withColumn("s", F.lit(True))
    return names("twitter").join(known, "name").join(host, ["show_id", "name"], "left").join(show, ["show_id", "name"], "left").select("user_id", "show_id", F.col("h").isNotNull().alias("is_host"), F.col("s").isNotNull().alias("is_show"))


def station_pairs(data: DataFrame, n: int = 200) -> DataFrame:
    """A reproducible sample of up to n unordered station pairs a day."""
    per_day = data.groupBy("date", "station_id").agg(F.count("*").alias("cnt"))
    a = per_day.select("date", F.col("station_id").alias("station_id1"), F.col("cnt").alias("cnt1"))
    b = per_day.select("date", F.col("station_id").alias("station_id2"), F.col("cnt").alias("cnt2"))
    pairs = a.join(b, "date").where(F.col("station_id1") > F.col("station_id2"))
    return top_per_group(pairs, ["date"], [hash_order(F.col("station_id1") * 100003 + F.col("station_id2")), F.col("station_id1"), F.col("station_id2")], n)


def show_pairs(best: DataFrame, attributes: DataFrame, n_mixed: int = 50, n_other: int = 100) -> DataFrame:
    """Episode pairs of one day or of one show, sampled by whether their shows have accounts.

    best: best episodes; attributes: show_id, show_name, twitter (bool), is_public. All pairs with accounts on both sides stay."""
    e = best.join(attributes, "show_id")
    side = lambda i: e.select(*[F.col(c).alias(f"{c}{i}") for c in ("date", "show_id", "station_id", "cnt", "show_name", "is_public", "twitter")])
    a, b = side(1), side(2)
    within_day = a.join(b, (F.col("date1") == F.col("date2")) & (F.col("show_id1") > F.col("show_id2")))
    within_show = a.join(b, (F.col("show_id1") == F.col("show_id2")) & (F.col("date1") > F.col("date2")))
    pairs = within_day.unionByName(within_show)
    pairs = pairs.withColumn("within_day", (F.col("date1") == F.col("date2")).cast("int")).withColumn("within_show", (F.col("show_id1") == F.col("show_id2")).cast("int"))
    pairs = pairs.withColumn("stratum", F.when(F.col("within_day") == 1, F.col("date1").cast("string")).otherwise(F.col("show_id1").cast("string")))
    mix = hash_order(F.col("show_id1") * 7919 + F.col("show_id2") * 31 + F.datediff("date1", F.lit("2019-01-01").cast("date")) * 17 + F.datediff("date2", F.lit("2019-01-01").cast("date")))
    order = [mix, F.col("date1"), F.col("date2"), F.col("show_id1"), F.col("show_id2")]
    pairs = top_per_group(pairs, ["twitter1", "twitter2", "within_day", "stratum"], order, 2147483647, rank="rn")
    both = F.col("twitter1") & F.col("twitter2")
    keep = both | ((F.col("twitter1") != F.col("twitter2")) & (F.col("rn") <= n_mixed)) | (~F.col("twitter1") & ~F.col("twitter2") & (F.col("rn") <= n_other))
    return pairs.where(keep).withColumn("twitter_count", F.col("twitter1").cast("int") + F.col("twitter2").cast("int")).drop("stratum", "rn")


def pair_contents(data: DataFrame, pairs: DataFrame) -> DataFrame:
    """The text of every episode that occurs in a pair, snippets in order of their id."""
    wanted = pairs.select(F.col("date1").alias("date"), F.col("show_id1").alias("show_id"), F.col("station_id1").alias("station_id")).union(pairs.select("date2", "show_id2", "station_id2")).distinct()
    return data.join(wanted, ["date", "show_id", "station_id"], "left_semi").groupBy("date", "show_id", "station_id").agg(F.bool_or("is_public").alias("is_public"), ordered_text("content", "snippet_id").alias("content"))


def ordered_text(text: str, key: str) -> Column:
    """All texts of a group joined by blanks, in order of a key."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, text))), lambda x: x[text]), " ")


def show_data(data: DataFrame) -> DataFrame:
    public = F.col("is_public").cast("int")
    return data.where(F.col("show_id").isNotNull()).groupBy("show_id").agg(
        F.max("show_name").alias("show_name"), F.bool_and("syndicated_show").alias("syndicated_show"), F.count("*").alias("nsnippets"), F.sum("duration").alias("duration"),
        F.sum(public).alias("nsnippets_public"), (F.sum(public) / F.count("*")).alias("public_fraction"),
    )


def station_data(stations: DataFrame, states: DataFrame, data: DataFrame) -> DataFrame:
    sample = data.groupBy("station_id").agg(F.countDistinct("date").alias("ndates"), F.count("*").alias("nsnippets"), F.sum("duration").alias("duration"))
    out = stations.join(sample, "station_id", "left").join(states, "state_id", "left")
    return out.select("station_id", "ndates", "nsnippets", "duration", F.col("nsnippets").isNotNull().alias("in_sample"), "station_format", "std_owner", "band", (F.col("station_format") == "Public Radio").alias("is_public"), "postal_code", "census_region")
