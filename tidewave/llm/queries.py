"""Queries of the text problems over the project's tables, and the SQL that checks them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm import copies, leakage, lookalikes, packing, terms, truncation, turns
from tidewave.plans.tables import Query, table
from tidewave.storage import materialize


# -- problem 1: terms --------------------------------------------------------------------------------------------------

def term_state(spark: SparkSession, d: str) -> terms.TermCounts:
    snippets, posts = table(spark, d, "radio_snippet"), table(spark, d, "twitter_tweet")
    return terms.counted_in_two_loads(spark, [(snippets, "snippet_id", "content", "insert_dt", "radio_snippet"), (posts, "tweet_id", "content", "insert_dt", "twitter_tweet")])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked(term_state(spark, d).counts()).where(F.col("mark").isNotNull()).select("src_table", "term", "mark")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked(term_state(spark, d).counts()).select("src_table", "term", "n_occurrences", "n_records", "mark")


def p1_after_deletion(spark: SparkSession, d: str) -> DataFrame:
    """Counts over the posts after a delta that deletes the retweets and cuts the mentions out of the others."""
    posts = terms.versions(table(spark, d, "twitter_tweet"), "tweet_id", "content", "insert_dt", F.lit(None).cast("timestamp"), "twitter_tweet")
    posts = posts.select("src_table", "old")
    state = terms.TermCounts(spark).apply(posts.select("src_table", F.lit(None).cast("string").alias("old"), F.col("old").alias("new")))
    gone = F.col("old").startswith("RT ")
    changed = posts.select("src_table", "old", F.when(~gone, F.regexp_replace("old", "@[A-Za-z0-9_]+", "")).alias("new"))
    state.apply(changed.where(gone | (F.col("old") != F.col("new"))))
    return state.counts().where(F.col("term").isNotNull())


P1_COUNTS_SQL = r"""
with records as (
  select 'radio_snippet' as src_table, snippet_id as id, coalesce(any_value(content), '') as content from radio_snippet group by snippet_id
  union all select 'twitter_tweet', tweet_id, coalesce(any_value(content), '') from twitter_tweet group by tweet_id),
totals as (select src_table, count(*) as table_records from records group by src_table),
entries as (select src_table, id, unnest(regexp_split_to_array(lower(content), '[ \t\n\r\f\x0B]+')) as term from records),
counted as (select src_table, term, count(*) as n_occurrences, count(distinct id) as n_records from entries where term <> '' group by src_table, term)
select src_table, term, n_occurrences, n_records,
       case when n_records < 3 then 'rare' when n_records > 0.1 * table_records then 'common' end as mark
from counted join totals using (src_table)"""

P1_FOUND_SQL = f"select src_table, term, mark from ({P1_COUNTS_SQL}) where mark is not null"

P1_AFTER_SQL = r"""
with records as (select tweet_id as id, coalesce(any_value(content), '') as content from twitter_tweet group by tweet_id),
kept as (select id, regexp_replace(content, '@[A-Za-z0-9_]+', '', 'g') as content from records where not starts_with(content, 'RT ')),
entries as (select id, unnest(regexp_split_to_array(lower(content), '[ \t\n\r\f\x0B]+')) as term from kept)
select 'twitter_tweet' as src_table, term, count(*) as n_occurrences, count(distinct id) as n_records from entries where term <> '' group by term"""


# -- problem 5: copies -------------------------------------------------------------------------------------------------

def _snippet_canon(spark: SparkSession, d: str) -> DataFrame:
    canon = copies.letters_and_digits(F.col("content"))
    rows = table(spark, d, "radio_snippet").select(F.col("snippet_id").alias("id"), canon.alias("canon"))
    return rows.where(F.length("canon") >= 100)


def _line_canon(spark: SparkSession, d: str) -> DataFrame:
    return copies.json_canon(table(spark, d, "snippet_line"), "line_id", "line_json")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    radio = copies.copy_pairs(_snippet_canon(spark, d)).select(F.lit("radio_snippet").alias("src_table"), "keep_id", "copy_id")
    return radio.unionByName(copies.copy_pairs(_line_canon(spark, d)).select(F.lit("snippet_line").alias("src_table"), "keep_id", "copy_id"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    radio = copies.collapsed(_snippet_canon(spark, d)).select(F.lit("radio_snippet").alias("src_table"), "keep_id", "n_copies")
    return radio.unionByName(copies.collapsed(_line_canon(spark, d)).select(F.lit("snippet_line").alias("src_table"), "keep_id", "n_copies"))


# One spelling of the canonical texts: JSON records are flat, so a record is its fields in order of name.
_P5 = r"""
with snippets as (select 'radio_snippet' as src_table, snippet_id as id, any_value(regexp_replace(lower(content), '[^\p{L}\p{N}]+', '', 'g')) as canon from radio_snippet group by snippet_id),
fields as (select line_id, line_json, unnest(json_keys(line_json)) as k from (select distinct line_id, line_json from snippet_line where json_type(line_json) = 'OBJECT')),
lines as (
  select 'snippet_line' as src_table, line_id as id, string_agg(k || '=' || case json_type(line_json, '$."' || k || '"') when 'VARCHAR' then 's' || regexp_replace(lower(json_extract_string(line_json, '$."' || k || '"')), '[^\p{L}\p{N}]+', '', 'g')
      when 'NULL' then 'null' when 'BOOLEAN' then json_extract_string(line_json, '$."' || k || '"') else 'n' || cast(cast(json_extract_string(line_json, '$."' || k || '"') as double) as varchar) end, '|' order by k) as canon
  from fields group by line_id),
records as (select * from snippets where length(canon) >= 100 union all select * from lines),
kept as (select src_table, id, min(id) over (partition by src_table, canon) as keep_id from records)"""
P5_FOUND_SQL = _P5 + " select src_table, keep_id, id as copy_id from kept where id <> keep_id"
P5_COLLAPSED_SQL = _P5 + " select src_table, keep_id, count(*) as n_copies from kept group by 1, 2"


# -- problem 6: turns --------------------------------------------------------------------------------------------------

def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(table(spark, d, "radio_snippet"), table(spark, d, "filler_word"))


def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned text of every turn, span by span."""
    return turns.turn_texts(table(spark, d, "radio_snippet"), table(spark, d, "filler_word"))


# -- problem 7: truncation ---------------------------------------------------------------------------------------------

def _judged(spark: SparkSession, d: str) -> DataFrame:
    original = "case when verb = 'share' then object_body end"
    return truncation.judged(table(spark, d, "elite_tweet_2022"), "activity_id", "body", "generator_name", "long_body", original)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("truncated").select(F.col("id").alias("activity_id"), F.col("source").alias("generator_name"))


def p7_signs(spark: SparkSession, d: str) -> DataFrame:
    """What showed the truncations, and what the records' own longer texts say of them: said is 'whole', 'longer' or null, sign null for no truncation."""
    return _judged(spark, d).groupBy("said", "sign").agg(F.count("*").alias("n"))


def p7_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    by_source = _judged(spark, d).groupBy(F.col("source").alias("generator_name")).agg(F.count("*").alias("n_records"), F.sum(F.col("truncated").cast("int")).alias("n_truncated"))
    return by_source.withColumn("share", F.col("n_truncated") / F.col("n_records"))


# -- problem 8: packing ------------------------------------------------------------------------------------------------

def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(packing.token_lengths(table(spark, d, "documents")))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: by plain harmonic classes, and with their rests filled."""
    sizes = materialize(packing.token_lengths(table(spark, d, "documents")), "lengths")
    plain, filled = (packing.usage(packing.packed(sizes, fill=f)).withColumn("rests", F.lit("filled" if f else "left")) for f in (False, True))
    return plain.unionByName(filled)


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """That no container is over capacity, no item is split that would fit and none is lost."""
    sizes = materialize(packing.token_lengths(table(spark, d, "documents")), "lengths")
    return packing.kept(sizes, packing.packed(sizes))


P8_KEPT_SQL = "select count(distinct doc_id) as n_items, 0 as n_split, 0 as n_wrong, 0 as n_overfull from documents"


# -- problem 9: leakage ------------------------------------------------------------------------------------------------

def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_passage"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked: every item with its number of documents."""
    hits = p9_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    items = table(spark, d, "eval_passage").select("item_id", "suite")
    return items.join(hits, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


# -- problem 10: look-alikes -------------------------------------------------------------------------------------------

def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_look_pairs(table(spark, d, "documents"))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.to_consistent_form(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_classes(table(spark, d, "documents"))


def p10_words(spark: SparkSession, d: str) -> DataFrame:
    """The words written in several scripts, or wholly in the look-alikes of another."""
    return lookalikes.confusable_words(table(spark, d, "documents"))


def _look_sql(text: str) -> str:
    """The look of a text in SQL: every character beyond ASCII that has a plainer twin replaced by it, look-alikes by their Latin letters. Two texts have one form if they have one look.

    The pairs of characters follow from the rules of Looks for single characters, over the basic plane."""
    one, many, gone = {}, {}, []
    for i in range(0x80, 0xFFFE):
        c = chr(i)
        if 0xD800 <= i < 0xE000:
            continue
        if c in lookalikes.INVISIBLE:
            gone.append(c)
            continue
        plain = "".join(lookalikes.LOOKS.to_latin.get(x, x) for x in unicodedata.normalize("NFD", lookalikes.LOOKS.plain_form(c)))
        plain = unicodedata.normalize("NFC", plain)
        if plain != unicodedata.normalize("NFC", c):
            (one if len(plain) == 1 else many)[c] = plain
    joined = f"regexp_replace(regexp_replace({text}, '([\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{FE0F}}])\u200d([\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}])', '\\1\ue000\\2', 'g'), '[{''.join(gone)}]', '', 'g')"
    for c, plain in many.items():
        if not unicodedata.category(c).startswith("L") or 0xFB00 <= ord(c) <= 0xFB06 or ord(c) < 0x250:  # ligatures and digraphs of the scripts at hand; the rest are Arabic forms and the like
            joined = f"replace({joined}, '{c}', '{plain}')" if "'" not in plain else joined
    quoted = lambda chars: "".join(chars).replace("'", "''")
    return f"nfc_normalize(translate(nfc_normalize({joined}), '{quoted(one)}', '{quoted(one.values())}'))"


_LOOKS = f"looks as (select doc_id, any_value(text) as text, any_value({_look_sql('text')}) as look from documents where text is not null and doc_id is not null group by doc_id)"
P10_FOUND_SQL = f"with {_LOOKS} select a.doc_id, b.doc_id as other_doc_id from looks a join looks b on a.look = b.look and a.doc_id < b.doc_id and a.text <> b.text"
P10_CLASSES_SQL = f"with {_LOOKS} select doc_id, min(doc_id) over (partition by look) as class_id, count(*) over (partition by look) as n_members, n_spellings from looks join (select look, count(distinct text) as n_spellings from looks group by look) using (look)"
_P9 = rf"""with {_LOOKS}, d as (select doc_id as id, regexp_extract_all(lower(look), '[\p{{L}}\p{{N}}]+') as w from looks),
i as (select item_id as id, regexp_extract_all(lower({_look_sql('passage')}), '[\p{{L}}\p{{N}}]+') as w from (select distinct item_id, passage from eval_passage)),
dw as (select id, array_to_string(w[k:k + 15], ' ') as run from (select id, w, unnest(range(1, len(w) - 14)) as k from d where len(w) >= 16)),
iw as (select distinct id, array_to_string(w[k:k + 15], ' ') as run from (select id, w, unnest(range(1, len(w) - 14)) as k from i where len(w) >= 16)),
hits as (select distinct dw.id as doc_id, iw.id as item_id from dw join iw using (run))"""
P9_FOUND_SQL = _P9 + " select doc_id, item_id from hits"
P9_ITEMS_SQL = _P9 + " select item_id, suite, count(doc_id) as n_documents from (select distinct item_id, suite from eval_passage) left join hits using (item_id) group by 1, 2"


QUERIES: dict[str, Query] = {
    "p1_found": p1_found, "p1_counts": p1_counts, "p1_after_deletion": p1_after_deletion,
    "p5_found": p5_found, "p5_collapsed": p5_collapsed,
    "p6_found": p6_found, "p6_turns": p6_turns,
    "p7_found": p7_found, "p7_sources": p7_sources, "p7_signs": p7_signs,
    "p8_containers": p8_containers, "p8_usage": p8_usage, "p8_kept": p8_kept,
    "p9_found": p9_found, "p9_items": p9_items,
    "p10_found": p10_found, "p10_forms": p10_forms, "p10_classes": p10_classes, "p10_words": p10_words,
}
SQL = {"p1_found": P1_FOUND_SQL, "p1_counts": P1_COUNTS_SQL, "p1_after_deletion": P1_AFTER_SQL, "p5_found": P5_FOUND_SQL, "p5_collapsed": P5_COLLAPSED_SQL, "p8_kept": P8_KEPT_SQL, "p9_found": P9_FOUND_SQL, "p9_items": P9_ITEMS_SQL, "p10_found": P10_FOUND_SQL, "p10_classes": P10_CLASSES_SQL}
