"""Problem 7: texts that stop before their author did, found in SQL from word contexts inside texts and at ends."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Patterns of the SQL below (Java syntax). The tail is what authors put after their last words: links, tags, sign-offs, pictures, closing marks.
TAIL = r"""(?:\s*+(?:https?://\S++|(?<=\s)#[\p{L}\p{N}_]++|(?<=\s)[—–]\s?\p{Lu}[\p{L}\p{N} ]*+|(?!\x{FFFD})[\p{So}\p{Sk}\x{FE0F}\x{200D}]++|:\)|["”)\]]))++\s*+$"""
LINKS = r"""(?:\s*+https?://\S++)++\s*+$"""
DOTS = r"""(?:…|\.\.\.)\s*+$"""
BROKEN = r"""(?:\x{FFFD}|&(?:#x?[0-9a-fA-F]*|a|am|amp|ap|apo|apos|l|lt|g|gt|q|qu|quo|quot|n|nb|nbs|nbsp)?|\\(?:u[0-9a-fA-F]{0,3})?)$"""
TOKENS = r"""[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*|[.!?…]+|[,:;—]"""
REPOST = r"""^RT @\w+: """

TOKENS_SQL = r"""
with records as (
  select id, r.* from (
    select {id_col} as id, min(struct({body_col} as body, cast({long_col} as string) as long_body, cast({object_col} as string) as object_body, {source_col} as source)) as r
    from {{texts}} where {id_col} is not null and {body_col} is not null and {body_col} <> '' group by {id_col})),
-- What was written: without the tail, and what kind of ending is left.
endings as (
  select *, if(tailed, regexp_replace(whole, '{TAIL}', ''), whole) as trimmed, if(linked, regexp_replace(whole, '{LINKS}', ''), whole) as unlinked
  from (select *, contains(substring_index(whole, ' ', -1), '://') as linked,
          -- Only these last words or a dash can begin a tail; most texts need no search for one.
          contains(substring_index(whole, ' ', -1), '://') or contains(substring_index(whole, ' ', -1), '#') or contains(whole, '—') or contains(whole, '–') or substring(whole, -1, 1) rlike '[^\p{{L}}\p{{N}}.!?…,:;]' or whole rlike '\s#\S+$' as tailed
        from (select *, rtrim(body) as whole from records))),
cores as (
  select *, if(dotted, regexp_replace(trimmed, '{DOTS}', ''), trimmed) as core,
    case when dotted and length(unlinked) < length(whole) and trimmed = unlinked then 'dots and link'
         when dotted and trimmed = whole then 'dots'
         when trimmed <> unlinked then 'tail'
         when length(unlinked) < length(whole) then 'link'
         when right(whole, 1) in ('.', '!', '?') then 'stop' else 'word' end as ending,
    coalesce(long_body, concat(regexp_extract(body, '{REPOST}', 0), object_body)) as companion
  from (select *, endswith(rtrim(trimmed), '…') or endswith(rtrim(trimmed), '...') as dotted from endings)),
tokens as (
  select id, source, ending, length(body) as n_chars, whole rlike '{BROKEN}' as broken,
    regexp_extract_all(regexp_replace(core, '{REPOST}', ''), '{TOKENS}', 0) as words,
    -- A longer text of the same record that goes on where the body stops: with more letters or digits, or it says the body is whole.
    case when companion is null then null
         when rtrim(companion) in (whole, unlinked) then 'whole'
         when startswith(companion, regexp_replace(core, '{BROKEN}', ''))
              and substring(companion, length(regexp_replace(core, '{BROKEN}', '')) + 1) rlike '[\\p{{L}}\\p{{N}}]' then 'longer'
         when startswith(companion, regexp_replace(core, '{BROKEN}', '')) then 'whole' end as said
  from cores)
select * from tokens
"""

# Words that at least one record in `frequent_share` holds: at most 1 / frequent_share times the words of a mean record, whatever their number.
FREQUENT_SQL = r"""
select word from (select explode(array_distinct(words)) as word from {{tokens}}) group by word
having count(*) >= {frequent_share} * (select count(*) from {{tokens}}) and not word rlike '^[.!?…]'
"""

# Frequent words stay themselves in trigrams, others become their shape: mostly told by the code of their first character (46 33 63 8230: . ! ? …). Marks begin with the text's start.
SHAPES_SQL = r"""
select *, concat(array('|'), transform(words, w ->
    case when ascii(w) in (46, 33, 63, 8230) then '|' when w in ({frequent}) then w when ascii(w) between 97 and 122 then 'a' when ascii(w) between 65 and 90 then 'A' when ascii(w) between 48 and 57 then '9'
         when upper(substring(w, 1, 1)) = lower(substring(w, 1, 1)) and w rlike '^\\p{{N}}' then '9' when substring(w, 1, 1) <> lower(substring(w, 1, 1)) then 'A' else 'a' end)) as marks
from {{tokens}}
"""

# Every trigram: a word after the marks of the two before it, how often it occurs, and how often a sentence or a whole text ends with it.
TRIGRAMS_SQL = r"""
select m1, m2, word, mark, count(*) as n, count_if(stops) as n_stops, count_if(last) as n_last from (
  select if(pos > 0, get(marks, pos - 1), '|') as m1, get(marks, pos) as m2, word, get(marks, pos + 1) as mark, coalesce(get(marks, pos + 2), '|') = '|' as stops, pos + 1 = size(words) as last
  from {{shapes}} lateral view posexplode(words) w as pos, word)
where mark <> '|' group by m1, m2, word, mark
"""

# The final trigrams of texts that do not end as authors end them.
ASKED_SQL = r"""
select id, source, ending, n_chars, if(size(words) > 1, get(marks, size(words) - 2), '|') as m1, get(marks, size(words) - 1) as m2,
  element_at(words, -1) as word, element_at(marks, -1) as mark
from {{shapes}} where ending not in ('stop', 'tail') and size(words) > 0 and element_at(marks, -1) <> '|'
"""

_COARSE = r"if({m} in ('|', ',', ':', ';', '—'), {m}, case when substring({m}, 1, 1) between '0' and '9' then '9' when substring({m}, 1, 1) <> lower(substring({m}, 1, 1)) then 'A' else 'a' end)"
_C1, _C2 = _COARSE.replace("{m}", "m1"), _COARSE.replace("{m}", "m2")

# What is asked of the trigrams for each text, as 64-bit keys: the trigram as it stands, with its last word's mark, with its first word's shape (for a frequent last word), and with
# both shapes; and the last two as those of words that its last word begins.
KEYS_SQL = r"""
select id, inline(array(named_struct('kind', 'word', 'key', xxhash64(0, m1, m2, word)), named_struct('kind', 'mark', 'key', xxhash64(1, m1, m2, mark)), named_struct('kind', 'first', 'key', xxhash64(2, c1, m2, word)),
    named_struct('kind', 'shape', 'key', xxhash64(3, c1, c2, word)), named_struct('kind', 'begun', 'key', xxhash64(4, m1, m2, word)), named_struct('kind', 'begun shape', 'key', xxhash64(5, c1, c2, word)))) as (kind, key)
from (select *, {c1} as c1, {c2} as c2 from {{asked}})
"""

COUNTED_SQL = r"""
with
parts as (select distinct word as part from {{asked}} where word rlike '^\\p{{L}}'),
vocabulary as (
  select word, explode(transform(sequence(1, length(word) - 1), k -> substring(word, 1, k))) as part
  from (select distinct word from {{trigrams}} where n > n_last and length(word) > 1 and word rlike '^\\p{{L}}')),
begun as (select word, collect_set(part) as parts from vocabulary left semi join parts using (part) group by word),
keyed as (
  select n, n_stops, n - n_last as n_inside, explode(concat(
      array(xxhash64(0, m1, m2, word), xxhash64(1, m1, m2, mark), xxhash64(2, c1, m2, word), xxhash64(3, c1, c2, word)),
      flatten(transform(coalesce(parts, array()), p -> array(xxhash64(4, m1, m2, p), xxhash64(5, c1, c2, p)))))) as key
  from (select *, {c1} as c1, {c2} as c2 from {{trigrams}}) left join begun using (word))
select key, sum(n) as n, sum(n_stops) as n_stops, sum(n_inside) as n_inside from keyed left semi join (select distinct key from {{keys}}) using (key) group by key
"""

SQL = r"""
with
answers as (
  select id, max(if(kind = 'word', n, null)) as word_n, max(if(kind = 'word', n_stops, null)) as word_stops, max(if(kind = 'mark', n, null)) as mark_n, max(if(kind = 'mark', n_stops, null)) as mark_stops,
    max(if(kind = 'first', n, null)) as first_n, max(if(kind = 'first', n_stops, null)) as first_stops,
    coalesce(max(if(kind = 'word', n_inside, null)), 0) as stands, coalesce(max(if(kind = 'begun', n_inside, null)), 0) as goes_on,
    coalesce(max(if(kind = 'shape', n_inside, null)), 0) as shape_stands, coalesce(max(if(kind = 'begun shape', n_inside, null)), 0) as shape_goes_on
  from {{keys}} join {{counted}} using (key) group by id),
shares as (
  -- The share of the trigram's occurrences that end a sentence or text; if it is rare, that with the last word's mark; if this is rare too and the last word a frequent one, that with
  -- the first word's shape. And whether trigrams inside texts go on from the last word to a longer one; with both words before as shapes where it is never seen.
  select id, case when word_n >= {support} then word_stops / word_n when mark_n >= {support} then mark_stops / mark_n when word = mark and first_n >= {support} then first_stops / first_n end as end_share,
    word rlike '^\\p{{L}}' and if(stands + goes_on > 0, stands * 5 < goes_on, shape_stands * 5 < shape_goes_on) as half_word
  from {{asked}} join answers using (id)),
evidence as (
  select t.id, t.source, t.ending, t.n_chars, t.said, t.broken, coalesce(end_share < {end_share}, false) as by_trigram, coalesce(half_word, false) as by_part
  from {{shapes}} t left join shares a using (id)),
-- Lengths at which a source ends far more texts in this way than at the lengths around, most of them cut by their trigrams: its limits.
lengths as (
  select source, ending, n_chars, count(*) as n, avg(cast(by_trigram or by_part as int)) as cut_share from evidence
  where ending in ('word', 'dots', 'dots and link') group by source, ending, n_chars),
limits as (
  select source, ending, n_chars from (
    select *, (sum(n) over (partition by source, ending order by n_chars range between 10 preceding and 10 following) - n) / 20 as around from lengths)
  where n >= around + 6 * sqrt(around + 1) + 3 and cut_share >= 0.5),
signs as (
  select e.id, e.source, said,
    case when by_trigram then 'trigram' when by_part then 'trigram of a word begun' when l.n_chars is not null then 'length limit' when broken then 'broken character' when said = 'longer' then 'longer text' end as sign
  from evidence e left join limits l on l.source <=> e.source and l.ending = e.ending and l.n_chars = e.n_chars)
-- The record's own longer text is an exact check: where it says the body is whole, nothing was cut.
select id, source, said, if(said = 'whole', null, sign) as sign, sign is not null and not (said <=> 'whole') as truncated from signs
"""


def judged(texts: DataFrame, id_col: str, body_col: str, source_col: str, long_col: str = "null", object_col: str = "null", support: int = 10, end_share: float = 0.1, frequent_share: float = 0.02) -> DataFrame:
    """id, source, truncated, sign (what showed it, null if not truncated) and said for every record with a text.

    Word trigrams are counted inside texts and at ends of sentences and texts; the first two words of a trigram stand as themselves if at least
    `frequent_share` of the records hold them, else as their shape (the first by its shape where the trigram is rarer than `support` and ends in a frequent word). A text that ends without a stop is truncated if its final trigram,
    seen `support` times, ends a sentence or text in less than `end_share` of the cases (sign 'trigram'), or if trigrams inside texts go on from its last word
    as the beginning of a longer one more than five times as often as they have it whole ('trigram of a word begun'). Two
    signs stand beside these: 'length limit' - the source ends such texts at just this length many times more often than at lengths
    around, and most of them are cut by their trigrams - and 'broken character', an entity, escape or character cut in two at the end. Last, a longer
    text of the same record is an exact check (said: 'whole' or 'longer', else null): it overrules the signs if the body is whole, and is one itself
    ('longer text') if it goes on. Authors' own ends - a stop, tag, picture or sign-off, dots after a finished sentence - are none. Null and empty
    bodies are left out; a repeated id counts once (the smallest body); other columns of the table are ignored; an empty table gives no rows."""
    from tidewave.storage import materialize

    spark = texts.sparkSession
    values = {"id_col": id_col, "body_col": body_col, "source_col": source_col, "long_col": long_col, "object_col": object_col, "support": support, "end_share": end_share, "frequent_share": frequent_share, "c1": _C1, "c2": _C2}

    def run(text: str, **frames: DataFrame) -> DataFrame:
        for name, value in (("TAIL", TAIL), ("LINKS", LINKS), ("DOTS", DOTS), ("BROKEN", BROKEN), ("TOKENS", TOKENS), ("REPOST", REPOST)):
            text = text.replace("{" + name + "}", value.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}"))
        for name, value in values.items():
            text = text.replace("{" + name + "}", str(value))
        for name in frames:
            text = text.replace("{{" + name + "}}", "{" + name + "}")
        return spark.sql(text, **frames)

    tokens = materialize(run(TOKENS_SQL, texts=texts), "tokens")
    frequent = [r[0] for r in run(FREQUENT_SQL, tokens=tokens).collect()]  # at most words of a mean record / frequent_share
    values["frequent"] = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in sorted(frequent)) or "''"
    shapes = materialize(run(SHAPES_SQL, tokens=tokens), "shapes")
    trigrams = materialize(run(TRIGRAMS_SQL, shapes=shapes), "trigrams")
    asked = materialize(run(ASKED_SQL, shapes=shapes), "asked")
    keys = run(KEYS_SQL, asked=asked)
    return run(SQL, shapes=shapes, asked=asked, keys=keys, counted=run(COUNTED_SQL, asked=asked, trigrams=trigrams, keys=keys))
