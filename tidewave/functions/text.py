"""Text columns: tokens, hashes, signatures, phrases, display forms, search."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of function that signatures leave out by default.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with"]
UNKNOWN = "<unk>"


def words(text: Column) -> Column:
    """Pieces between white space; '' and blanks give none, null gives null."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Pieces of a split at runs of white space: '' has one, leading and trailing blanks one each; null has none."""
    return F.coalesce(F.size(F.split(text, r"\s+")), F.lit(0))


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\n\r]+", " ")


def list_of(text: Column) -> Column:
    """'a, b' as an array; empty entries dropped."""
    return F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ","), lambda x: x != "")


def is_content_word(word: Column, stopwords: list[str] = STOPWORDS) -> Column:
    return (word != UNKNOWN) & ~word.isin(stopwords) & ~word.contains("[") & (F.length(word) > 2)


def signature(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """A short hash that survives small recognition differences: the content words cut to four letters, the first 32 characters
    of them joined, eight digits of their sha256; '0' if nothing is left."""
    stems = F.transform(F.filter(words(text), lambda w: is_content_word(w, stopwords)), lambda w: F.substring(w, 1, 4))
    joined = F.substring(F.array_join(stems, ""), 1, 32)
    return F.when(joined == "", "0").otherwise(F.substring(F.sha2(joined, 256), 1, 8))


def approxhash_tokens(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """base64 of the md5 of the words that are no stop words, in lower case."""
    kept = F.transform(F.filter(words(text), lambda w: ~w.isin(stopwords)), lambda w: F.lower(w))
    return F.base64(F.unhex(F.md5(F.array_join(kept, " "))))


# The white space of Unicode, for the inside of a class; \s alone is that of ASCII.
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def approxhash_chars(text: Column, stopwords: list[str] = ("a", "i", "s", "t", "d", "m", "o", "y")) -> Column:
    """The same over characters: single-letter stop words (before lower-casing) go, the rest is stripped and joined by blanks."""
    chars = F.filter(F.split(text, ""), lambda c: (c != "") & ~c.isin(list(stopwords)))
    return F.base64(F.unhex(F.md5(F.array_join(F.transform(chars, lambda c: F.regexp_replace(F.lower(c), f"^[{BLANK}]+|[{BLANK}]+$", "")), " "))))


def keyword_hits(text: Column, variants: list[str], mode: str = "substring") -> Column:
    """How many variants occur: 'substring' counts variants (a repeated variant counts again), 'token' counts matching words, 'regex' is 1 or 0."""
    if mode == "token":
        return F.coalesce(F.size(F.filter(words(F.lower(text)), lambda w: w.isin(variants))), F.lit(0))
    if mode == "regex":
        return F.coalesce(F.lower(text).rlike("|".join(variants)).cast("int"), F.lit(0))
    total = F.lit(0)
    for v in variants:
        total = total + F.coalesce(F.contains(F.lower(text), F.lit(v)).cast("int"), F.lit(0))
    return total


def list_count(text: Column, terms: list[str]) -> Column:
    return F.coalesce(F.size(F.filter(words(F.lower(text)), lambda w: w.isin(terms))), F.lit(0))


def best_body(bodies: Column) -> Column:
    """Of several texts of a post (array, best source first): the first without an ellipsis, else the longest (the first of the longest)."""
    known = F.array_compact(bodies)
    whole = F.filter(known, lambda b: ~b.contains("…") & ~b.endswith("..."))
    longest = F.array_max(F.transform(known, lambda b: F.length(b)))
    return F.coalesce(F.get(whole, F.lit(0)), F.get(F.filter(known, lambda b: F.length(b) == longest), F.lit(0)))


def with_repost_prefix(text: Column, body: Column) -> Column:
    """The full text behind the 'RT @name: ' that the body begins with."""
    prefix = F.regexp_extract(body, r"^RT @\w+: ", 0)
    return F.when((prefix != "") & ~text.startswith(prefix), F.concat(prefix, text)).otherwise(text)


def character_length(text: Column) -> Column:
    return F.length(text)


def word_length(text: Column) -> Column:
    """Words, a detected compound (joined by underscores) counting once."""
    return F.size(words(F.replace(text, F.lit("_"), F.lit(""))))


# -- display forms -----------------------------------------------------------------------------------------------------

def normal_form(term: Column) -> Column:
    """A display term as recognizers write it: words in lower case without commas, all-capital words as letter chains (NPR: n._p._r.)."""
    def one(w: Column) -> Column:
        chain = F.concat(F.array_join(F.filter(F.split(F.lower(w), ""), lambda c: c != ""), "._"), F.lit("."))
        return F.when((F.length(w) >= 2) & (F.upper(w) == w), chain).otherwise(F.replace(F.lower(w), F.lit(","), F.lit("")))

    return F.array_join(F.transform(F.split(term, " "), one), " ")


def display_text(text: Column) -> Column:
    """Letter chains to capitals (n._p._r. to NPR, n._p._r.'s to NPR's), compounds to words, the first letter a capital."""
    def one(w: Column) -> Column:
        parts = F.split(w, r"\.")
        chain = F.concat(F.array_join(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.upper(F.replace(p, F.lit("_"), F.lit("")))), ""), F.element_at(parts, -1))
        plain = F.when(w == UNKNOWN, "...").when(w.endswith("."), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000000))).otherwise(w)
        return F.when(w.contains("._"), chain).otherwise(F.replace(plain, F.lit("_"), F.lit(" ")))

    joined = F.array_join(F.transform(words(text), one), " ")
    return F.concat(F.upper(F.substring(joined, 1, 1)), F.substring(joined, 2, 1000000))


class DisplayForms:
    """Display of recognizer words by a dictionary of normal forms, with word pairs first: a bounded dictionary, sent to the workers."""

    def __init__(self, forms: dict[str, str]):
        self.forms = {k: v for k, v in forms.items() if k.count(" ") == v.count(" ")} | {UNKNOWN: "..."}
        self.starts = {k.split(" ")[0] for k in self.forms if " " in k}

    def word(self, w: str) -> str:
        if w in self.forms:
            return self.forms[w]
        if "._" in w:
            *letters, rest = w.split(".")
            return "".join(p.replace("_", "").upper() for p in letters) + rest
        if "_" in w:
            spaced = w.replace("_", " ")
            return self.forms.get(spaced) or " ".join(map(self.word, w.split("_")))
        return w[0].upper() + w[1:] if w.endswith(".") else w

    def text(self, text: str) -> str:
        tokens, out, i = text.split(), [], 0
        while i < len(tokens):
            pair = f"{tokens[i]} {tokens[i + 1]}" if tokens[i] in self.starts and i + 1 < len(tokens) else None
            if pair in self.forms:
                out.append(self.forms[pair])
                i += 2
            else:
                out.append(self.word(tokens[i]))
                i += 1
        joined = " ".join(out)
        return joined[:1].upper() + joined[1:]


def displayer(forms: dict[str, str]) -> Callable[[Column], Column]:
    table = DisplayForms(forms)

    @F.pandas_udf("string")
    def show(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else table.text(t))

    return show


def repair_acronyms(text: Column) -> Column:
    """Letters spelled out ('u._s.', 'n. b. a.', 'f b i') to one word of capitals; underscores elsewhere to blanks, noise marks away.

    A Python function over Arrow batches, as the capitals depend on the match."""
    return _acronyms(text)


_CHAIN = re.compile(r"\b(?:[a-z]\._)+[a-z]\.(?:'s\b)?|\b(?:[a-z]\. ){1,}[a-z]\.(?=\s|$)|(?<!\S)(?:[b-hj-z] ){2,}[b-z](?!\S)")
_NOISE = re.compile(r"\[[a-z]+\]|<unk>")


def acronyms_of(text: str) -> str:
    def joined(m: re.Match) -> str:
        tail = "'s" if m.group().endswith("'s") else ""
        return re.sub(r"[^a-z]", "", m.group().removesuffix("'s")).upper() + tail

    return " ".join(_NOISE.sub(" ", _CHAIN.sub(joined, text)).replace("_", " ").split())


@F.pandas_udf(T.StringType())
def _acronyms(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else acronyms_of(t))


def reference_text(text: Column) -> Column:
    """A published transcript as plain words: lines up to the copyright footer (a line that begins 'Copyright ©'), each without its
    speaker (all up to the first colon) and without anything in brackets or parentheses. Null stays null, '' stays ''."""
    lines = F.split(text, "\n")
    footer = F.array_position(F.transform(lines, lambda l: l.startswith("Copyright ©")), True)
    kept = F.when(footer > 0, F.slice(lines, F.lit(1), F.greatest(footer - 1, F.lit(0)).cast("int"))).otherwise(lines)
    spoken = F.transform(kept, lambda l: F.regexp_replace(F.regexp_replace(l, r"^[^:]*:", ""), r"\[.*?\]|\(.*?\)", ""))
    return F.trim(F.regexp_replace(F.array_join(spoken, " "), r"\s+", " "))


def casing_counts(rows: DataFrame, text: str) -> DataFrame:
    """How often each word is written in which way: norm, form, n."""
    forms = rows.select(F.explode(words(F.col(text))).alias("form")).withColumn("norm", F.lower("form"))
    return forms.groupBy("norm", "form").agg(F.count("*").alias("n"))


# -- phrases -----------------------------------------------------------------------------------------------------------

def frequent_words(rows: DataFrame, text: str, least_share: float = 0.001) -> DataFrame:
    """Words that make up at least `least_share` of all words: word, n."""
    counts = rows.select(F.explode(words(F.lower(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= counts.agg(F.sum("n")).scalar() * F.lit(least_share))


def word_pairs(text: Column) -> Column:
    w = words(F.lower(text))
    return F.filter(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))).alias("b")), lambda p: p["b"].isNotNull())


def phrases(rows: DataFrame, text: str, least: int = 50, threshold: float = 0.75) -> DataFrame:
    """Word pairs that belong together: a, b, n, score (normalised pointwise mutual information, from -1 to 1)."""
    one = rows.select(F.explode(words(F.lower(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    two = rows.select(F.explode(word_pairs(F.col(text))).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = one.agg(F.sum("n").cast("double")).scalar()
    joined = two.join(one.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(one.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    p = F.col("n") / F.col("__t")
    scored = joined.withColumn("__t", total).withColumn("score", F.try_divide(F.ln(p / (F.col("na") / F.col("__t") * F.col("nb") / F.col("__t"))), -F.ln(p)))
    return scored.where(F.col("score") >= threshold).select("a", "b", "n", "score")


def join_phrases(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Text with known pairs joined by '_', greedily from the left and without overlaps."""
    known = F.array(*[F.lit(f"{a} {b}") for a, b in pairs]) if pairs else F.array().cast("array<string>")
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"))

    def step(s: Column, w: Column) -> Column:
        pair = F.concat_ws(" ", s["held"], w)
        hit = s["held"].isNotNull() & F.array_contains(known, pair)
        out = F.when(hit, F.concat(s["out"], F.array(F.concat(s["held"], F.lit("_"), w)))).when(s["held"].isNotNull(), F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"])
        return F.struct(out.alias("out"), F.when(hit, F.lit(None).cast("string")).otherwise(w).alias("held"))

    return F.aggregate(words(text), state, step, lambda s: F.array_join(F.when(s["held"].isNotNull(), F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]), " "))


def split_unknown_compounds(text: Column, vocabulary: list[str]) -> Column:
    return F.array_join(F.flatten(F.transform(F.split(text, " "), lambda w: F.when(w.contains("_") & ~w.isin(vocabulary), F.split(w, "_")).otherwise(F.array(w)))), " ")


# -- search ------------------------------------------------------------------------------------------------------------

def matches_query(text: Column, query: Column) -> Column:
    """Whether one of the query's comma-separated terms occurs as whole words."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.exists(F.filter(F.transform(F.split(query, ","), lambda t: F.trim(F.lower(t))), lambda t: t != ""), lambda t: F.contains(padded, F.concat(F.lit(" "), t, F.lit(" "))))


def match_window(text: Column, query: Column, around: int = 2) -> Column:
    """The word at which the text follows the query for most characters (the first of them), with `around` words on either side.

    Both are read in lower case without anything but letters, digits, blanks and ' _ . @ %. Where nothing follows, the window is that of
    the first word; an empty or null query gives the text as it is."""
    clean = lambda c: F.lower(F.regexp_replace(c, r"[^0-9A-Za-z'_.@% ]", ""))
    q = clean(query)
    # A blank before every word: the text follows where it has a blank and a beginning of the query. Values used in lambdas are bound to names by transform, else each use works them out again.
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(clean(text), " +", " ")))
    begin = lambda b, k: F.concat(F.lit(" "), F.substring(b["q"], F.lit(1), k))
    longest = lambda b: F.aggregate(F.sequence(F.lit(0), F.length(b["q"])), F.lit(0), lambda n, k: F.when((k == n + 1) & F.contains(b["s"], begin(b, k)), k).otherwise(n))
    spot = lambda b: F.substring(b["s"], F.lit(1), F.position(begin(b, longest(b)), b["s"]))
    at = lambda b: F.transform(F.array(spot(b)), lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "))) - 1)[0]

    def window(b: Column) -> Column:
        w = F.split(F.substring(b["s"], F.lit(2), F.length(b["s"])), " ")
        return F.transform(F.array(at(b)), lambda i: F.array_join(F.slice(w, F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around)) + around + 1), " "))[0]

    bound = F.transform(F.array(F.struct(spaced.alias("s"), q.alias("q"))), window)[0]
    return F.when(F.coalesce(query, F.lit("")) == "", text).otherwise(bound)


def search_score(band: Column, syndication: Column, start: Column) -> Column:
    """Rank of a hit: telephone speech (band 'T') before unsyndicated text ('unique') before the rest, later starts first. For a descending sort."""
    telephone, unique = F.coalesce((band == "T").cast("int"), F.lit(0)), F.coalesce((syndication == "unique").cast("int"), F.lit(0))
    return (telephone * 2 + unique) * F.lit(1e8) + F.coalesce(F.unix_micros(start.cast("timestamp")) / 1e6, F.lit(0.0)) / 1e6


def facet_display(facet: Column, states: dict[str, str]) -> Column:
    """'state_code=MA' as a state's name, gender and band in words, other facets by their value; anything else with blanks for underscores."""
    key, value = F.get(F.split(facet, "="), F.lit(0)), F.get(F.split(facet, "="), F.lit(1))
    names = F.create_map(*[F.lit(x) for kv in states.items() for x in kv]) if states else F.create_map(F.lit(""), F.lit(""))
    text = (
        F.when(key == "state_code", F.coalesce(F.try_element_at(names, value), value))
        .when(key == "diary_gender", F.concat(F.lit("All clips with predicted gender "), F.when(value == "F", "Female").otherwise("Male")))
        .when(key == "diary_band", F.concat(F.lit("All clips with "), F.when(value == "T", "telephone speech").when(value == "S", "studio speech").otherwise("Unclassified speech")))
        .otherwise(value)
    )
    return F.when(F.size(F.split(facet, "=")) == 2, text).otherwise(F.replace(facet, F.lit("_"), F.lit(" ")))


def group_filter(group: str, groups: dict[str, list[str]], columns: list[str]) -> Column:
    """A station group ('state_code=GA,callsign=WABC' or a named one) as a condition; entries of other columns are ignored, none match all."""
    tests = [F.col(k) == v for k, _, v in (entry.partition("=") for entry in groups.get(group, group.split(","))) if k in columns and v]
    out = tests[0] if tests else F.lit(True)
    for t in tests[1:]:
        out = out | t
    return out


def degrees(text: Column) -> Column:
    """'42-21-30 N' or '42 21 30 W' as signed degrees; null for other texts."""
    p = r"^\s*(\d+)[\-\s:](\d+)[\-\s:](\d+(?:\.\d+)?)\s*([NSEWnsew])\s*$"
    num = lambda i: F.regexp_extract(text, p, i).try_cast("double")
    value = num(1) + num(2) / 60 + num(3) / 3600
    return F.when(text.rlike(p), F.when(F.upper(F.regexp_extract(text, p, 4)).isin("S", "W"), -value).otherwise(value))


def minute_of_week(time: Column) -> Column:
    """Minutes since Monday 00:00."""
    return F.weekday(time) * 1440 + F.hour(time) * 60 + F.minute(time)


def source_confidence(source: Column, table: dict[str, float], prefixes: dict[str, float], default: float = 0.0) -> Column:
    out = F.lit(default)
    for p, v in prefixes.items():
        out = F.when(source.startswith(p), v).otherwise(out)
    for k, v in table.items():
        out = F.when(source == k, v).otherwise(out)
    return out


def url(base: str, **params: Column) -> Column:
    query = [F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in params.items()]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *query))


def story_id(year: Column, kind: Column, group: Column) -> Column:
    """'2020-radio-17'; null where the group is."""
    return F.when(group.isNotNull(), F.concat_ws("-", year.cast("string"), kind, group.cast("string")))


def effect_type(p_elite: Column, p_radio: Column, alpha: float = 0.05) -> Column:
    """Which of posts (T) and radio (R) leads the other, by the p values of both directions; null where one is null."""
    t, r = p_elite < alpha, p_radio < alpha
    return F.when(t & r, "T <-> R").when(t & ~r, "T -> R").when(~t & r, "R -> T").when(~t & ~r, "Neither")


def log_odds(p: Column) -> Column:
    """ln(p / (1 - p)); null at 0 and 1."""
    return F.when((p > 0) & (p < 1), F.ln(p / (1 - p)))
