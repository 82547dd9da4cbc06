"""Problem 10: texts that look the same on screen, brought to one form."""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators.skew import salted_join
from tidewave.storage import materialize

# Letters of other scripts and the Latin letters they cannot be told from in common fonts.
CYRILLIC = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѡ": "w", "ѵ": "v", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K",
    "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
}
GREEK = {
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
ARMENIAN = {"օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S"}
CHEROKEE = {
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L",
    "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
LISU = {
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J",
    "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U",
    "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
}
COPTIC = {
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲛ": "N", "Ⲙ": "M", "Ⲏ": "H", "Ⲓ": "I",
    "Ⲕ": "K", "Ⲧ": "T", "Ⲭ": "X", "Ⲩ": "Y",
}
LATIN = {"ɑ": "a", "ɡ": "g"}
SCRIPTS = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN, "Cherokee": CHEROKEE, "Lisu": LISU, "Coptic": COPTIC, "Latin": LATIN}
# Scripts that are written together; a letter of one fits a word in any of its systems.
SYSTEMS = {"CJK": {"Hanb", "Jpan", "Kore"}, "BOPOMOFO": {"Hanb"}, "HIRAGANA": {"Jpan"}, "KATAKANA": {"Jpan"}, "KATAKANA-HIRAGANA": {"Jpan"}, "HANGUL": {"Kore"}}
# The kinds of compatibility characters that differ from their plain form only in width, joining or line breaking.
KINDS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
# Characters without a shape of their own.
INVISIBLE = "\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"

_TO_LATIN = {k: v for table in SCRIPTS.values() for k, v in table.items()}
# Letters too rare in their own script to spell a word with.
_RARE = "һԁԛԝѡѵӏҮԌԚԜѴϲϳϹͿ"
_FROM_LATIN = {name: {v: k for k, v in table.items() if k not in _RARE} for name, table in SCRIPTS.items() if name != "Latin"}
_WORD = regex.compile(r"[\p{L}\p{M}]+")
# A joiner shows between the parts of a pictograph, and in scripts whose letters join.
_SHOWN = regex.compile("(?<=[\\p{Extended_Pictographic}️\U0001f3fb-\U0001f3ff])‍(?=\\p{Extended_Pictographic})|(?<=[^\\P{L}\\p{Latin}\\p{Cyrillic}\\p{Greek}\\p{Armenian}]\\p{M}*)[‌‍]")
_HIDDEN = regex.compile(f"[{INVISIBLE}]")
# Latin text with letters that are already in composed form needs no work; anything else is looked at. Left out of the ranges is what
# _plain_form rewrites (micro sign, ligatures and digraphs, long s, non-breaking hyphen, rupee and information signs).
_PLAIN = regex.compile(
    r"(?V1)[\x00-\x7f\u00a1-\u00ac\u00ae-\u00b4\u00b6-\u0131\u0134-\u0148\u014a-\u017e\u0180-\u01c3\u01cd-\u01f0\u01f4-\u024f"
    r"\u2010\u2012-\u2027\u2030-\u205e\u20a0-\u20a7\u20a9-\u20bf[\p{Extended_Pictographic}--\u2139]\ufffd]*"
)


@lru_cache(maxsize=4096)
def _letter_scripts(c: str) -> frozenset[str]:
    """The scripts a letter belongs to (several for letters of scripts written together); none for anything but a letter. Scripts are named by the first word of the letter's name."""
    if not c.isalpha():
        return frozenset()
    name = unicodedata.name(c, "?").split(" ")[0]
    return frozenset(SYSTEMS.get(name, {name.capitalize()}))


class Looks:
    """The one form of texts that look the same, under a table of look-alikes: the fixed ones above, and `more` (character to Latin letter)."""

    def __init__(self, more: dict[str, str] | None = None):
        self.to_latin = (more or {}) | _TO_LATIN
        self.loose = set(self.to_latin.values())
        # The shortcut for plain texts holds as long as no further look-alike is among their characters.
        self.plain = not any(_PLAIN.fullmatch(c) for c in more or {})
        self.resolve = lru_cache(maxsize=200_000)(self._resolve)
        self.plain_form = lru_cache(maxsize=65536)(self._plain_form)

    def _plain_form(self, c: str) -> str:
        if c in self.to_latin:
            return c
        kind = unicodedata.decomposition(c)
        if unicodedata.category(c) == "Zs":
            return " "
        if kind.startswith(KINDS):
            return unicodedata.normalize("NFKC", c)
        if kind.startswith("<compat>"):
            parts = unicodedata.normalize("NFKC", c)
            return parts if all(p.isalpha() for p in parts) else c
        return c

    def _resolve(self, word: str) -> tuple[str, frozenset[str]]:
        """The word (decomposed) with every look-alike as its Latin letter, and the scripts in which all its letters can be written."""
        bare = "".join(self.to_latin.get(c, c) for c in word)
        scripts: frozenset[str] | None = None
        for c in bare:
            can = frozenset({"Latin"} | {name for name, back in _FROM_LATIN.items() if c in back}) if c in self.loose else _letter_scripts(c)
            if can:
                scripts = can if scripts is None else scripts & can
        return bare, scripts or frozenset()

    def form(self, text: str) -> str:
        if text.isascii() or (self.plain and _PLAIN.fullmatch(text) and "\u200d" not in text):
            return text
        return self.full_form(text)

    def _decomposed(self, text: str) -> str:
        """The text in plain widths, spaces and ligatures, without invisible characters, accents apart."""
        text = "".join(self.plain_form(c) if ord(c) > 127 else c for c in text)
        if _HIDDEN.search(text):
            kept = {m.start() for m in _SHOWN.finditer(text)} if "\u200c" in text or "\u200d" in text else set()
            text = "".join(c for i, c in enumerate(text) if c not in INVISIBLE or i in kept)
        return unicodedata.normalize("NFD", text)

    def _spellings(self, words: list[str]) -> list[str]:
        """Each word in one script: the one all its letters fit; of several the one of the nearest word that fits one only (the following of two as
        near), Latin where there is none and against scripts that no other word of the text is sure to be in; look-alikes stay Latin in a word that fits no script."""
        resolved = [self.resolve(w) for w in words]
        # A script speaks for itself only where some word of the text fits no other; else words of its look-alikes are Latin.
        present = {"Latin"}.union(*(scripts for _, scripts in resolved if len(scripts) == 1))
        resolved = [(bare, scripts & present or scripts) for bare, scripts in resolved]
        sure = [next(iter(scripts)) if len(scripts) == 1 else None for _, scripts in resolved]
        far = len(words) + 1
        after: list[dict[str, int]] = [{}] * len(words)
        seen: dict[str, int] = {}
        for i in range(len(words) - 1, -1, -1):
            if sure[i] is None:
                after[i] = dict(seen)
            else:
                seen[sure[i]] = i
        before: dict[str, int] = {}
        out = []
        for i, (bare, scripts) in enumerate(resolved):
            if sure[i] is not None:
                before[sure[i]] = i
            if not scripts:
                out.append(bare)
                continue
            distance = lambda s: min(((after[i][s] - i, 0) if s in after[i] else (far, 0), (i - before[s], 1) if s in before else (far, 0)))  # noqa: B023, E731
            script = sure[i] or min(scripts, key=lambda s: (*distance(s), s != "Latin", s))
            back = _FROM_LATIN.get(script)
            out.append("".join(back.get(c, c) for c in bare) if back else bare)
        return out

    def full_form(self, text: str) -> str:
        text = self._decomposed(text)
        spelled = iter(self._spellings(_WORD.findall(text)))
        return unicodedata.normalize("NFC", _WORD.sub(lambda m: next(spelled), text))

    def confusable_words(self, text: str) -> list[tuple[str, str, str]]:
        """The words of a text that were written with look-alikes: (as written, in one script, kind). 'mixed' - its letters are of several scripts;
        'whole' - they are of one script, but it reads as a word of another."""
        if text.isascii():
            return []
        words = _WORD.findall(self._decomposed(text))
        out = []
        for word, spelled in zip(words, self._spellings(words)):
            if word != spelled:
                scripts = [s for s in map(_letter_scripts, word) if s]
                together = frozenset.intersection(*scripts) if scripts else frozenset()
                out.append((unicodedata.normalize("NFC", word), unicodedata.normalize("NFC", spelled), "whole" if together else "mixed"))
        return out


LOOKS = Looks()


def consistent_form(text: str) -> str:
    """One form for all texts that look the same: plain widths, spaces and ligatures, composed accents, no invisible characters,
    and every word in one script. A word whose letters fit one script only is spelled in it; one that fits several (look-alikes
    throughout) takes the script of the nearest word that fits one only (the following of two as near), Latin where there is none (see Looks); one that fits none keeps Latin look-alikes.

    The result depends only on how the text looks: the scripts are found on the word with all look-alikes replaced.
    Accents, case, digits, punctuation and line breaks are differences and stay. Idempotent; '' stays ''."""
    return LOOKS.form(text)


def _full_form(text: str) -> str:
    return LOOKS.full_form(text)


def read_confusables(lines: list[str]) -> dict[str, str]:
    """Look-alikes of a public table in the format of Unicode's confusables.txt ('0441 ; 0063 ; MA # ...'): single letters beyond ASCII that stand for one ASCII letter."""
    out = {}
    for line in lines:
        fields = [f.strip() for f in line.lstrip("\ufeff").split("#")[0].split(";")]
        if len(fields) >= 2 and fields[0] and " " not in fields[0] and " " not in fields[1]:
            source, target = chr(int(fields[0], 16)), chr(int(fields[1], 16))
            if source.isalpha() and not source.isascii() and target.isascii() and target.isalpha():
                out[source] = target
    return out


@lru_cache(maxsize=4)
def _looks_of(name: str | None) -> Looks:
    if name is None:
        return LOOKS
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return Looks(read_confusables(f.readlines()))


def _shipped(docs: DataFrame, confusables: str | None) -> str | None:
    """Send a table of look-alikes to the executors; its name there."""
    if confusables:
        docs.sparkSession.sparkContext.addFile(confusables)
        return os.path.basename(confusables)
    return None


FORMS = "doc_id bigint, form string"
DIGESTS = "doc_id bigint, form_key binary, text_key binary"
WORDS = "doc_id bigint, word string, spelled string, kind string, n bigint"


def _forms(table: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = _looks_of(table).form
        for batch in batches:
            ids, texts = batch.columns
            yield pa.RecordBatch.from_arrays([ids, pa.array([None if t is None else form(t) for t in texts.to_pylist()], pa.string())], names=["doc_id", "form"])

    return run


def _digests(table: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form_of = _looks_of(table).form
        for batch in batches:
            forms, texts = [], []
            for t in batch.column(1).to_pylist():
                raw = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                form = form_of(t)
                forms.append(raw if form == t else hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                texts.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "form_key", "text_key"])

    return run


def _words(table: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = _looks_of(table)
        for batch in batches:
            rows = [(i, *w, n) for i, t in zip(*(c.to_pylist() for c in batch.columns)) for w, n in Counter(looks.confusable_words(t)).items()]
            columns = list(zip(*rows)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:4]], pa.array(columns[4], pa.int64())], names=["doc_id", "word", "spelled", "kind", "n"])

    return run


def to_consistent_form(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confusables: str | None = None) -> DataFrame:
    """Every record's text in consistent form: doc_id, form (null for a null text). Other columns are ignored. `confusables`: the path of a public table of look-alikes in the
    format of Unicode's confusables.txt, read beside the fixed letters."""
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(_forms(_shipped(docs, confusables)), FORMS)


def confusable_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confusables: str | None = None) -> DataFrame:
    """The words written with look-alikes: word (as written), spelled (in one script), kind ('mixed' or 'whole', see Looks), n (occurrences), n_docs. Null texts and ids hold none;
    a repeated id counts once (the greatest n, should copies differ). Only the words travel, never the texts."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    found = rows.mapInArrow(_words(_shipped(docs, confusables)), WORDS)
    return found.groupBy("word", "spelled", "kind", "doc_id").agg(F.max("n").alias("n")).groupBy("word", "spelled", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


def _keys(docs: DataFrame, id_col: str, text_col: str, confusables: str | None) -> DataFrame:
    rows = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return rows.mapInArrow(_digests(_shipped(docs, confusables)), DIGESTS).dropDuplicates(["doc_id"])


def same_look_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 20000, confusables: str | None = None) -> DataFrame:
    """Pairs of records whose texts look the same but are different strings: doc_id < other_doc_id.

    Only 128-bit digests of form and text travel. The different spellings of a form are paired, and each pair is then joined with the records
    of either side, so the work is that of the result: equal strings never meet. Forms with one spelling drop out before in a pre-aggregated step. Forms with more than
    `hot_rows` spellings, and spellings held by more records, are cut into parts.
    Null texts and ids are no records; a repeated id counts once; an empty table gives no pairs. `confusables` as in to_consistent_form."""
    keys = materialize(_keys(docs, id_col, text_col, confusables), "looks")
    mixed = keys.groupBy("form_key").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where(F.col("a") != F.col("b")).select("form_key")
    members = materialize(keys.join(mixed, "form_key", "left_semi"), "members")
    spellings = members.select("form_key", "text_key").distinct()
    pairs = salted_join(spellings, spellings.withColumnRenamed("text_key", "other_key"), ["form_key"], F.col("text_key") < F.col("other_key"), hot_rows).select("text_key", "other_key")
    one = salted_join(members.select("text_key", F.col("doc_id").alias("a")), pairs, ["text_key"], F.lit(True), hot_rows).select("a", "other_key")
    both = salted_join(one, members.select(F.col("text_key").alias("other_key"), F.col("doc_id").alias("b")), ["other_key"], F.lit(True), hot_rows)
    return both.select(F.least("a", "b").alias("doc_id"), F.greatest("a", "b").alias("other_doc_id"))


def look_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confusables: str | None = None) -> DataFrame:
    """One row per record: doc_id, class_id (the smallest id with the same look), n_members and n_spellings of its class."""
    keys = materialize(_keys(docs, id_col, text_col, confusables), "looks")
    classes = keys.groupBy("form_key", "text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).groupBy("form_key").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_members"), F.count("*").alias("n_spellings"))
    return keys.join(classes, "form_key").select("doc_id", "class_id", "n_members", "n_spellings")
