"""Recognizer results to segments: by diarization, or by silence."""

from __future__ import annotations



import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators.joins import words_to_segments

SILENCE = "audio_key string, segment_idx int, content string, segment_start_relative double"


def by_diarization(words: DataFrame, diarization: DataFrame) -> DataFrame:
    """One row a diarized segment: audio_key, segment_idx, segment_start, segment_end, content, mean_word_confidence and the other columns.

    words: audio_key, word, start, confidence (null counts 0, but its word counts). Segments without words stay, with '' and confidence -1."""
    joined = words_to_segments(words.select("audio_key", "word", "start", "confidence"), diarization, "audio_key")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "word"))), lambda x: x.word), " ")
    spoken = joined.groupBy("audio_key", "segment_start", "segment_end").agg(text.alias("content"), (F.sum(F.coalesce("confidence", F.lit(0.0))) / F.count("*")).alias("mean_word_confidence"))
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("audio_key").orderBy("segment_start", "segment_end")) - 1
    out = diarization.withColumn("segment_idx", idx).join(spoken, ["audio_key", "segment_start", "segment_end"], "left")
    return out.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("mean_word_confidence", F.coalesce("mean_word_confidence", F.lit(-1.0)))


def silence_segments(words: list[tuple[str, float, float]], gap: float = 0.5, least: int = 5, longest: int = 1000) -> list[tuple[str, float]]:
    """(content, start) of the pieces between silences of more than `gap` seconds after at least `least` words; pieces of `longest` characters are cut."""
    out, segment, last, start = [], [], 0.0, 0.0

    def close() -> None:
        text = ""
        for w in segment:
            text += w + " "
            if len(text) >= longest:
                out.append((text.strip(), start))
                text = ""
        out.append((text.strip(), start))

    for w, a, b in words:
        if w.startswith("<") or w.startswith("["):
            continue
        if a - last > gap and len(segment) >= least:
            close()
            segment, start = [], a
        segment.append(w)
        last = b
    close()
    return out


def by_silence(words: DataFrame) -> DataFrame:
    """Segments of files without diarization: audio_key, segment_idx, content, segment_start_relative. One file a group: files are clips of
    bounded length, thousands of words at most."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = silence_segments(list(pdf.sort_values(["start", "stop"])[["word", "start", "stop"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(pdf["audio_key"].iloc[0], i, c, s) for i, (c, s) in enumerate(rows)], columns=["audio_key", "segment_idx", "content", "segment_start_relative"])

    return words.select("audio_key", "word", "start", "stop").groupBy("audio_key").applyInPandas(run, SILENCE)


def to_segments(words: DataFrame, diarization: DataFrame) -> DataFrame:
    """Files with diarization by it, the others by silence: audio_key, segment_idx, content, segment_start_relative."""
    known = diarization.select("audio_key").distinct()
    a = by_diarization(words.join(known, "audio_key", "left_semi"), diarization).select("audio_key", F.col("segment_idx").cast("int").alias("segment_idx"), "content", F.col("segment_start").alias("segment_start_relative"))
    return a.unionByName(by_silence(words.join(known, "audio_key", "left_anti")))


def words_per_day(snippets: DataFrame, text: str) -> DataFrame:
    """station_id, date, n_words."""
    return snippets.groupBy("station_id", "date").agg(F.sum(F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))).cast("bigint").alias("n_words"))


def with_transcripts(items: DataFrame, transcripts: DataFrame, key: str) -> DataFrame:
    """Items with their newer transcript (key, text) where there is one: content replaced, has_whisper true."""
    t = transcripts.select(key, F.col("text").alias("__text"))
    return items.join(t, key, "left").withColumn("has_whisper", F.col("__text").isNotNull()).withColumn("content", F.coalesce("__text", "content")).drop("__text")




def enriched(snippets: DataFrame, stations: DataFrame, shows: DataFrame) -> DataFrame:
    """Snippets with their station's and show's columns and the readable form of their content (display_text); snippets of unknown stations and shows stay. Write it with
    write_delimited or as JSON lines."""
    from tidewave.functions.text import display_text

    out = snippets.join(stations, "station_id", "left").join(shows, "show_id", "left")
    return out.withColumn("display_text", display_text(F.col("content")))
