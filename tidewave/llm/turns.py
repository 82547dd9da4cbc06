"""Problem 6: transcripts to numbered speaker turns of spoken words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Spelled numbers in speaker labels.
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty"]
_VALUE = {word: i + 1 for i, word in enumerate(NUMBERS)}
_CORE = r"(?:speaker|spkr?|s)[\s_.\-]*(?P<n>\d{1,18}(?!\d)|" + "|".join(sorted(NUMBERS, key=len, reverse=True)) + ")"
_WHOLE_LABEL = regex.compile(rf"\s*[>\[({{<]*\s*{_CORE}\s*[\])}}>:]*\s*", regex.I)
#: Read from left to right: a label, something that is not speech, or a word.
_TOKEN = regex.compile(
    rf"""(?P<label>
        [\[({{<]\s*(?:>>+\s*)?{_CORE}\s*:?\s*[\])}}>]:?              # [Speaker 3], (speaker one)
      | (?:>>+\s*)?(?<![\p{{L}}\p{{N}}]){_CORE.replace("?P<n>", "?P<n2>")}\s*:(?!\d)      # SPEAKER_01:   >> S3:
      | >>+\s*{_CORE.replace("?P<n>", "?P<n3>")}(?![\p{{L}}\p{{N}}])                      # >> S3
      | (?<![\p{{L}}\p{{N}}]){_CORE.replace("?P<n>", "?P<n4>")}\s+[-–—]+(?=\s|$)        # S4 -
    )
    | (?P<noise> \[[^\]]*\] | \([^)]*\) | \{{[^}}]*\}} | <[^<>]*> | \*[^*]*\* | [♩-♬][^♩-♬]*[♩-♬]
      | (?<![\p{{L}}\p{{N}}])\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?:[.,]\d+)?(?![\p{{L}}\p{{N}}]) )
    | (?P<word> [\p{{L}}\p{{N}}]+(?:['‘’ʼ´`＇][\p{{L}}\p{{N}}]+)* )""",
    regex.I | regex.X,
)
# Snippets without anything like a label need no look for one at every letter; these say which, and read the others.
_LABEL_SIGN = re.compile(r"(?<![^\W_])s(?:peaker|pkr?)?[\s_.\-]*(?:\d|" + "|".join(NUMBERS) + ")")
_NOISE_SIGN = re.compile(r"[\[({<*♩-♬:]")
_NOISE = re.compile(r"\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^<>]*>|\*[^*]*\*|[♩-♬][^♩-♬]*[♩-♬]|(?<![^\W_])\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?(?![^\W_])")
_PLAIN_WORD = re.compile(r"[^\W_]+(?:['‘’ʼ´`＇][^\W_]+)*")
_CLOCK = regex.compile(r"(?<!\d)(?:(\d{1,2}):)?(\d{1,2}):(\d{2}(?:[.,]\d+)?)(?!\d)")
RUNS = "snippet_id bigint, audio_key string, at double, cue double, place int, speakers array<bigint>, words array<int>, texts array<string>"
SPAN = "audio_key string, part int, n int, speaker bigint, known boolean, first_snippet_id bigint, n_words bigint, n_spans bigint, first boolean, last boolean, seq bigint, snippet_id bigint, text string"


def _number(text: str) -> int:
    return _VALUE[text.lower()] if text.lower() in _VALUE else int(text)


@lru_cache(maxsize=10_000)
def label_number(label: str | None) -> int | None:
    """The number in a whole label ('Speaker One', ' s2 ', 'SPK 003'), or None if it is no label."""
    m = _WHOLE_LABEL.fullmatch(label) if label else None
    return _number(m["n"]) if m else None


class Fillers:
    """Hesitation words; the last letter of a word may be drawn out."""

    def __init__(self, words: list[str]):
        self.least: dict[tuple[str, str], int] = {}
        for w in (x.strip().lower() for x in words):
            if w:
                stem = w.rstrip(w[-1])
                n = len(w) - len(stem)
                self.least[stem, w[-1]] = min(n, self.least.get((stem, w[-1]), n))
        self.known: dict[str, bool] = {}

    def __contains__(self, word: str) -> bool:
        known = self.known.get(word)
        if known is None:
            if len(self.known) > 100_000:
                self.known.clear()
            known = self.known[word] = self._drawn_out(word.lower())
        return known

    def _drawn_out(self, w: str) -> bool:
        stem = w.rstrip(w[-1])
        least = self.least.get((stem, w[-1]))
        return least is not None and len(w) - len(stem) >= least


def spans_of(content: str | None, label: str | None, fillers: Fillers) -> list[tuple[int | None, list[str]]]:
    """The spoken words of one snippet as (speaker, words), in order; speaker None: whoever spoke before the snippet.

    A closing (speaker, []) is kept when a label stands after the last word, as it holds from there on."""
    now = label_number(label)
    if not content:
        return []
    if not _LABEL_SIGN.search(content.lower()):
        words = [w for w in _PLAIN_WORD.findall(_NOISE.sub(" ", content) if _NOISE_SIGN.search(content) else content) if w not in fillers]
        return [(now, words)] if words else []
    runs: list[tuple[int | None, list[str]]] = []
    for m in _TOKEN.finditer(content):
        if m["word"] is not None:
            if m["word"] in fillers:
                continue
            if runs and runs[-1][0] == now:
                runs[-1][1].append(m["word"])
            else:
                runs.append((now, [m["word"]]))
        elif m["label"] is not None:
            now = _number(m["n"] or m["n2"] or m["n3"] or m["n4"])
    if runs and runs[-1][0] != now:
        runs.append((now, []))
    return runs


def runs_of(content: str | None, label: str | None, fillers: Fillers) -> list[tuple[int | None, int]]:
    """`spans_of` with the number of words instead of the words."""
    return [(speaker, len(words)) for speaker, words in spans_of(content, label, fillers)]


def _cue(content: str | None) -> float | None:
    m = _CLOCK.search(content) if content else None
    return int(m[1] or 0) * 3600 + int(m[2]) * 60 + float(m[3].replace(",", ".")) if m else None


def _parse(words, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fillers = Fillers(words.value)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for snippet, key, at, place, label, content in zip(*(c.to_pylist() for c in batch.columns)):
                spans = spans_of(content, label, fillers)
                if spans:
                    cue = _cue(content)
                    timed = at if at is not None and at == at else cue
                    texts = [" ".join(w) for _, w in spans] if with_text else None
                    for column, value in zip(out, (snippet, key, None if timed is None else timed + 0.0, cue, place, [s for s, _ in spans], [len(w) for _, w in spans], texts)):
                        column.append(value)
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["snippet_id", "audio_key", "at", "cue", "place", "speakers", "words", "texts"])

    return run


# -- order -------------------------------------------------------------------------------------------------------------

def precedence(cues: list[float | None], places: list[tuple]) -> list[tuple[int, int]]:
    """The edges among segments that timing leaves unordered: from each to the next by cue, and from each to the next in dialogue order (places).

    `cues` are effective ones (see _with_effective): a dialogue edge to a segment of an earlier cue contradicts the cues, which are stronger, and is dropped."""
    rank = [(c is not None, c or 0.0) for c in cues]
    by_cue = sorted(range(len(cues)), key=lambda i: (rank[i], places[i]))
    by_place = sorted(range(len(cues)), key=lambda i: places[i])
    edges = [(a, b) for a, b in zip(by_cue, by_cue[1:]) if rank[a] < rank[b]]
    return edges + [(a, b) for a, b in zip(by_place, by_place[1:]) if rank[a] <= rank[b]]


def topological(n: int, edges: list[tuple[int, int]], first: list[tuple]) -> list[int]:
    """The order of n segments that keeps all edges; of those free to come next, the one with the least `first`."""
    after: list[list[int]] = [[] for _ in range(n)]
    waits = [0] * n
    for a, b in edges:
        after[a].append(b)
        waits[b] += 1
    ready: list[tuple] = []
    for i in range(n):
        if not waits[i]:
            heappush(ready, (first[i], i))
    out = []
    while ready:
        i = heappop(ready)[1]
        out.append(i)
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                heappush(ready, (first[j], j))
    return out


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Segments in topological order, from rows sorted by file and timing. Timing edges lead from every block of equal timing to the next, and as they are the strongest no other
    edge can turn them; inside a block the edges of `precedence` decide."""
    block: list[tuple] = []

    def settled() -> Iterator[tuple]:
        if len(block) == 1:
            yield block[0]
            return
        cues, places = [r[3] for r in block], [(r[4] is None, r[4] or 0, r[0]) for r in block]
        for i in topological(len(block), precedence(cues, places), [((c is not None, c or 0.0), p) for c, p in zip(cues, places)]):
            yield block[i]

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if block and (row[1], row[2]) != (block[0][1], block[0][2]):
                yield from settled()
                block = []
            block.append(row)
    if block:
        yield from settled()


def _running_max(rows: DataFrame, by: list[str], order: list, value: str, out: str) -> DataFrame:
    """The greatest `value` of a group (`by`, nulls a group) so far in `order`. Groups of any length are cut by range partitions: a window in each, then the maximum that
    came before it, a row for each group and partition."""
    from tidewave.storage import materialize

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    parts = materialize(rows.repartitionByRange(n, *by, *order).withColumn("part", F.spark_partition_id()), "parts")
    local = parts.withColumn("run", F.max(value).over(Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    came = parts.groupBy(*[F.col(c).alias(f"_{c}") for c in by], F.col("part").alias("_part")).agg(F.max(value).alias("m"))
    came = came.withColumn("came", F.max("m").over(Window.partitionBy(*[f"_{c}" for c in by]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    same = F.col("part") == F.col("_part")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return local.join(came, same).withColumn(out, F.greatest("run", "came")).select(*rows.columns, out)


def _with_effective(runs: DataFrame) -> DataFrame:
    """Runs with effective timing and cue, where dialogue order must stand in for them.

    A segment without offset and clock reading takes the latest timing before it in dialogue order; one without a clock reading among segments of equal timing,
    the latest cue before it among these. That resolves the conflicts of dialogue order with the stronger constraints once for all: what comes later in the dialogue but
    earlier by them loses its edge. Only files and blocks with such segments are looked at."""
    dialogue = [F.col("place").asc_nulls_last(), F.col("snippet_id").asc()]
    narrow = runs.select("snippet_id", "audio_key", "at", "cue", "place")
    files = narrow.where("at is null").select("audio_key").distinct()
    timed = _running_max(narrow.join(files, "audio_key", "left_semi"), ["audio_key"], dialogue, "at", "latest").where("at is null and latest is not null").select("snippet_id", F.col("latest").alias("given"))
    runs = runs.join(timed, "snippet_id", "left").withColumn("at", F.coalesce("at", "given")).drop("given")
    narrow = runs.select("snippet_id", "audio_key", "at", "cue", "place")
    blocks = narrow.groupBy(F.col("audio_key").alias("k"), F.col("at").alias("t")).agg(F.count("*").alias("n"), F.count("cue").alias("cues")).where("n > 1 and cues > 0 and cues < n").drop("n", "cues")
    tied = narrow.join(blocks, (F.col("audio_key") == F.col("k")) & F.col("at").eqNullSafe(F.col("t")), "left_semi")
    cued = _running_max(tied, ["audio_key", "at"], dialogue, "cue", "latest").where("cue is null and latest is not null").select("snippet_id", F.col("latest").alias("given"))
    return runs.join(cued, "snippet_id", "left").withColumn("cue", F.coalesce("cue", "given")).drop("given")


def _fragments(with_text: bool):
    """The turns of each file as far as this partition holds it, a row each, or with texts a row for each of its spans (seq from 0). `known` is false for a leading
    fragment without label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows: list[tuple] = []

        def put(key: str, turns: list[list], is_first: bool, is_last: bool) -> None:
            for n, (speaker, known, snippet, n_words, spans) in enumerate(turns):
                for seq, (of, text) in enumerate(spans or [(None, None)]):
                    rows.append((key, part, n, speaker, known, snippet, n_words, len(spans), is_first, is_last, seq, of, text))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in SPAN.split(", ")])
            rows.clear()
            return out

        key, turns, now, known, started, first_key = None, [], None, False, False, True
        for snippet, k, _, _, _, speakers, words, texts in _in_order(batches):
            if not started or k != key:
                if started:
                    put(key, turns, first_key, False)
                    first_key = False
                    if len(rows) >= 10_000:
                        yield batch_of()
                key, turns, now, known, started = k, [], None, False, True
            for i, (speaker, n) in enumerate(zip(speakers, words)):
                if speaker is not None:
                    now, known = speaker, True
                if n:
                    if not (turns and turns[-1][0] == now and turns[-1][1] == known):
                        turns.append([now, known, snippet, 0, []])
                    turns[-1][3] += n
                    if with_text:
                        turns[-1][4].append((snippet, texts[i]))
        if started:
            # The label that holds at the end of the partition, for the file's next part: a fragment without words.
            if known and (not turns or turns[-1][0] != now):
                turns.append([now, True, None, 0, []])
            put(key, turns, first_key, True)
        if rows:
            yield batch_of()

    return run


def _parts(snippets: DataFrame, filler_words: DataFrame, partitions: int | None, with_text: bool) -> DataFrame:
    """The written fragments (SPAN) of all files, in order."""
    from tidewave.storage import materialize

    spark = snippets.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    words = spark.sparkContext.broadcast([r[0] for r in filler_words.select("word").where("word is not null").distinct().collect()])
    rows = snippets.where(F.col("audio_key").isNotNull() & F.col("snippet_id").isNotNull()).select(
        F.col("snippet_id").cast("bigint"), "audio_key", F.col("audio_file_offset").cast("double"), F.col("audio_file_index").cast("int"), "diary_speaker_id", "content"
    )
    runs = rows.mapInArrow(_parse(words, with_text), RUNS).groupBy("snippet_id").agg(F.min(F.struct("audio_key", "at", "cue", "place", "speakers", "words", "texts")).alias("r")).select("snippet_id", "r.*")
    runs = _with_effective(materialize(runs, "runs"))
    order = ["audio_key", F.col("at").asc_nulls_first(), F.col("cue").asc_nulls_first(), F.col("place").asc_nulls_last(), "snippet_id"]
    ranged = runs.repartitionByRange(n, *order).sortWithinPartitions(*order[:2]).select("snippet_id", "audio_key", "at", "cue", "place", "speakers", "words", "texts")
    return materialize(ranged.mapInArrow(_fragments(with_text), SPAN), "fragments")


def speaker_turns(snippets: DataFrame, filler_words: DataFrame, partitions: int | None = None) -> DataFrame:
    """Speaker turns: audio_key, turn_no (from 1), speaker_no (null before the first label of a file), first_snippet_id, n_words.

    Snippets: snippet_id, audio_key, audio_file_offset, audio_file_index, diary_speaker_id, content. Each is parsed by itself into runs
    of words. Their order is one of precedence constraints, strongest first: timing (the offset, or where it is missing the clock reading in the text),
    cues (the clock reading) and dialogue order (index, then id). An edge that contradicts stronger ones is dropped and the rest is ordered topologically.
    Timing edges lead from each block of equal timing to the next, so cues and dialogue order only speak inside a block, and where a segment has no timing (see _with_effective, precedence).
    Files are cut by range partitions in places where no edge leads back, so one of any length is ordered in parts; each yields the turns of
    its part, and the first and last turns of a part are stitched to those of the next: at most a few rows a partition.
    Snippets without words (null or empty contents too) take no part, nor do their labels; a repeated id counts once; rows without
    an audio_key or id belong to no file; a label's number has at most 18 digits, longer ones are words. `filler_words` (word) is a fixed vocabulary that every worker holds, not a table that grows with the corpus."""
    spoken, fixes = _stitched(_parts(snippets, filler_words, partitions, False))
    whole = spoken.where(~(F.col("first") | F.col("last"))).select("audio_key", (F.col("n") + 1).cast("bigint").alias("turn_no"), F.col("speaker").alias("speaker_no"), "first_snippet_id", "n_words")
    cut = _numbered(spoken, fixes).groupBy("audio_key", "turn_no").agg(F.min(F.struct("part", "n", "first_snippet_id")).alias("f"), F.max("speaker").alias("speaker_no"), F.sum("n_words").alias("n_words"))
    return whole.unionByName(cut.select("audio_key", "turn_no", "speaker_no", F.col("f.first_snippet_id").alias("first_snippet_id"), "n_words"))


def turn_texts(snippets: DataFrame, filler_words: DataFrame, partitions: int | None = None) -> DataFrame:
    """The cleaned text of the turns of `speaker_turns`, a row for each span of a snippet: audio_key, turn_no, span_no (from 1), speaker_no, snippet_id, text
    (spoken words only, joined by blanks). A turn's text is its spans in order; it is not made one value, as a turn may be a whole file."""
    spans, fixes = _stitched(_parts(snippets, filler_words, partitions, True))
    out = ["audio_key", "turn_no", "span_no", F.col("speaker").alias("speaker_no"), "snippet_id", "text"]
    whole = spans.where(~(F.col("first") | F.col("last"))).withColumn("turn_no", (F.col("n") + 1).cast("bigint")).withColumn("span_no", F.col("seq") + 1)
    cut = _numbered(spans, fixes)
    before = Window.partitionBy("audio_key", "turn_no").orderBy("part", "n").rowsBetween(Window.unboundedPreceding, -1)
    # A turn has at most two fragments in a partition.
    skips = cut.where("seq = 0").select("audio_key", "part", "n", F.coalesce(F.sum("n_spans").over(before), F.lit(0)).alias("skip"))
    cut = cut.join(skips, ["audio_key", "part", "n"]).withColumn("span_no", F.col("seq") + 1 + F.col("skip"))
    return whole.select(*out).unionByName(cut.select(*out))


def _numbered(spoken: DataFrame, fixes: DataFrame) -> DataFrame:
    """The fragments of files that go on in another partition, with their speaker and the number of their turn in the file."""
    cut = spoken.where(F.col("first") | F.col("last")).join(F.broadcast(fixes), ["audio_key", "part"])  # two rows a partition
    cut = cut.withColumn("speaker", F.when(F.col("known"), F.col("speaker")).otherwise(F.col("came")))
    return cut.withColumn("turn_no", (F.col("n") + 1 + F.col("offset") - F.when(F.col("n") > 0, F.col("absorbed")).otherwise(0)).cast("bigint"))


def _stitched(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fragments with words, and what the first and last file of each partition take over from the partitions before: the speaker that holds (came) and the number
    of turns so far (offset, absorbed). A file's summary is a row for each partition it spans."""
    ends = parts.where((F.col("first") | F.col("last")) & (F.col("seq") == 0))
    summary = ends.groupBy("audio_key", "part").agg(
        F.min(F.struct("n", "speaker", "known")).alias("head"),
        F.max(F.struct("n", "speaker", "known", "n_words")).alias("tail"),
        F.sum((F.col("n_words") > 0).cast("int")).alias("turns"),
        F.max(F.when(F.col("n_words") > 0, F.struct("n", "speaker", "known"))).alias("spoken"),
        F.max(F.when((F.col("n") == 1) & (F.col("n_words") > 0), F.col("speaker"))).alias("second"),
    )
    before = Window.partitionBy("audio_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # The label that holds where the part begins, and who spoke last.
    summary = summary.withColumn("came", F.last(F.when(F.col("tail.known"), F.col("tail.speaker")), ignorenulls=True).over(before))
    summary = summary.withColumn("head_speaker", F.when(F.col("head.known"), F.col("head.speaker")).otherwise(F.col("came")))
    summary = summary.withColumn("spoken_speaker", F.when(F.col("spoken.known"), F.col("spoken.speaker")).otherwise(F.col("came")))
    # A struct around the speaker tells "nobody has spoken" from "spoken by an unknown speaker".
    said = F.last(F.when(F.col("turns") > 0, F.struct(F.col("spoken_speaker").alias("s"))), ignorenulls=True).over(before)
    summary = summary.withColumn("said", said)
    # Words without label at the head, then the same speaker by label: one turn.
    summary = summary.withColumn("absorbed", F.coalesce((~F.col("head.known") & (F.col("second") == F.col("came"))).cast("int"), F.lit(0)))
    joins = (F.col("turns") > 0) & F.col("said").isNotNull() & F.col("head_speaker").eqNullSafe(F.col("said.s"))
    summary = summary.withColumn("joined", joins.cast("int"))
    summary = summary.withColumn("offset", F.coalesce(F.sum(F.col("turns") - F.col("joined") - F.col("absorbed")).over(before), F.lit(0)) - F.col("joined"))
    return parts.where(F.col("n_words") > 0), summary.select("audio_key", "part", "came", "offset", "absorbed")
