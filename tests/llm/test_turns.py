import random

from tidewave.llm import turns

F8 = turns.Fillers(["um", "uh", "er", "erm", "ah", "eh", "hm", "mm"])
SCHEMA = "snippet_id bigint, audio_key string, audio_file_offset double, audio_file_index int, diary_speaker_id string, content string, part string, n int"


def test_labels():
    for text, want in {"SPEAKER_01": 1, " s2 ": 2, "SPK 003": 3, "Speaker Four": 4, "speaker-5": 5, "spk6": 6, "S7": 7, "unknown": None, "": None, None: None, "session": None}.items():
        assert turns.label_number(text) == want


def test_runs():
    r = lambda c, d=None: turns.runs_of(c, d, F8)
    assert r("hello um there", "S1") == [(1, 2)]
    assert r("a b Speaker Two: c >> S3: d [Speaker 4] e (speaker one) f S2 - g", None) == [(None, 2), (2, 1), (3, 1), (4, 1), (1, 1), (2, 1)]
    assert r("SPEAKER 3: [00:00:37] Right <breath/> and *sighs* 00:02:02.340 don’t ♪ theme song ♪ {cough} (phone rings)", "S1") == [(3, 3)]
    assert r("Hmmm... ERRR UHHH eh, mm", "S1") == [] and r("", "S1") == [] and r(None, None) == []
    assert r("one two Speaker 5:", "S1") == [(1, 2), (5, 0)]
    assert r("it's 20 o'clock's well-known (unclosed", "S1") == [(1, 6)]
    assert r("w " * 50000, "S1") == [(1, 50000)]


def brute(rows):
    seen, out, key = set(), [], None
    for sid, k, at, _, label, content, *_ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2], r[0])):
        if sid in seen:
            continue
        seen.add(sid)
        if k != key:
            key, now, cur, no = k, None, None, 0
        for s, n in turns.runs_of(content, label, F8):
            now = s if s is not None else now
            if n:
                if cur is None or cur[2] != now:
                    no += 1
                    cur = [k, no, now, sid, 0]
                    out.append(cur)
                cur[4] += n
    return sorted(map(tuple, out), key=str)


def test_files_cut_into_many_partitions(spark):
    rnd = random.Random(6)
    fill = spark.createDataFrame([(w,) for w in ["um", "uh", None, "um"]], "word string")
    for trial in range(3):
        rows = []
        for i in range(300):
            k = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", "c"])
            content = rnd.choice(["x y", "um", "", None, "p Speaker 2: q", "z S1 - ", "(cough)", "w"])
            rows.append((i, k, float(i), rnd.randrange(9), rnd.choice([None, "", "S1", "S2", "unknown", None]), content, "clash", 1))
        rows += rows[:30] + [(None, "a", 1.0, 1, "S1", "x", "", 1), (9999, None, 1.0, 1, "S1", "x", "", 1)]
        rnd.shuffle(rows)
        for parts in (1, 4, 23):
            got = sorted((tuple(r[c] for c in ("audio_key", "turn_no", "speaker_no", "first_snippet_id", "n_words")) for r in turns.speaker_turns(spark.createDataFrame(rows, SCHEMA), fill, parts).collect()), key=str)
            assert got == brute(rows)


def test_ties_missing_offsets_and_empty(spark):
    fill = spark.createDataFrame([], "word string")
    assert turns.speaker_turns(spark.createDataFrame([], SCHEMA), fill).count() == 0
    rows = [(2, "k", 5.0, 1, "S2", "b", "", 0), (1, "k", 5.0, 0, "S1", "a", "", 0), (3, "k", None, 0, "S3", "00:00:07 c", "", 0), (4, "k", None, 0, "S4", "d", "", 0)]
    out = turns.speaker_turns(spark.createDataFrame(rows, SCHEMA), fill).orderBy("turn_no").collect()
    assert [(r.turn_no, r.speaker_no) for r in out] == [(1, 1), (2, 2), (3, 3), (4, 4)]


def joined(rows):
    turns_of = {}
    for r in sorted(rows, key=lambda r: (r.audio_key, r.turn_no, r.span_no)):
        turns_of.setdefault((r.audio_key, r.turn_no), []).append(r)
    assert all([r.span_no for r in v] == list(range(1, len(v) + 1)) for v in turns_of.values())
    return sorted(((k[0], k[1], v[0].speaker_no, v[0].snippet_id, sum(len(r.text.split()) for r in v)) for k, v in turns_of.items()), key=str)


def test_texts_of_turns_cut_into_many_partitions(spark):
    rnd = random.Random(16)
    fill = spark.createDataFrame([("um",)], "word string")
    rows = [(i, rnd.choice(["hot", "hot", "b"]), float(i), 0, rnd.choice([None, "", "S1", "S1"]), rnd.choice(["x um y", "um", "p Speaker 2: q (cough) r", "w"]), "", 1) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 17):
        spans = turns.turn_texts(df, fill, parts).collect()
        assert joined(spans) == brute(rows)
        assert {r.text for r in spans} <= {"x y", "p", "q r", "w"}


def turned(spark, rows, parts):
    rows = [(i, "k", at, place, f"S{i}", content, "", 0) for i, at, place, content in rows]
    out = turns.speaker_turns(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "word string"), parts)
    return [r.speaker_no for r in out.orderBy("turn_no").collect()]


def test_weaker_constraints_give_way(spark):
    for parts in (1, 3, 9):
        # Offsets 1, 2, 3 against cues and indexes that run the other way.
        assert turned(spark, [(1, 1.0, 9, "00:00:30 a"), (2, 2.0, 5, "00:00:20 b"), (3, 3.0, 1, "00:00:10 c")], parts) == [1, 2, 3]
        # Equal offsets: cues against indexes.
        assert turned(spark, [(1, 7.0, 3, "00:00:10 a"), (2, 7.0, 2, "00:00:20 b"), (3, 7.0, 1, "00:00:30 c")], parts) == [1, 2, 3]
        # No cue: the index places a segment between cues, or the edge that contradicts them falls.
        assert turned(spark, [(1, 7.0, 1, "00:00:10 a"), (2, 7.0, 2, "b"), (3, 7.0, 3, "00:00:20 c"), (4, 7.0, 0, "d")], parts) == [4, 1, 2, 3]
        assert turned(spark, [(1, 7.0, 1, "00:00:20 a"), (2, 7.0, 2, "b"), (3, 7.0, 3, "00:00:10 c")], parts) == [3, 1, 2]
        # No timing at all: after the latest that comes before it in the dialogue; a file without any is in dialogue order.
        assert turned(spark, [(1, 5.0, 1, "a"), (2, None, 2, "b"), (3, 9.0, 3, "c"), (4, None, 0, "d"), (5, 2.0, 4, "e")], parts) == [4, 5, 1, 2, 3]
        assert turned(spark, [(1, None, 3, "a"), (2, None, 2, "b"), (3, None, None, "c")], parts) == [2, 1, 3]


def test_edges_and_order():
    cues, places = [10.0, 10.0, 20.0, None], [(0, 2), (0, 1), (0, 0), (0, 3)]
    edges = turns.precedence(cues, places)
    assert (2, 1) not in edges and (1, 0) in edges and turns.topological(4, edges, [((c is not None, c or 0.0), p) for c, p in zip(cues, places)]) == [3, 1, 0, 2]


def test_long_numbers():
    assert turns.label_number("Speaker 1234567890") == 1234567890 and turns.label_number("Speaker " + "1" * 19) is None
    assert turns.runs_of("a Speaker 12345678901: b", None, F8) == [(None, 1), (12345678901, 1)]
    assert turns.runs_of("a Speaker " + "1" * 19 + ": b", None, F8) == [(None, 4)]
