import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewave.llm import lookalikes
from tidewave.llm.lookalikes import consistent_form as form


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", ""), ("plain", "plain"), ("Ｇｒｅｍ，", "Grem,"), ("ofﬁce ﬂow", "office flow"), ("a b c d", "a b c d"), ("résumé", "résumé"), ("mor­t​g﻿⁠age", "mortgage"),
        ("thе аll costо́", "the all costó"), ("Roѕinell іѕ", "Rosinell is"), ("Beдущий сказaл, чтo хoтят", "Ведущий сказал, что хотят"), ("Αsk Ζella drοught", "Ask Zella drought"),
        ("\U0001f469‍\U0001f33e ok‍", "\U0001f469‍\U0001f33e ok"), ("x² ½ …", "x² ½ …"), ("й ёж", "й ёж"), ("λόγος ο", "λόγος ο"), ("who one", "who one"), ("ꓮꓐ ᎪᏴ ⲟne ɑnd ɡo\u3164\u180b", "AB AB one and go"), ("До войны. DRALENMOOR, THE LATE", "До войны. DRALENMOOR, THE LATE"), ("漢字カナ ひらがなー", "漢字カナ ひらがなー"), ("а storm, сказал а потом", "a storm, сказал а потом"), ("line\nbreak\ttab  two", "line\nbreak\ttab  two"),
    ],
)
def test_forms(text, want):
    assert form(text) == want and form(form(text)) == form(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeopcxdk аеорсхд οΑ.́​ é１ﬁ", max_size=30), st.randoms())
def test_same_look_same_form(text, rnd):
    back = {}
    for table in lookalikes.SCRIPTS.values():
        for k, v in table.items():
            back.setdefault(v, []).append(k)
    twin = "".join(rnd.choice([c, *back.get(c, [])]) for c in text)
    assert form(twin) == form(text) and form(form(text)) == form(text)


def test_pairs_and_classes(spark):
    rows = [(1, "the cat", "x"), (2, "thе cat", "x"), (3, "the cat", "x"), (4, "the cat", "x"), (5, "thé cat", "x"), (6, None, "x"), (7, "", "x"), (8, "​", "x"), (2, "thе cat", "x"), (None, "the cat", "x"), (9, "z" * 200000, "x"), (10, "z" * 200000 + "​", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form_key string")
    want = {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8), (9, 10)}
    for hot in (1, 1000):
        got = [tuple(r) for r in lookalikes.same_look_pairs(df, hot_rows=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    classes = {r.doc_id: (r.class_id, r.n_members, r.n_spellings) for r in lookalikes.look_classes(df).collect()}
    assert classes[3] == (1, 4, 3) and classes[5] == (5, 1, 1) and classes[8] == (7, 2, 2)
    assert lookalikes.same_look_pairs(df.limit(0)).count() == 0
    assert {r.doc_id: r.form for r in lookalikes.to_consistent_form(df).collect() if r.doc_id in (4, 6)} == {4: "the cat", 6: None}


def test_words_in_several_scripts(spark):
    rows = [(1, "the Roѕinell іѕ plain"), (2, "іѕ іѕ here"), (2, "іѕ іѕ here"), (3, "Все слова здесь"), (4, None), (5, "")]
    got = {(r.word, r.spelled, r.kind, r.n, r.n_docs) for r in lookalikes.confusable_words(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {("Roѕinell", "Rosinell", "mixed", 1, 1), ("іѕ", "is", "whole", 3, 2)}


def test_a_public_table_of_look_alikes(spark, tmp_path):
    path = tmp_path / "confusables_test.txt"
    path.write_text("\ufeff# comment\n0131 ;\t0069 ;\tMA\t# ( ı → i )\n0030 ; 004F ; MA # 0 to O, not read\n0057 0057 ; 0041 ; MA\n", encoding="utf-8")
    df = spark.createDataFrame([(1, "mıne"), (2, "mine"), (3, "0ne")], "doc_id bigint, text string")
    assert lookalikes.read_confusables(path.read_text(encoding="utf-8").splitlines()) == {"ı": "i"}
    assert {r.doc_id: r.form for r in lookalikes.to_consistent_form(df, confusables=str(path)).collect()} == {1: "mine", 2: "mine", 3: "0ne"}
    assert [tuple(r) for r in lookalikes.same_look_pairs(df, confusables=str(path)).collect()] == [(1, 2)] and lookalikes.same_look_pairs(df).isEmpty()
