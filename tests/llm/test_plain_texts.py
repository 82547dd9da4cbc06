import sys

import pytest

from tidewave.llm import lookalikes
from tidewave.llm.lookalikes import consistent_form as form


def test_the_shortcut_equals_the_full_path():
    for i in (*range(0xD800), *range(0xE000, sys.maxunicode + 1)):
        c = chr(i)
        if lookalikes._PLAIN.fullmatch(c):
            assert (form(c), form(f"a{c}b")) == (lookalikes._full_form(c), lookalikes._full_form(f"a{c}b")), hex(i)


@pytest.mark.parametrize(("text", "twin"), [("5 µm", "5 μm"), ("on‑air", "on‐air"), ("ǆep", "džep"), ("ĳs", "ijs"), ("ſong", "song"), ("₨ 5", "Rs 5"), ("ℹ", "i"), ("ŉ", "ʼn")])
def test_twins_have_one_form(text, twin):
    assert form(text) == form(twin) == form(twin + "​")


def test_twins_are_found(spark):
    df = spark.createDataFrame([(1, "on‑air at 5 µm"), (2, "on‐air at 5 μm"), (3, "on-air at 5 um")], "doc_id bigint, text string")
    assert [tuple(r) for r in lookalikes.same_look_pairs(df).collect()] == [(1, 2)]
