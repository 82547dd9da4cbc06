import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewave.llm import packing


def check(rows, sizes, capacity):
    per, bins = {}, {}
    for item, piece, n, b in rows:
        per.setdefault(item, []).append((piece, n))
        bins[b] = bins.get(b, 0) + n
        assert (n > 0) == (b > 0)
    assert {i: sum(n for _, n in v) for i, v in per.items()} == sizes
    assert all(len(v) == 1 or sizes[i] > capacity for i, v in per.items())
    assert all(v <= capacity for v in bins.values())
    return len([b for b in bins if b])


def first_fit_decreasing(sizes, capacity):
    whole = sum(s // capacity for s in sizes if s > capacity)
    rest = sorted((s % capacity if s > capacity else s for s in sizes), reverse=True)
    room = []
    for s in (x for x in rest if x):
        at = next((i for i, r in enumerate(room) if r >= s), None)
        if at is None:
            room.append(capacity - s)
        else:
            room[at] -= s
    return whole + len(room)


def test_whole_items_and_few_bins(spark):
    rnd = random.Random(8)
    sizes = {i: rnd.choice([0, 1, 7, 100, 513, 1024, 1025, 5000, rnd.randrange(1, 1500)]) for i in range(1500)} | {5000 + i: 300 for i in range(800)}
    rows = list(sizes.items()) + list(sizes.items())[:100] + [(None, 5), (7777, None)]
    out = packing.packed(spark.createDataFrame(rows, "item_id bigint, n_tokens bigint"), 1024)
    n = check([tuple(r[c] for c in ("item_id", "piece", "n_tokens", "container_id")) for r in out.collect()], sizes, 1024)
    assert n <= first_fit_decreasing(sizes.values(), 1024) * 1.01 + 2
    plain = packing.packed(spark.createDataFrame(rows, "item_id bigint, n_tokens bigint"), 1024, fill=False)
    rows_of = [tuple(r[c] for c in ("item_id", "piece", "n_tokens", "container_id")) for r in plain.collect()]
    assert n <= check(rows_of, sizes, 1024)
    # Every container but one of a class holds the class's number of items, and of no other class.
    held = {}
    for _, _, t, b in rows_of:
        if t:
            held.setdefault(b, []).append(1024 // t)
    assert all(len(set(v)) == 1 and len(v) <= v[0] for v in held.values())
    short = [v[0] for v in held.values() if len(v) < v[0]]
    assert len(short) == len(set(short))


def test_a_large_capacity(spark):
    rnd = random.Random(9)
    sizes = {i: int(10 ** rnd.uniform(0, 5.3)) for i in range(4000)}
    out = packing.packed(spark.createDataFrame(list(sizes.items()), "item_id bigint, n_tokens bigint"), 131_072)
    n = check([tuple(r[c] for c in ("item_id", "piece", "n_tokens", "container_id")) for r in out.collect()], sizes, 131_072)
    assert n <= sum(sizes.values()) / 131_072 * 1.03 + 2


def test_grades_stay_in_their_class(spark):
    for capacity in (1, 7, 1024, 131_072):
        g = spark.range(1, capacity + 1).select("id", packing.class_of(F.col("id"), capacity).alias("k"), packing.grade_of(F.col("id"), capacity, 512).alias("g"))
        bad = g.where((F.col("g") < F.col("id")) | (packing.class_of(F.col("g"), capacity) != F.col("k"))).count()
        assert bad == 0 and g.select("g").distinct().count() <= 4000


def test_what_is_kept(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 9), (3, 0)], "item_id bigint, n_tokens bigint")
    assert tuple(packing.kept(sizes, packing.packed(sizes, 8), 8).select("n_items", "n_split", "n_wrong", "n_overfull").first()) == (3, 0, 0, 0)
    wrong = spark.createDataFrame([(1, 3, 7), (1, 2, 7), (2, 9, 8)], "item_id bigint, n_tokens bigint, container_id bigint")
    assert tuple(packing.kept(sizes, wrong, 8).select("n_items", "n_split", "n_wrong", "n_overfull").first()) == (2, 1, 1, 1)


def test_empty_and_only_empty_items(spark):
    assert packing.packed(spark.createDataFrame([], "item_id bigint, n_tokens bigint")).count() == 0
    assert [(r.item_id, r.container_id) for r in packing.packed(spark.createDataFrame([(1, 0), (2, 0)], "item_id bigint, n_tokens bigint")).collect()] in ([(1, 0), (2, 0)], [(2, 0), (1, 0)])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_item(histogram):
    placed = {}
    for bins, pattern in packing.fill_plan(histogram, 64):
        assert sum(s * k for s, k in pattern) <= 64 and bins > 0
        for s, k in pattern:
            placed[s] = placed.get(s, 0) + k * bins
    assert placed == histogram


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_filling_never_opens_more(histogram):
    """Containers by plain harmonic classes are a bound for the filled ones."""
    classes = {}
    for s, n in histogram.items():
        classes[64 // s] = classes.get(64 // s, 0) + n
    assert sum(bins for bins, _ in packing.fill_plan(histogram, 64)) <= sum(-(-n // k) for k, n in classes.items())


def test_token_lengths(spark):
    texts = ["", None, "hello world", "<|endoftext|>", "é" * 3000, "a b " * 60000]
    got = {r.item_id: r.n_tokens for r in packing.token_lengths(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.TOKENIZER)
    t.encode_special_tokens = True
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
