import random

from tidewave.llm import leakage


def test_by_brute_force(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, "s", " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(5, 60)))) for i in range(30)] + [(90, "s", None), (91, "s", ""), (5, "s", "short one")]
    docs = []
    for i in range(200):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 80))]
        if rnd.random() < 0.6:
            p = rnd.choice(items[:30])[2].split()
            a = rnd.randrange(len(p))
            w[rnd.randrange(len(w) + 1) : 0] = p[a : a + rnd.randrange(10, 30)]
        docs.append((i, " ".join(x.upper() if rnd.random() < 0.1 else x for x in w)))
    docs += [(1000, None), (1001, ""), (1002, "w1 " * 20000), (3, docs[3][1])]
    runs = lambda t, n: {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
    for n in (8, 16):
        want = {(d, i) for d, t in docs if t for i, _, p in items if p and runs(t.lower().split(), n) & runs(p.split(), n)}
        for block in (40, 10**6):
            got = [tuple(r) for r in leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, suite string, passage string"), n, block).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_forms_and_empty(spark):
    p = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    d = "x " + p.replace("one", "ОNЕ").replace(" two", ", two").replace("ten", "ｔｅｎ").replace("six ", "s​ix ") + " y"
    mk = lambda rows, s: spark.createDataFrame(rows, s)
    assert leakage.leaked_items(mk([(1, d)], "doc_id bigint, text string"), mk([(7, p)], "item_id bigint, passage string")).count() == 1
    assert leakage.leaked_items(mk([(1, d)], "doc_id bigint, text string"), mk([], "item_id bigint, passage string")).count() == 0
    assert leakage.leaked_items(mk([], "doc_id bigint, text string"), mk([(7, p)], "item_id bigint, passage string")).count() == 0
