import random

import numpy as np

from lattica.llm import substring_dedup as B

from . import cases


def brute(rows, window=50):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                s = tuple(w[k : k + window])
                least[s] = min(least.get(s, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in df.collect()], key=str)


def test_against_brute_force(spark):
    docs = cases.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(B.dedup(docs)) == brute(rows)
    assert rows_of(B.dedup(cases.empty(spark))) == []


def test_overlapping_and_repetitive_passages(spark):
    rng = random.Random(8)
    a, b = cases.prose(rng, 60), cases.prose(rng, 49)
    rows = [(1, f"{a} x {b}"), (2, f"{b} {a}"), (3, f"q {a} {a} {b}"), (4, "z " * 120), (5, "z " * 70 + a), (6, b), (7, f"{b} tail"), (8, f"{a} x {b}"), (2, f"{a} {b}"), (None, a), (-5, f"{b} tail")]
    got = rows_of(B.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)


def test_small_windows_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(B.dedup(docs, window=8, gram=3)) == brute(rows, 8)


def test_branching_passages_against_brute_force(spark):
    """Passages that leave each other at many words on both sides, some within one document."""
    rng = random.Random(10)
    vocabulary = [cases.prose(rng, 1) + str(k) for k in range(60)]
    stems = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(4)]
    rows = []
    for i in range(150):
        out = []
        for _ in range(rng.randrange(1, 4)):
            stem = list(rng.choice(stems))
            for _ in range(rng.choice((0, 1, 2))):
                stem[rng.randrange(30)] = rng.choice(vocabulary[:3])
            out += stem[rng.randrange(6) : 30 - rng.randrange(6)] + [rng.choice(vocabulary[:2])] * rng.randrange(2)
        rows.append((rng.randrange(120), " ".join(out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(B.dedup(docs, window=10, gram=4)) == brute(rows, 10)


def test_agreeing_words_on_both_sides():
    one, other = b"x a b S T c d".split(), b"a b S T c e f".split()
    assert B.agreeing(one, 3, other, 2, 2) == (2, 1)
    assert B.agreeing(one, 3, one, 3, 2) == (3, 2)
    assert B.agreeing(one[3:5], 0, other, 2, 2) == (0, 0)


def test_rolling_hashes_do_not_depend_on_place():
    h = np.random.default_rng(1).integers(0, 1 << 63, 200, dtype=np.uint64)
    both = np.concatenate([h, h[10:60], h])
    r = B.rolling(both, 50)
    assert r[10] == r[200] == r[260] and len(np.unique(r[:151])) == 151
    a = B.anchors(both, 50, 16)
    assert a[10] == a[200] == a[260] and len(a) == len(r)
    assert len(np.unique(a[:151])) < 40
