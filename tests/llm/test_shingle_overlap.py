import random
import re

import pytest

from lattica.llm import shingle_overlap as O
from lattica.llm import stages

from . import cases
from .test_near_copies import UPPER, roots


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    return roots(sets, [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])])


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"other{rng.random()}"
    return " ".join(words)


def texts():
    """Documents with up to 8 changed words, chains of changes and a group of many distinct near copies."""
    rng = random.Random(8)
    out = []
    for size, n in ((100, 1), (100, 2), (100, 4), (300, 4), (300, 12), (1000, 8), (12, 1), (7, 1)):
        for _ in range(6):
            base = cases.prose(rng, size)
            out += [base, edited(rng, base, n)]
    chain = cases.prose(rng, 200)
    for _ in range(12):
        out.append(chain)
        chain = edited(rng, chain, 3)
    many = cases.prose(rng, 150)
    out += [edited(rng, many, rng.randint(1, 4)) for _ in range(60)]
    long = cases.prose(rng, 2300)
    out += [edited(rng, long, n) for n in (20, 45, 60, 80)] + [edited(rng, long, 30) + " " + cases.prose(rng, n) for n in (100, 300, 500, 800)]
    passage = cases.prose(rng, 60)
    out += [f"{cases.prose(rng, rng.randint(3, 60))} {passage}" for _ in range(40)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("rounds", [0, 5])
def test_components_are_those_of_all_pairs(spark, monkeypatch, rounds):
    monkeypatch.setattr(O, "ROUNDS", rounds)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in O.near_copies(df).collect()} == brute(rows)


def test_stage_drops_every_near_copy(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in stages.near_copies(spark, df, None).collect()} == set(brute(rows).values())


def test_awkward_documents(spark):
    docs = cases.documents(spark).where("doc_id is not null")
    rows = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.component_id for r in O.near_copies(docs).collect()} == brute(rows)
    assert O.near_copies(cases.empty(spark)).collect() == []
