import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import infilling as I
from lattica.llm.registry import ORACLES, QUERIES

from ..oracle import assert_same
from . import cases

UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
MARKED = [(2000 + k, t, None, None, 0) for k, t in enumerate(["a <P> b", "x<S>", "<M", "<<M>>", "< P>", "<P" + " " * 50, "é" * 40 + "<P>", "w " * 90 + "<S" * 40 + "> z"])]


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, digest(text), digest(text))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), digest(out), digest(text))


@pytest.mark.parametrize("chunk,block", [(I.CHUNK, I.BLOCK), (97, 3), (16, 2)])
def test_against_brute_force_at_every_size_of_chunk(spark, chunk, block):
    base = cases.documents(spark)
    docs = base.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(MARKED, "doc_id long, text string, lang string, source string, n_chars long"))
    if chunk < 50:
        docs = docs.where("length(text) < 20000 or text is null")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in I.infilled(docs.withColumns({c: docs.n_chars for c in ("hash", "no", "block", "n", "form")}), chunk=chunk, block=block, whole=False).select(*I.DIGESTS).collect()]
    assert sorted(got, key=str) == sorted([brute(*r) for r in rows], key=str)


def test_whole_rows_carry_the_parts(spark):
    docs = cases.documents(spark)
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    forms = set()
    for r in I.infilled(docs, chunk=200).where("doc_id is not null").collect():
        forms.add(r.form)
        if r.form != "plain":
            assert r.prefix + r.middle + r.suffix == text[r.doc_id] and len(r.prefix) == r.prefix_chars and len(r.middle) == r.middle_chars
            assert r.output == I.rendered(r.form, r.prefix.encode(), r.middle.encode(), r.suffix.encode()).decode()
        else:
            assert r.output == (text[r.doc_id] or "")
    assert forms == {"plain", "psm", "spm"}


def test_repeated_long_rows_and_empty_table(spark):
    row = (7, "one two three " * 40)
    docs = spark.createDataFrame([row] * 3 + [(None, row[1]), (7, row[1] + "x")], "doc_id long, text string")
    got = sorted([tuple(r) for r in I.infilled(docs, chunk=50, block=2, whole=False).select(*I.DIGESTS).collect()], key=str)
    assert got == sorted([brute(*row)] * 3 + [brute(None, row[1]), brute(7, row[1] + "x")], key=str)
    assert I.infilled(cases.empty(spark)).collect() == []


ALPHABET = st.text(alphabet=" \n<PSM>aé", max_size=60)


@settings(max_examples=200, deadline=None)
@given(ALPHABET, st.lists(st.integers(1, 7), min_size=1, max_size=30))
def test_chunks_compose_to_the_whole_scan(text, sizes):
    data, at, parts, k = text.encode(), 0, [], 0
    while at < len(data):
        parts.append(data[at : at + sizes[k % len(sizes)]])
        at += len(parts[-1])
        k += 1
    for entry in I.STATES:
        state, n_ends, n_marks = entry, 0, 0
        for byte in data:
            state, e, m = I.step(state, byte)
            n_ends, n_marks = n_ends + e, n_marks + m
        at, got = entry, [0, 0]
        for p in parts:
            exits, all_ends, all_marks = I.scanned(p)
            got = [got[0] + all_ends[at], got[1] + all_marks[at]]
            at = exits[at]
        assert (at, *got) == (state, n_ends, n_marks)
    assert not data or n_units(text) == sum_ends(data) + 1


def n_units(text):
    return len(UNIT.findall(text))


def sum_ends(data):
    return I.scanned(data)[1][I.SPACE]


@settings(max_examples=100, deadline=None)
@given(*[st.text(alphabet=" <PSM>a", max_size=9)] * 3, st.sampled_from(["psm", "spm"]))
def test_text_is_rebuilt_from_output_and_form(a, b, c, form):
    if not any(m in a + b + c for m in ("<P>", "<S>", "<M>")):
        assert I.restored(form, I.rendered(form, a.encode(), b.encode(), c.encode())) == (a + b + c).encode()


def test_query_is_its_sql(spark):
    name = "op11_automaton_infilling"
    assert_same(QUERIES[name](spark, "/root/testdata/sf0.01"), ORACLES[name], "/root/testdata/sf0.01")
