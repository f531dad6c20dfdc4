import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import token_alignment as T

from . import cases


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = T.default_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=path_b), T.Aligner(path_a, path_b)


def spelled_a(a, ids):
    letters = T.byte_letters()
    return [bytes(letters[c] for c in a.id_to_token(i)) for i in ids]


def spelled_b(b, ids):
    return [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids)]


def plain(tools, text):
    """(n_a, n_b, n_groups, links, groups text) of the whole text by loops, or None."""
    a, b, _ = tools
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a, bytes_b = spelled_a(a, ids_a), spelled_b(b, ids_b)
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    spans_a, spans_b, links, j = spans(bytes_a), spans(bytes_b), [], 0
    for x, (s, e) in zip(ids_a, spans_a, strict=True):
        while spans_b[j][1] <= s:
            j += 1
        k = j
        while k < len(spans_b) and spans_b[k][0] < e:
            links.append((x, ids_b[k]))
            k += 1
    both = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
    groups, at = [], 0
    for end in both:
        inside = lambda ids, sp, lo=at, hi=end: ",".join(str(i) for i, (s, e) in zip(ids, sp, strict=True) if lo <= s and e <= hi)
        groups.append((at, end, inside))
        at = end
    if len(ids_a) < 3000:
        said = ";".join(f"{f(ids_a, spans_a)}|{f(ids_b, spans_b)}" for _, _, f in groups)
    else:
        by = {"a": defaultdict(list), "b": defaultdict(list)}
        import bisect

        for side, ids, sp in (("a", ids_a, spans_a), ("b", ids_b, spans_b)):
            for i, (_, e) in zip(ids, sp, strict=True):
                by[side][bisect.bisect_left(both, e)].append(str(i))
        said = ";".join(",".join(by["a"][g]) + "|" + ",".join(by["b"][g]) for g in range(len(both)))
    return len(ids_a), len(ids_b), len(both), links, said


def brute(tools, rows):
    found = [plain(tools, t) for _, t in rows]
    count = Counter(p for x in found if x for p in set(x[3]))
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for (doc_id, _), x in zip(rows, found, strict=True):
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, said = x
        best = sum(count[p] == highest[p[0]] for p in links)
        out.append((doc_id, n_a, n_b, n_groups, len(links), best, sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=str)


AWKWARD = ["▁ x", "a▁b", " lead", "trail ", "two  spaces", "tab\t x\n y \n z", "  nb  x", "<|endoftext|> <s> </s> <unk> <0x41>", "ﬁ ligature Ω", "日本語 のテキスト", "\x00 nul", " ", "\n", "it's we'll 12345 $$$###", "᠎ x ᠎", "x" * 5000, "é a"]


def test_against_brute_force(spark, tools):
    docs = cases.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(5000 + k, t) for k, t in enumerate(AWKWARD)]
    more = spark.createDataFrame(rows[-len(AWKWARD) :], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(more)
    want = brute(tools, rows)
    assert got(T.alignment(docs)[0]) == want
    assert got(T.alignment(docs, parts=5, group=50)[0]) == want  # many ranges and salts


def test_clashing_columns_and_empty_table(spark, tools):
    rows = [(1, "one two"), (None, "one two"), (1, "one two"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide = docs.withColumns({n: docs.doc_id for n in ("doc_no", "n_a", "pairs", "times", "range", "salt", "kind", "a", "b", "n", "best")})
    assert got(T.alignment(wide)[0]) == brute(tools, rows)
    assert T.alignment(cases.empty(spark))[0].collect() == []


def test_table_of_pairs(spark, tools):
    rows = [(k, t) for k, t in enumerate(cases.texts()[:30])]
    pairs = T.alignment(spark.createDataFrame(rows, "doc_id long, text string"), parts=3, group=10)[1]
    count = Counter(p for _, t in rows if (x := plain(tools, t)) for p in set(x[3]))
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(count)


def test_query_over_whole_table(spark, tools):
    sf = "/root/testdata/sf0.001"
    from lattica.llm.registry import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op13_postings_alignment"](spark, sf)) == brute(tools, rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t ab'1.é▁日", max_size=30), max_size=6))
def test_units_tokenise_as_whole_texts(tools, texts):
    for text, x in zip(texts, tools[2].documents(texts), strict=True):
        want = plain(tools, text)
        assert (x is None) == (want is None)
        if x:
            assert x[0] == (*want[:3], len(want[3])) and x[1] == hashlib.sha256(want[4].encode()).hexdigest()
            links = Counter(a << 16 | b for a, b in want[3])
            assert dict(zip(x[2].tolist(), x[3].tolist(), strict=True)) == dict(links)


def test_slices_and_forgetting_change_nothing(tools, monkeypatch):
    rng = random.Random(5)
    texts = [cases.prose(rng, 3000), "x " * 4000, cases.prose(rng, 500) + "  \n " + cases.prose(rng, 500)]
    want = [plain(tools, t) for t in texts]
    monkeypatch.setattr(T, "SLICE", 700)
    monkeypatch.setattr(T.slices, "__defaults__", (700,))
    small = T.Aligner(*T.default_paths(), limit=50)
    for _ in range(2):
        for x, w in zip(small.documents(texts), want, strict=True):
            assert x[0] == (*w[:3], len(w[3])) and x[1] == hashlib.sha256(w[4].encode()).hexdigest()
            assert x[3].sum() == len(w[3]) and len(x[2]) == len(set(w[3]))


def test_ranges_hold_hot_ids_in_salts():
    first, salts = T.ranges([(a, 10, 100) for a in range(100)] + [(500, 2000, 100_000), (501, 5, 10)], parts=4, group=1000)
    assert list(first) == sorted(first) and first[0] == 0
    of = int((first <= 500).sum()) - 1
    assert salts[of] >= 10 and salts.min() >= 1
    assert [len(x) for x in T.ranges([])] == [1, 1]
