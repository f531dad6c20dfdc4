import hashlib
import re
from collections import Counter, defaultdict

from lattica.llm import source_mixing as M

from . import cases


def shuffled(rows, size):
    """The hash of each row, equal rows told apart by their number."""
    seen, out = Counter(), []
    for (i, _, s), n in zip(rows, size, strict=True):
        seen[i, s, n] += 1
        out.append(hashlib.md5(f"{'' if i is None else i}:{n}:{seen[i, s, n]}".encode()).hexdigest())
    return out


def brute(rows):
    """Targets by raising a level step by step, taken by walking the streams word by word."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    own = defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        own[s] += n
    keys = shuffled(rows, size)
    names = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    capped, total = set(), 1.5 * sum(size)
    while True:
        left = total - sum(2.0 * own[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        new = {s for s in names if s not in capped and 2.0 * own[s] / weight[s] < left / w}
        if not new:
            break
        capped |= new
    target = {s: 2.0 * own[s] if s in capped else left / w * weight[s] for s in names}
    taken = [0] * len(rows)
    for s in names:
        order = sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (keys[k], size[k]))
        left = int(target[s] + 0.5)
        for _ in range(2):
            for k in order:
                n = min(left, size[k])
                taken[k] += n
                left -= n
    return sorted([(i, n, own[s], target[s], t) for (i, _, s), n, t in zip(rows, size, taken, strict=True)], key=str)


def rows_of(df):
    return sorted([tuple(r)[:5] for r in df.collect()], key=str)


def brute_slots(rows, block):
    """Each row's first slot and number of slots, by a walk over the slots and words one by one."""
    told = {(i, n, own, target): 0 for i, n, own, target, _ in brute(rows)}
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    quota = {s: int(next((t for _, _, o, t in told if o == own[s] and any(r[2] == s for r in rows)), 0) + 0.5) for s in names}
    for i, t, s in rows:
        quota[s] = int(next(x for d, n, o, x in told if d == i and o == own[s] and n == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) + 0.5)
    total, slots = sum(quota.values()), []
    for i in range(-(-total // block)):
        x = min(total - 1, int((i % (1 << 31) * 2654435769 % (1 << 32)) / float(1 << 32) * float(total)))
        for s in names:
            if x < quota[s]:
                slots.append((i, s))
                break
            x -= quota[s]
    slots += [(len(slots) + k, s) for k, s in enumerate(s for s in names if quota[s] and s not in {y for _, y in slots})]
    met, keys = [set() for _ in rows], shuffled(rows, size)
    for s in names:
        mine = [i for i, y in slots if y == s]
        width = -(-quota[s] // len(mine)) if mine else 1
        order = sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (keys[k], size[k]))
        for at, k in enumerate(k for k in order * 2 for _ in range(size[k])):
            if at >= quota[s]:
                break
            met[k].add(mine[at // width])
    return sorted(((i, n, min(m) if m else None, len(m)) for (i, _, _), n, m in zip(rows, size, met, strict=True)), key=str)


def test_against_brute_force(spark):
    docs = cases.documents(spark)
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    for block in (64, M.BLOCK):
        assert rows_of(M.plan(docs, block)) == brute(rows)
        assert sorted(((r.doc_id, r.size, r.first_slot, r.n_slots) for r in M.plan(docs, block).collect()), key=str) == brute_slots(rows, block)
    assert rows_of(M.plan(cases.empty(spark))) == []


def test_one_source_and_no_words(spark):
    one = spark.createDataFrame([(1, "a b c", "s"), (2, "d", "s"), (3, "", "t"), (4, None, "t")], "doc_id long, text string, source string")
    assert rows_of(M.plan(one, 2)) == brute([(1, "a b c", "s"), (2, "d", "s"), (3, "", "t"), (4, None, "t")])
    assert all(r.taken == 0 and r.target == 0 for r in M.plan(one.where("doc_id > 2")).collect())


def test_schedule_follows_the_shares_all_along(spark):
    from lattica.llm.store import saved

    quotas = {1: 60_000, 2: 25_000, 3: 15_000}
    slots = sorted(M.schedule(saved(spark.createDataFrame(list(quotas.items()), "sid int, quota long")), 100).collect())
    assert sum(r.words for r in slots) == 100_000
    for n in (50, 200, 900):
        share = defaultdict(int)
        for r in slots[:n]:
            share[r.sid] += 1
        assert all(abs(share[s] - n * q / 100_000) < 6 for s, q in quotas.items())
    ranks = defaultdict(list)
    for r in slots:
        ranks[r.sid].append(r.rank)
    assert all(x == list(range(len(x))) for x in ranks.values())


def test_a_tiny_source_costs_one_slot(spark):
    from lattica.llm.store import saved

    quotas = [(k, 1) for k in range(1, 40, 2)] + [(2, 1_000_000), (4, 500_000)]
    slots = sorted(M.schedule(saved(spark.createDataFrame(quotas, "sid int, quota long"))).collect())
    assert len(slots) <= -(-1_500_020 // M.BLOCK) + len(quotas)
    late = [r.slot for r in slots if r.sid % 2 and r.sid > 1]  # the first point falls to the first source
    assert late == list(range(-(-1_500_020 // M.BLOCK), -(-1_500_020 // M.BLOCK) + 19))
    held = defaultdict(int)
    for r in slots:
        held[r.sid] += r.words
    assert held == dict(quotas)


def test_mixed_comes_by_slot(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    first = {r.doc_id: r.first_slot for r in M.plan(docs).collect()}
    order = [r.doc_id for r in M.mixed(docs).collect()]
    once = [i for i in dict.fromkeys(order)]
    assert [first[i] for i in once] == sorted(first[i] for i in once)


def test_mixed_repeats_documents(spark):
    docs = cases.documents(spark)
    out = M.mixed(docs)
    assert out.columns == docs.columns
    times = defaultdict(int)
    for r in out.select("doc_id", "text").collect():
        times[r.doc_id] += 1
    for i, n, _, _, t in brute([(r.doc_id, r.text, r.source) for r in docs.dropDuplicates(["doc_id"]).select("doc_id", "text", "source").collect()]):
        if n > 5000 and t in (0, 2 * n):
            assert times[i] == t // n


def test_rows_without_id_and_copies_spread_over_the_ranges(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(M, "PART", 700)
    i = F.col("id")
    doc = F.when(i < 20_000, F.lit(None).cast("long")).when(i < 30_000, F.lit(7)).otherwise(i)
    rows = spark.range(60_000).select(F.lit(1).alias("sid"), doc.alias("doc_id"), F.when(i < 30_000, i % 3).otherwise(i % 50).alias("size"))
    keyed = M.keyed(rows, 60_000)
    cells = sorted(r["count"] for r in keyed.groupBy("cell").count().collect())
    assert sum(cells) == 60_000 and cells[-1] < 4 * cells[len(cells) // 2]
    assert keyed.select("key").distinct().count() == 60_000
    assert sorted(tuple(r) for r in keyed.groupBy("doc_id", "size").count().where("count > 1").fillna(-1).collect()) == sorted(tuple(r) for r in rows.groupBy("doc_id", "size").count().where("count > 1").fillna(-1).collect())
    placed = M.streams(rows)
    assert placed.select("pos").distinct().count() == 60_000 and placed.agg(F.max(F.col("lo") + F.col("size"))).first()[0] == rows.agg(F.sum("size")).first()[0]
