import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import simhash_vptree as S
from lattica.llm import store

from . import cases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(items, linked):
    """Brute force: each item's smallest of its component."""
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def test_fingerprints_by_definition(spark):
    docs = cases.documents(spark).where("length(text) < 20000 or text is null")
    want = {r.doc_id: plain_fingerprint(r.text) for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in S.fingerprints(docs).collect()}
    assert got == want


def test_components_of_awkward_documents(spark):
    docs = cases.documents(spark)
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    fp = {r.doc_id: r.fp & (1 << 64) - 1 for r in rows if r.doc_id is not None}
    want = roots(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    for r in rows:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
        else:
            assert r.component_id == min(i for i in fp if fp[i] == r.fp & (1 << 64) - 1)
    assert S.near_duplicates(cases.empty(spark)).collect() == []


def test_shards_grow_where_points_would_be_copied_too_often():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 1 << 63, 100_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 100_000, dtype=np.uint64)
    for total, most in ((100_000, 3.0), (1_000_000, 3.0), (10_000_000, 4.5)):
        tree, told = S.fitted(points[:50_000], total, 2)
        rows, shards = tree.route(points[50_000:])
        assert tree.leaves > 8 and len(rows) / 50_000 < most and told < most
        assert np.bincount(shards).max() / 50_000 * total < S.BLOCK


@pytest.mark.parametrize(("shard", "leaf", "block", "copies"), [(16, 16, 10_000, 99), (64, 20, 10_000, 99), (64, 20, 10_000, 3), (5000, 40, 10_000, 3), (100, 5000, 30, 99), (5000, 5000, 100, 3)])
def test_tree_finds_every_link(spark, shard, leaf, block, copies):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    flips = lambda x, n: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    points = np.unique(np.concatenate([centres, [flips(c, k % 4 + 1) for k, c in enumerate(centres)], [flips(centres[0], 2) for _ in range(120)], rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    node = np.random.default_rng(1).permutation(len(points))
    table = store.saved(spark.createDataFrame([(int(p.view(np.int64)), int(n)) for p, n in zip(points, node, strict=True)], "fp long, node long"))
    labels = {r.node: r.label for r in store.components(S.links(table, 2, shard=shard, leaf=leaf, block=block, copies=copies)).collect()}
    d = np.bitwise_count(points[:, None] ^ points)
    want = roots([int(n) for n in node], [(int(node[i]), int(node[j])) for i, j in np.argwhere(np.triu(d <= 2, 1))])
    assert {n: labels.get(n, n) for n in want} == want


def test_dense_leaves_are_compared_without_a_matrix(monkeypatch):
    rng = np.random.default_rng(3)
    bits = np.uint64(1) << rng.integers(0, 64, (400, 3), dtype=np.uint64)
    fp = np.unique(np.bitwise_or.reduce(bits, axis=1))
    own = rng.integers(0, 2, len(fp))
    whole = [S._leaf_roots(fp, o, 2) for o in (None, own)]
    monkeypatch.setattr(S, "LEAF", 10)
    assert all((S._leaf_roots(fp, o, 2) == w).all() for o, w in zip((None, own), whole, strict=True))


def test_route_covers_boundaries():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64))
    tree = S.VantageTree(x[:1000], 3000, 100, 2)
    assert tree.leaves > 8
    of = [set() for _ in range(6000)]
    for r, s in zip(*tree.route(np.concatenate([x, y])), strict=True):
        of[r].add(int(s))
    assert all(of[i] & of[3000 + i] for i in range(3000))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    chain = list(range(1000, 1200))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False)) + [(5, k) for k in range(10, 400)] + [(7, 7), (8, 9)]
    got = {r.node: r.label for r in store.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({n for e in edges for n in e if e[0] != e[1]}, edges[:-2] + edges[-1:])
    assert got == want
    assert store.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_block_pairs_meet_once(spark):
    rows = spark.range(300).withColumn("n", F.lit(300).cast("long"))
    dealt = store.in_block_pairs(rows, "n", "id", 40).collect()
    cells = {}
    for r in dealt:
        cells.setdefault((r.block_i, r.block_j), []).append((r.id, r.own))
    met = [tuple(sorted((a, b))) for (i, j), xs in cells.items() for a, p in xs for b, q in xs if a < b and (i == j or p != q)]
    assert len(met) == len(set(met)) == 300 * 299 // 2


def test_rows_without_ids_link_and_are_linked(spark, monkeypatch):
    prints = [(9, 0), (None, 0b11), (4, 0b1111), (None, 1 << 40), (None, 0b11 << 40), (2, -1)]
    table = spark.createDataFrame(prints, "doc_id long, fp long")
    monkeypatch.setattr(S, "fingerprints", lambda docs: table)
    got = {r.fp: r.component_id for r in S.near_duplicates(table).collect()}
    assert got == {0: 4, 0b11: 4, 0b1111: 4, 1 << 40: 4, 0b11 << 40: 4, -1: 2}
    alone = table.where("fp in (1 << 40, 3 << 40)".replace("1 << 40", str(1 << 40)).replace("3 << 40", str(3 << 40)))
    monkeypatch.setattr(S, "fingerprints", lambda docs: alone)
    assert [r.component_id for r in S.near_duplicates(alone).collect()] == [None, None]


def _ball(n, bits, seed=0):
    """Distinct values within some bits of one."""
    import numpy as np

    rng = np.random.default_rng(seed)
    centre = int(rng.integers(1 << 62))
    out = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, bits + 1), replace=False)) for _ in range(n)}
    return np.array(sorted(out), dtype=np.uint64)


def test_dense_leaves_by_bit_flips_and_by_tiles(monkeypatch):
    import numpy as np

    from lattica.llm import simhash_vptree as S

    for fp in (_ball(5000, 4), _ball(3000, 9, 1), np.concatenate([_ball(2500, 3, 2), _ball(2500, 5, 3)])):
        fp = np.unique(fp)
        for own in (None, np.arange(len(fp)) % 3):
            near = np.bitwise_count(fp[:, None] ^ fp) <= 2
            if own is not None:
                near &= own[:, None] != own
            from lattica.llm.store import local_roots

            want = local_roots(near)
            assert (S._probed(fp, own, S.flips(2)) == want).all() and (S._tiled(fp, own, 2) == want).all()
    monkeypatch.setattr(S, "DENSE", 100)
    monkeypatch.setattr(S, "LEAF", 20)
    fp = _ball(4000, 4, 5)
    assert (S._leaf_roots(fp, None, 2) == local_roots(np.bitwise_count(fp[:, None] ^ fp) <= 2)).all()


def test_a_ball_of_hundreds_of_thousands_is_linked_in_bounded_memory():
    import resource
    import time

    import numpy as np

    from lattica.llm import simhash_vptree as S

    fp = np.unique(np.concatenate([_ball(1, 0), np.array([0], dtype=np.uint64) ^ S.flips(2), *[S.flips(2) ^ np.uint64(1 << b) for b in range(40)]]))
    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    root = S._leaf_roots(fp, None, 2)
    assert len(fp) > 30_000 and len(np.unique(root)) <= 2
    assert time.time() - began < 120 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20
