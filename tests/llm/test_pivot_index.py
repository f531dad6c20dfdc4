import numpy as np

from lattica.llm import pivot_index as V

from .test_near_copies import roots


def brute(rows, least=0.93):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        a = np.array([np.nan if x is None else x for x in v], dtype=float) if v is not None else np.zeros(0)
        if label is not None and len(a) and np.isfinite(a).all() and a.any():
            ok[k] = (label, len(a), a / np.linalg.norm(a))
    pairs = [(p, q) for p in ok for q in ok if p < q and ok[p][:2] == ok[q][:2] and float(ok[p][2] @ ok[q][2]) >= least]
    n = {k: 0 for k in range(len(rows))}
    for p, q in pairs:
        n[p] += 1
        n[q] += 1
    ids = [r[0] for r in rows]
    root = roots(set(ids), [(ids[p], ids[q]) for p, q in pairs if ids[p] != ids[q]])
    return sorted((ids[k], n[k], root[ids[k]], ids[k] == root[ids[k]]) for k in range(len(rows)))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def clusters(rng, n, dims=64):
    base = rng.standard_normal((n, dims))
    near = base[: n // 2] + rng.standard_normal((n // 2, dims)) * rng.choice([0.1, 0.3, 0.37, 0.45], (n // 2, 1))
    clique = base[0] + rng.standard_normal((60, dims)) * 0.05
    return np.concatenate([base, near, clique, base[:5]])


def test_recall_and_no_false_links(spark):
    x = clusters(np.random.default_rng(11), 500)
    rows = [(i, [float(a) for a in v], i % 2) for i, v in enumerate(np.repeat(x, 2, axis=0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    want, got = brute(rows), rows_of(V.near_duplicates(df))
    assert [w[0] for w in want] == [g[0] for g in got]
    assert all(g[1] <= w[1] for w, g in zip(want, got, strict=True))
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)


def test_lists_by_pairs_of_pivots_find_the_same(spark):
    x = clusters(np.random.default_rng(13), 300)
    rows = [(i, [float(a) for a in v], i % 2) for i, v in enumerate(np.repeat(x, 2, axis=0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert rows_of(V.near_duplicates(df, paired=True)) == rows_of(V.near_duplicates(df, paired=False))


def test_whole_test_table_is_exact(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    assert rows_of(V.op3_pivot_permutations(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_oversized_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    x = clusters(np.random.default_rng(12), 60)
    rows = [(i, [float(a) for a in v], 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert rows_of(V.near_duplicates(df)) == brute(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, -0.0], 1), (4, [1.0, None], 1), (5, [1.0, nan], 1), (6, [inf, 1.0], 1), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (10, [1.0, 2.0], 2)]
    rows += [(11, [1.0, 2.0, 0.0], 1), (8, [1.0, 2.0], 1), (12, [1e-200, 2e-200], 1), (13, [1e300, 2e300], 1), (14, [-1.0, -2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as node", "2 as n", "3 as pivot", "4 as c1")
    got = rows_of(V.near_duplicates(df))
    linked = {8, 9, 12, 13}
    assert all(g[1] == (4 if g[0] in linked else 0) and g[2] == (8 if g[0] in linked else g[0]) for g in got) and len(got) == len(rows)
    one = spark.createDataFrame([(None, [1.0], 1), (5, [2.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.n_links, r.kept) for r in V.near_duplicates(one).collect()) == [(1, False), (1, True)]
    assert rows_of(V.near_duplicates(df.limit(0))) == []


def test_recall_in_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(21)
    centre = rng.standard_normal(64)
    group = centre + rng.standard_normal((10_000, 64)) * 0.02
    x = np.concatenate([group, rng.standard_normal((20_000, 64))])
    classes = [(i, 1, [float(a) for a in v], "1:64") for i, v in enumerate(x)]
    df = spark.createDataFrame(classes, "node long, n long, vector array<double>, label string").repartition(8)
    links = V._links(V.saved(df), 150, 0.93, 8, 2, False).groupBy("node").agg({"links": "sum"}).collect()
    assert sum(r[1] for r in links if r.node < 10_000) >= 0.9 * 10_000 * 9_999


def test_dense_pairs_are_counted_the_same(spark, monkeypatch):
    x = clusters(np.random.default_rng(14), 200)
    df = spark.createDataFrame([(i, [float(a) for a in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = [rows_of(V.near_duplicates(df, paired=p)) for p in (False, True)]
    monkeypatch.setattr(V, "DENSE", -1)
    assert [rows_of(V.near_duplicates(df, paired=p)) for p in (False, True)] == want


def test_labels_where_classes_have_null_or_negative_ids(spark):
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.1], 1), (7, [1.0, 0.2], 1), (-4, [1.0, 0.0], 2), (9, [1.0, 0.1], 2), (None, [1.0, 0.0], 3), (None, [1.0, 0.1], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = V.near_duplicates(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None) == [(-4, 1, -4, True), (5, 2, 5, True), (7, 2, 5, False), (9, 1, -4, False)]
    assert sorted((r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None) == [(1, None, False), (1, None, False), (2, None, False)]
