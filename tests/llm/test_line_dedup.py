from collections import defaultdict

from lattica.llm import line_dedup as L

from . import cases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    seen = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line):
                seen[key(line)].add(i)
    common = {k for k, ids in seen.items() if len(ids) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    docs = cases.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = L.dedup(docs)
    assert set(docs.columns) | {"n_lines", "n_dropped"} == set(got.columns)
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()], key=str) == brute(rows, 10)


def test_threshold_is_of_documents(spark):
    rows = [(i, "same\nown %d" % i) for i in range(9)] + [(3, "same\nsame"), (100, "Same \n\nSAME")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in L.dedup(docs).collect()], key=str) == brute(rows, 10)
    assert all(r.n_dropped == 0 for r in L.dedup(docs.where("doc_id < 100")).collect())


def test_all_lines_dropped_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(10)], "doc_id long, text string")
    assert {r.text for r in L.dedup(docs).collect()} == {""}
    assert L.dedup(cases.empty(spark)).collect() == []


def test_plan_is_native(spark):
    plan = L.dedup(cases.documents(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD in"))


def test_rows_without_id_are_one_document_in_code_and_sql(spark, tmp_path):
    rows = [(i, "same\nnine") for i in range(9)] + [(None, "same\nother"), (None, "SAME \nother"), (3, "same"), (50, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in L.dedup(docs).collect()], key=str)
    assert got == brute(rows, 10) and {r.n_dropped for r in L.dedup(docs).where("doc_id is null").collect()} == {1}
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(L.OP6_SQL)
    assert sorted([tuple(r) for r in L.op6_line_dedup(spark, str(tmp_path)).select(*want.columns).collect()], key=str) == sorted(want.fetchall(), key=str)
