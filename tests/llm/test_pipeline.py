"""The pipeline against plain Python, stage by stage on what the stage before put out."""

import corpus_pipeline
from lattica.llm import rule_quality
from lattica.llm.store import saved

from . import cases
from .test_cost_packing import check
from .test_line_dedup import brute as brute_lines
from .test_shingle_overlap import brute as brute_near
from .test_source_mixing import brute as brute_mix

SF = "/root/testdata/sf0.001"


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "source mixing", "packing"]


def test_stages_against_plain_python(spark):
    quality, lines, near, mix, pack = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = saved(quality(spark, docs, SF))
    model = rule_quality.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in rule_quality.scored(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in a.collect()} == want and a.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum((i in want) != bool(q) for i, q in labels.items()) <= 3  # 58 labels to learn from here

    b = saved(lines(spark, a, SF))
    assert sorted((r.doc_id, r.text) for r in b.collect()) == [(i, t) for i, _, _, t in sorted(brute_lines([(r.doc_id, r.text) for r in a.collect()], 10))]

    c = saved(near(spark, b, SF))
    assert {r.doc_id for r in c.collect()} == set(brute_near([(r.doc_id, r.text) for r in b.collect()]).values())

    d = saved(mix(spark, c, SF))
    times = {}
    for r in d.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for i, n, _, _, t in brute_mix([(r.doc_id, r.text, r.source) for r in c.collect()]):
        assert times.get(i, 0) == (int(t / n + 0.5) if n else 0)

    check(pack(spark, d, SF).collect(), [(r.doc_id, r.text) for r in d.collect()])


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = saved(f(spark, docs, SF))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_awkward_documents_pass_every_stage(spark):
    docs = cases.documents(spark)
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = saved(f(spark, docs, SF))
        assert out.columns == docs.columns, name
        assert out.count() > 0 and saved(f(spark, cases.empty(spark), SF)).count() == 0, name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, cases.empty(spark), SF).count() == 0
