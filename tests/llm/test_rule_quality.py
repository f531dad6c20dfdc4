import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import rule_quality as R

from . import cases

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = R.op2_rule_ensemble(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    told = rows.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(told) > 50 and np.mean([r.predicted == r.quality for r in told]) > 0.95
    every = rows.collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in every)


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(R.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert R.trained(docs, labels) == R.trained(docs, turned)


def plain_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = max(1, len(w))
    found = lambda p: len(re.findall(p, text)) / n
    return [
        len(w), len(text) / n, len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, sum(len(x) <= 3 for x in w) / n, found(r"\|"), found("!"), found(r"[#$%&*@~^=<>_{}\[\]\\+]+"),
        found("[A-Z]"), found("[0-9]+"), found("[.?]"), found(","), found("\n"),
    ]


def test_statistics_by_plain_python(spark):
    docs = cases.documents(spark).select("text").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text"))
    told, names, s_ = R.with_statistics(docs)
    rows = told.select("text", *[F.col(f"{s_}.{n}").alias(n) for n in names]).collect()
    assert names == ["words", "word_length", "distinct", "repeats", "short", "pipes", "bangs", "symbols", "capitals", "digits", "stops", "commas", "lines"]
    for r in rows:
        assert np.allclose([r[n] for n in names], plain_statistics(r.text), rtol=1e-12)


def test_a_repeated_labelled_id_is_one_row(spark):
    docs = spark.createDataFrame([(2, "a text of words"), (3, "ooo ||| !!!")] + [(2, "a text of words")] * 5000, "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, quality int")
    assert R.trained(docs, labels) == R.trained(docs.distinct(), labels)


def test_compiled_score_is_the_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = R.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"), sample=100)
    told, names, s_ = R.with_statistics(docs)
    rows = told.select(*[F.col(f"{s_}.{n}").alias(n) for n in names], model.score(s_).alias("score")).toPandas()
    x = rows[names].to_numpy(dtype=float)
    assert model.rules and np.allclose(rows["score"], 1 / (1 + np.exp(-model.logit(x))))


def test_lasso_drops_what_does_not_matter():
    rng = np.random.default_rng(0)
    z = (rng.random((2000, 6)) < 0.5).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(4 * z[:, 0] - 2)))).astype(float)
    _, w = R.lasso_logistic(z, y, penalty=0.02)
    assert w[0] > 1 and np.abs(w[1:]).max() < 0.1


def test_rules_are_paths():
    x = np.random.default_rng(3).random((1000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.5)).astype(float)
    rules = R.tree_rules(x, y)
    assert all(1 <= len(r) <= R.DEPTH for r in rules)
    model = R.RuleEnsemble.fitted(["a", "b", "c"], x, y)
    assert np.mean((model.logit(x) > 0) == (y > 0)) > 0.97


def test_awkward_documents_and_labels(spark):
    docs = cases.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in R.scored(docs, R.trained(docs, none)).select("score").collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1), (7, 0), (10, 1), (13, 0)] * 3, "doc_id long, quality int")
    out = R.scored(docs, R.trained(docs, labels))
    assert out.count() == docs.count() and out.where("score is null or held_out is null").count() == 0
    assert R.scored(cases.empty(spark), R.trained(cases.empty(spark), labels)).collect() == []
