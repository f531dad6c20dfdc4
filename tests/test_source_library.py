"""The source library holds all URLs of a source, in the order of their keys (A5)."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lattica.operators import aggregates as A
from lattica.plans.registry import ORACLES, QUERIES

from .oracle import assert_same


def sha(texts):
    return hashlib.sha256(" ".join(texts).encode()).hexdigest()


def test_all_urls_of_a_source_in_the_order_of_their_keys(spark, tmp_path):
    """A hot source over several parts, a source without images, one that the catalogue lacks, null and equal rows."""
    n = 6_000
    source = F.when(F.col("id") % 10 < 8, F.lit("src1")).when(F.col("id") % 10 == 8, F.lit("elsewhere")).otherwise(F.when(F.col("id") % 5 < 3, F.lit("src2")).otherwise(F.lit("src3")))
    lang = F.when(F.col("id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.element_at(F.array(*map(F.lit, ("en", "de", "fr"))), (F.col("id") % 3 + 1).cast("int")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), source.alias("source"), lang.alias("lang"))
    docs = docs.union(docs.where("doc_id % 100 = 1"))
    docs.orderBy(F.xxhash64("doc_id")).coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    spark.range(5).select(F.col("id").alias("n_nationkey")).toPandas().to_parquet(tmp_path / "nation.parquet")
    keys = {f"src{i}": [] for i in range(5)}
    for r in docs.collect():
        if r.source in keys and r.lang is not None and r.doc_id % 5 < 3:
            keys[r.source].append(f"{r.lang}/{r.doc_id:09d}" + (".png", ".JPG", ".jpeg")[r.doc_id % 5])
    urls = {b: [f"https://{b}.s3.amazonaws.com/{k}" for k in sorted(ks)] for b, ks in keys.items()}
    assert len(urls["src1"]) > 2 * A.PART_ROWS and urls["src3"] == []
    got = QUERIES["source_library"](spark, str(tmp_path))
    assert {r.bucket: (r.n_images, r.urls_sha256) for r in got.collect()} == {b: (len(us), sha(us)) for b, us in urls.items()}
    assert_same(got, ORACLES["source_library"], tmp_path)


@pytest.mark.parametrize("rows", [1, 7, 100_000])
@pytest.mark.parametrize("down", [False, True])
def test_a_hash_of_joined_texts_does_not_know_its_parts(spark, rows, down):
    hot = F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 < 9, F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    text = F.when(F.col("id") % 11 == 0, F.lit(None).cast("string")).when(F.col("id") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("ä"), F.col("id").cast("string")))
    df = spark.range(3_000).select(hot.alias("key"), (F.col("id") % 3).cast("int").alias("k2"), F.pmod(F.xxhash64("id"), F.lit(1_003)).alias("v"), text.alias("text"), "id").repartition(6)
    order = [F.col("v").desc(), F.col("id").desc()] if down else ["v", "id"]
    got = A.joined_sha256(df, ["key", "k2"], order, "text", rows=rows)
    assert got.columns == ["key", "k2", "sha256"]
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.v, r.id), reverse=down):
        if r.text is not None:
            want.setdefault((r.key, r.k2), []).append(r.text)
    found = got.collect()
    assert len(found) == len(want) and {(r.key, r.k2): r.sha256 for r in found} == {k: sha(v) for k, v in want.items()}


def test_no_texts_have_no_hash(spark):
    empty = spark.createDataFrame([("a", 1, None)], "k string, v int, text string")
    assert A.joined_sha256(empty, ["k"], ["v"], "text").collect() == []


def test_texts_are_hashed_in_their_order(spark):
    """Equal sets of texts in another order are told apart, which a sum of their hashes does not."""
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "y"), ("b", 2, "x")], "k string, v int, text string")
    assert {r.k: r.sha256 for r in A.joined_sha256(df, ["k"], ["v"], "text", rows=1).collect()} == {"a": sha("xy"), "b": sha("yx")}
