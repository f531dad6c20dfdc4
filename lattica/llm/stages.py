"""Stages of a corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last keep the columns of ``docs``. What a stage decides takes effect:
rejected documents, shared lines and near copies go, documents are repeated or left out
by the mix, and the last stage puts out the packed pieces.

Defined results, in every stage: null and empty texts, null ids, ties and repeated rows are
those of the operator that the stage calls; a text of any length is one document; columns
besides ``doc_id``, ``text`` and ``source`` pass through unchanged, whatever they are called
(but ``n_chars``, which follows a changed text); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cost_packing, line_dedup, rule_quality, shingle_overlap, source_mixing
from .store import fresh, quoted, saved


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts as good."""
    model = rule_quality.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    told, _, s_ = rule_quality.with_statistics(docs)
    return told.where(model.score(s_) >= 0.5).select(*quoted(docs.columns))


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; ``n_chars``, if there, follows the text."""
    out = line_dedup.dedup(docs, counts=tuple(fresh(docs, "_lines", "_dropped")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*quoted(docs.columns))


def near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (Jaccard 0.8 or more of
    5-word shingles, in chains); rows without an id stay, and an id stays with all its rows."""
    found = shingle_overlap.near_copies(docs)
    gone = saved(found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where("not stays").select("doc_id"))
    return shingle_overlap.with_ids(docs, gone, "left_anti").select(*quoted(docs.columns))


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources has them."""
    return source_mixing.mixed(docs)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences."""
    return cost_packing.packed_documents(docs)
