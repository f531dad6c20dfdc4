"""A corpus pipeline of five stages, each written as Parquet and read by the next.

``documents`` -> quality classifier -> line dedup -> SimHash near-dedup -> mixing of
sources to target weights -> packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import stages
from lattica.llm.store import dropped, saved

STAGES = [
    ("quality classifier", stages.quality),
    ("line dedup", stages.lines),
    ("simhash near-dedup", stages.near_copies),
    ("source mixing", stages.mix),
    ("packing", stages.pack),
]

#: A trained classifier and a tokenizer are not SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``. A corpus goes when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = None
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        if held is not None:
            dropped(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
