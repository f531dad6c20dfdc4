"""Shared plumbing: written intermediate tables, connected components and the
splitting of oversized candidate groups into block pairs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.written import shared_folder


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only without a cluster."""
    return shared_folder(spark)


def saved(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends
    here, and a lost executor costs no recomputation of what stands before."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/lattica-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lattica_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a ``saved`` table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.lattica_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shipped(spark: SparkSession) -> None:
    """Gives the Python workers this package, once a session; they may share no folder with the driver."""
    context = spark.sparkContext
    if getattr(context, "_lattica_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._lattica_shipped = True


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` by workers that have this package."""
    shipped(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, key: list[str], run: Callable, schema: str) -> DataFrame:
    """``applyInArrow`` on groups, by workers that have this package."""
    shipped(df.sparkSession)
    return df.groupBy(*key).applyInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(names: list[str]) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def in_block_pairs(df: DataFrame, count: str, by: str, cap: int) -> DataFrame:
    """Spreads the rows of groups with more than ``cap`` rows over pairs of blocks.

    ``count`` names the column with the row's group size; ``by`` the column whose
    hash gives its block. Adds ``own`` (the row's block) and ``block_i <= block_j``
    (the pair that this copy goes to). Any two rows of a group meet in exactly one
    pair (their two blocks; rows of one block meet where i = j), each pair holds at
    most about 2 ``cap`` rows, and a group of one block is not copied at all.
    """
    blocks = F.ceil(F.col(count) / F.lit(cap)).cast("int")
    return (
        df.withColumn("_k", F.greatest(F.lit(1), blocks))
        .withColumn("own", F.pmod(F.xxhash64(by, F.lit("block")), F.col("_k")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .withColumn("block_i", F.least("own", "_o"))
        .withColumn("block_j", F.greatest("own", "_o"))
        .drop("_k", "_o")
    )


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, each row's smallest index of its component."""
    n = len(linked)
    root = np.arange(n)
    while True:
        least = np.empty(n, dtype=root.dtype)
        for at in range(0, n, 256):
            rows = np.where(linked[at : at + 256], root, n)
            least[at : at + 256] = np.minimum(rows.min(axis=1), root[at : at + 256])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): (node, label), the label being
    the smallest node of the component; nodes without an edge are absent.

    Each round gives a node the least label among its neighbours, hooks the label's
    own node to that and jumps to the label of its label, so paths shorten by more
    than half a round. All of it is joins and aggregates; the loop reads one count a
    round. Both sides of the joins are read from written tables, so that adaptive
    execution can split the partitions of a hub.
    """
    links = saved(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    labels = saved(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = links.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        near = near.join(labels, "node")
        none = F.lit(None).cast("long").alias("old")
        jump = labels.select("node", F.col("label").alias("old")).join(labels.select(F.col("node").alias("old"), "label"), "old")
        found = (
            jump.select("node", "label", "old")
            .union(near.select("node", "m", none))
            .union(near.select("label", "m", none))
            .groupBy("node")
            .agg(F.min("label").alias("label"), F.max("old").alias("old"))
        )
        after = saved(found)
        moved = after.where("label <> old").limit(1).count()
        dropped(labels)
        labels = after.select("node", "label")
        labels.lattica_path = after.lattica_path
        if not moved:
            dropped(links)
            return labels
