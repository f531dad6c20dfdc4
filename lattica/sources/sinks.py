"""Sinks: delimited text, manifests, archives' paths and appended tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import csv_field

UPLOAD_LIMIT = 50


def delimited(df: DataFrame, columns: Sequence[str] | None = None, sep: str = ",", quote: str = '"') -> Column:
    """One line of delimited text: every field quoted, quotes doubled."""
    return F.concat_ws(sep, *[csv_field(F.col(c), quote) for c in columns or df.columns])


def header_line(columns: Sequence[str], sep: str = ",", quote: str = '"') -> str:
    return sep.join(quote + c.replace(quote, quote * 2) + quote for c in columns)


def delimited_lines(df: DataFrame, order: Sequence, columns: Sequence[str] | None = None, sep: str = ",", quote: str = '"', footer: dict[str, Column] | None = None) -> DataFrame:
    """(line_no, line) of a whole export: a header at 0, the rows from 1 in their order and, with
    ``footer`` (aggregates by column, '' for the others), a footer behind them."""
    from lattica.operators.ordering import global_position

    columns = list(columns or df.columns)
    body = global_position(df, order, "_row").select((F.col("_row") + 1).alias("line_no"), delimited(df, columns, sep, quote).alias("line"))
    head = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("line_no"), F.lit(header_line(columns, sep, quote)).alias("line"))
    out = head.union(body)
    if footer is None:
        return out
    last = df.agg(F.count("*").alias("_n"), *[c.cast("string").alias(f"_f_{n}") for n, c in footer.items()])
    fields = [csv_field(F.col(f"_f_{c}") if c in footer else F.lit(""), quote) for c in columns]
    return out.union(last.select((F.col("_n") + 1).alias("line_no"), F.concat_ws(sep, *fields).alias("line")))


def write_delimited(df: DataFrame, path: str, sep: str = ",", bom: bool = False) -> None:
    """Parallel part files with a header each; a byte-order mark if asked for."""
    names = [("﻿" if bom and i == 0 else "") + c for i, c in enumerate(df.columns)]
    df.toDF(*names).write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)


def manifest(frames: DataFrame, key: Sequence[str], order: str = "pos", path: str = "path", duration: int = 1) -> DataFrame:
    """Concat manifest lines (key, line_no, line): a file and a duration line for each
    frame in order, and the last file once more. A key may be of any size."""
    from lattica.operators.ordering import keyed_position

    numbered = keyed_position(frames.select(*key, F.col(order).alias("_o"), F.col(path).alias("_path")), key, ["_o"], "_no")
    file = lambda c: F.concat(F.lit("file '"), c, F.lit("'"))
    line = lambda no, text: F.struct(no.cast("long").alias("line_no"), text.alias("line"))
    lines = numbered.select(*key, F.explode(F.array(line(F.col("_no") * 2 + 1, file(F.col("_path"))), line(F.col("_no") * 2 + 2, F.lit(f"duration {duration}")))).alias("_l")).select(*key, "_l.*")
    last = numbered.groupBy(*key).agg(F.max("_no").alias("_no"), F.max_by("_path", "_no").alias("_path"))
    return lines.union(last.select(*key, F.col("_no") * 2 + 3, file(F.col("_path"))))


def archive_paths(listing: DataFrame) -> DataFrame:
    """The path of each object in an archive of several buckets."""
    return listing.withColumn("path", F.concat_ws("/", "bucket", "key"))


def upload_batches(files: DataFrame, batch: str = "batch", limit: int = UPLOAD_LIMIT) -> DataFrame:
    """Files with whether their batch is within the limit; a batch above it is refused as a whole."""
    sizes = files.groupBy(batch).agg(F.count("*").alias("batch_size"))
    return files.join(sizes, batch).withColumn("accepted", F.col("batch_size") <= limit)


def upload_outcomes(files: DataFrame, batch: str, faults: dict[str, Column], limit: int = UPLOAD_LIMIT) -> DataFrame:
    """Files with ``error``: a batch above the limit is refused as a whole; in others each file stands
    for itself, fails by the first fault that holds for it, and hinders no other. Null: uploaded."""
    error = F.when(~F.col("accepted"), F.lit("too many files"))
    for text, fault in faults.items():
        error = error.when(fault, F.lit(text))
    return upload_batches(files, batch, limit).withColumn("error", error)


def expanded(df: DataFrame, series: str, names: Sequence[str]) -> DataFrame:
    """An array of parts (open to close, least to most, start and end) as a column for each part."""
    return df.select(*[c for c in df.columns if c != series], *[F.get(series, i).alias(n) for i, n in enumerate(names)])


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
