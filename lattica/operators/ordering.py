"""Sorting, positions, pages and top rows.

Positions over a whole table are numbered without a single-task window: a sorted copy is
written, its partitions are counted, and each row gets its partition's offset. Positions
within a key that may hold a large share of all rows are numbered in the same two steps,
see ``keyed_position``.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import leading_number
from lattica.sources.written import written

PAGE, GRID_PAGE = 10, 20
#: Rows, at most, that are taken as the top of the order by one task; what lies deeper is numbered in parallel.
TOP = 100_000


def position(*partition: str, order: Sequence[Column | str]) -> Column:
    """The row's number in its partition, from 0; the order has to be unique to be repeatable."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long") - 1


def global_position(df: DataFrame, order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """``df`` with the row's number in the whole order, from 0."""
    spark = df.sparkSession
    held = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))  # partition number above 33 bits, row below
    part = F.shiftright("_at", 33).cast("int")
    ahead, offsets = 0, []
    for r in held.groupBy(part.alias("_part")).count().orderBy("_part").collect():  # a row for each partition
        offsets.append((r["_part"], ahead))
        ahead += r["count"]
    table = F.broadcast(spark.createDataFrame(offsets, "_part int, _ahead long"))
    return held.withColumn("_part", part).join(table, "_part").withColumn(name, F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_ahead")


def keyed_position(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """``df`` with the row's number within its key, from 0, for keys of any size.

    A copy is written in ranges of (key, order), so that a hot key lies in many of them; rows
    are counted by range and key, a window over those counts gives the rows of a key in
    earlier ranges, and a row's number within its range and key is added. Only a range's
    first key can have begun before it, so the offsets are a row for each range at most.
    Rows that are equal in ``order`` share a range, and have no fixed order among them.
    """
    cell, ahead = "_cell", "_ahead"
    held = written(df.repartitionByRange(*key, *order).withColumn(cell, F.spark_partition_id()))
    counts = held.groupBy(*key, cell).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(ahead, F.sum("_n").over(before)).where(F.col(ahead) > 0).select(F.col(cell).alias("_c"), *[F.col(k).alias(f"_k_{k}") for k in key], ahead)
    same = F.col(cell) == F.col("_c")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    own = F.row_number().over(Window.partitionBy(*key, cell).orderBy(*order))
    out = held.withColumn("_own", own).join(F.broadcast(offsets), same, "left")
    return out.withColumn(name, F.coalesce(ahead, F.lit(0)) + F.col("_own").cast("long") - 1).drop(cell, ahead, "_own", "_c", *[f"_k_{k}" for k in key])


def page(df: DataFrame, order: Sequence[Column], number, size: int = PAGE, reverse: Sequence[Column] | None = None) -> DataFrame:
    """Page ``number`` (from 1) with ``page``, ``n_pages`` and ``pos``. What is no whole
    number is page 1, what is out of range the last page, as a lenient paginator does.

    One job counts, one takes the page's end as a top-k; from the far half of the table
    it is taken from the other side where ``reverse``, the opposite order, is given. A page
    more than ``TOP`` rows from both ends is cut from the numbered order instead.
    """
    total = df.count()
    pages = max(1, ceil(total / size))
    try:
        at = int(number)
    except (TypeError, ValueError):
        at = 1
    at = at if 1 <= at <= pages else pages
    first, last = (at - 1) * size, min(at * size, total)
    every = Window.orderBy(*order)
    if min(last, total - first if reverse else last) > TOP:
        rows = global_position(df, order)
    elif reverse and total - first < last:
        rows = df.orderBy(*reverse).limit(total - first)
        rows = rows.withColumn("pos", F.row_number().over(every).cast("long") - 1 + first)
    else:
        rows = df.orderBy(*order).limit(last)
        rows = rows.withColumn("pos", F.row_number().over(every).cast("long") - 1)
    return rows.where(F.col("pos").between(first, last - 1)).withColumn("page", F.lit(at).cast("long")).withColumn("n_pages", F.lit(pages).cast("long"))


def grid_page(df: DataFrame, order: Sequence[Column], number: int, size: int = GRID_PAGE, reverse: Sequence[Column] | None = None) -> DataFrame:
    """As ``page``, but a number out of range is ignored (page 1 stays)."""
    pages = max(1, ceil(df.count() / size))
    return page(df, order, number if 1 <= number <= pages else 1, size, reverse)


def between_positions(df: DataFrame, order: Sequence[Column], a: int, b: int) -> DataFrame:
    """Rows from one position to the other in the order, ends included and in either order."""
    low, high = min(a, b), max(a, b)
    if high >= TOP:
        return global_position(df, order).where(F.col("pos").between(low, high))
    top = df.orderBy(*order).limit(high + 1)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long") - 1).where(F.col("pos").between(low, high))


def sort_key(column: Column, kind: str, descending: bool = False, locale: str | None = None) -> Column:
    """What a grid sorts a column by, in either direction: ``string`` nulls first, ``number``
    and ``date`` with null as zero, ``numberAsString`` by the number that a text begins with
    (texts without one, between which the order is undefined, come last either way).

    ``locale``, a collation such as ``UNICODE`` or ``de``, orders strings as a reader of that
    language does: letters first, then accents, then case; without it the order is by code
    point. Descending is the opposite order, so nulls are last in it."""
    if kind == "number":
        key = F.coalesce(column.cast("double"), F.lit(0.0))
        return key.desc() if descending else key.asc()
    if kind == "date":
        key = F.coalesce(column.cast("timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz"))
        return key.desc() if descending else key.asc()
    if kind == "numberAsString":
        return leading_number(column).desc_nulls_last() if descending else leading_number(column).asc_nulls_last()
    key = column.cast("string")
    key = F.collate(key, locale) if locale else key
    return key.desc_nulls_last() if descending else key.asc_nulls_first()


def toggled(field: str, sorted_by: str | None, descending: bool) -> bool:
    """Whether a grid sorts ``field`` descending when it is chosen: the other way round if it is what the grid is sorted by."""
    return not descending if field == sorted_by else False


def scroll_window(df: DataFrame, order: Sequence[Column], pixels: int, row_height: int, shown: int) -> DataFrame:
    """The rows visible at a pixel offset."""
    first = pixels // row_height
    return between_positions(df, order, first, first + shown - 1)


def first_row(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(1)
