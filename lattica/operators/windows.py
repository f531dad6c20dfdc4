"""Order-dependent columns within a key: runs, timelines, splits, encodings, crossings and downsampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import global_position, keyed_position, position


def _w(key: Sequence[str], order: Sequence):
    return Window.partitionBy(*key).orderBy(*order)


def frame_name(pos: Column, prefix: str = "frame", width: int = 4) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.lpad(pos.cast("string"), width, "0"))


def held_last(df: DataFrame, key: Sequence[str], end: str = "end", hold: int = 1) -> DataFrame:
    """A timeline with the last clip of each key once more behind its end, for ``hold``: a player
    that drops the last entry of a list then shows every clip whole."""
    last = df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), end).alias("_l")).select(*key, "_l.*")
    return df.withColumn("held", F.lit(False)).unionByName(last.withColumn("start", F.col(end)).withColumn(end, F.col(end) + hold).withColumn("held", F.lit(True)))


def timeline(df: DataFrame, key: Sequence[str], order: Sequence, duration: str) -> DataFrame:
    """Clips one after the other: ``start`` and ``end``."""
    before = F.sum(duration).over(_w(key, order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("start", F.coalesce(before, F.lit(0))).withColumn("end", F.col("start") + F.col(duration))


def runs(df: DataFrame, key: Sequence[str], order: Sequence, value: str, none: str = "No group") -> DataFrame:
    """``group_no`` (from 1 in the key) and ``group`` of each row: a new group wherever the value changes."""
    w = _w(key, order)
    named = df.withColumn("group", F.coalesce(F.col(value).cast("string"), F.lit(none)))
    changed = F.when(F.lag("group").over(w).eqNullSafe(F.col("group")), 0).otherwise(1)
    return named.withColumn("_new", changed).withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def nested_runs(df: DataFrame, key: Sequence[str], order: Sequence, values: Sequence[str], none: str = "No group") -> DataFrame:
    """Runs within runs: ``group_1`` and ``group_no_1`` by the first value, ``group_2`` and
    ``group_no_2`` by the second within a run of the first, and so on."""
    held = list(key)
    for level, value in enumerate(values, 1):
        df = runs(df, held, order, value, none).withColumnsRenamed({"group": f"group_{level}", "group_no": f"group_no_{level}"})
        held.append(f"group_no_{level}")
    return df


def with_headers(df: DataFrame, key: Sequence[str], columns: Sequence[str], footer: dict[str, Column] | None = None) -> DataFrame:
    """Rows with ``group_no`` and ``group`` and, at level 0, a header row for each group with its
    number of rows; with ``footer``, aggregates by name, a footer row with them at level 2."""
    rows = df.select(*key, "group_no", "group", F.lit(1).alias("level"), F.lit(1).cast("long").alias("n"), *columns)
    groups = df.groupBy(*key, "group_no", "group").agg(F.count("*").alias("n"), *[c.alias(name) for name, c in (footer or {}).items()])
    shown = [F.lit(0).alias("level")] if footer is None else [F.explode(F.array(F.lit(0), F.lit(2))).alias("level")]
    head = groups.select(*key, "group_no", "group", *shown, "n", *(footer or {}))
    told = [F.when(F.col("level") == 2, F.col(name)).alias(name) for name in footer or {}]
    return rows.unionByName(head.select(*key, "group_no", "group", "level", "n", *told), allowMissingColumns=True)


def cumulative(df: DataFrame, key: Sequence[str], order: Sequence, value: str, name: str) -> DataFrame:
    """The running sum within the key."""
    return df.withColumn(name, F.sum(value).over(_w(key, order).rowsBetween(Window.unboundedPreceding, 0)))


def first_of(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", position(*key, order=order)).where("_n = 0").drop("_n")


def encoded(df: DataFrame, value: str, pos: str, preset: Sequence[str] = ()) -> DataFrame:
    """(value, code): codes in the order of first appearance, going on after preset values.

    Ranks only the distinct values, which are numbered in parallel.
    """
    seen = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(pos).alias("_first"))
    fixed = F.array_position(F.array(*map(F.lit, preset)), F.col(value)) - 1 if preset else F.lit(-1)
    told = seen.withColumn("_fixed", fixed.cast("long"))
    free = global_position(told.where("_fixed < 0"), ["_first", value], "code")
    return free.select(value, (F.col("code") + len(preset)).alias("code")).union(told.where("_fixed >= 0").select(value, "_fixed"))


def first_last_filled(df: DataFrame, key: Sequence[str], x: str, y: str) -> DataFrame:
    """The first and the last x with a value."""
    have = F.when(F.col(y).isNotNull(), F.col(x))
    return df.groupBy(*key).agg(F.min(have).alias("first_x"), F.max(have).alias("last_x"))


def series_fill(df: DataFrame, key: Sequence[str], order: Sequence, value: str, step, name: str = "filled") -> DataFrame:
    """An arithmetic series from the key's first value."""
    w = _w(key, order)
    return df.withColumn(name, F.first(value).over(w) + (F.row_number().over(w) - 1) * F.lit(step))


def fill_down(df: DataFrame, key: Sequence[str], order: Sequence, value: str, name: str = "filled") -> DataFrame:
    """The key's first value in all rows."""
    return df.withColumn(name, F.first(value).over(_w(key, order)))


def series_cells(df: DataFrame, key: Sequence[str], order: Sequence, columns: Sequence[str], step) -> DataFrame:
    """An arithmetic series over the cells of a key, row by row, from its first row's first column."""
    w, wide = _w(key, order), len(columns)
    first, at = F.first(columns[0]).over(w), (F.row_number().over(w) - 1) * wide
    return df.withColumns({c: first + (at + j) * F.lit(step) for j, c in enumerate(columns)})


def alternating(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """``side`` a for even and b for odd positions, and ``side_pos`` in it; a key may be of any size."""
    numbered = keyed_position(df, key, order, "_n")
    return numbered.withColumn("side", F.when(F.col("_n") % 2 == 0, "a").otherwise("b")).withColumn("side_pos", (F.col("_n") / 2).cast("long")).drop("_n")


def crossings(df: DataFrame, key: Sequence[str], below: float, x: str = "x", y: str = "y") -> DataFrame:
    """The series with a point put in wherever the line crosses ``below``, and ``part``: under or over."""
    w = _w(key, [x])
    pairs = df.withColumn("_x", F.lag(x).over(w)).withColumn("_y", F.lag(y).over(w))
    level = F.lit(float(below))
    cross = pairs.where(F.col("_y").isNotNull() & ((F.col("_y") < level) != (F.col(y) < level)) & (F.col(y) != level) & (F.col("_y") != level))
    at = F.col("_x") + (level - F.col("_y")) * (F.col(x) - F.col("_x")) / (F.col(y) - F.col("_y"))
    put = cross.select(*key, at.alias(x), level.alias(y), F.lit("crossing").alias("part"))
    return df.select(*key, x, y, F.when(F.col(y) < level, "under").otherwise("over").alias("part")).union(put)


def bands(df: DataFrame, key: Sequence[str], thresholds: Sequence[float], x: str = "x", y: str = "y") -> DataFrame:
    """(key, x, y, band, crossing): the series by the number of ascending thresholds that are
    not above it, with a point put in wherever the line crosses one of them."""
    levels = sorted(float(t) for t in thresholds)
    band = lambda c: reduce(lambda a, b: a + b, [(c >= t).cast("int") for t in levels])
    w = _w(key, [x])
    pairs = df.withColumn("_x", F.lag(x).over(w)).withColumn("_y", F.lag(y).over(w)).where("_y is not null")
    between = F.filter(F.array(*map(F.lit, levels)), lambda t: (F.least(F.col(y), F.col("_y")) < t) & (t < F.greatest(F.col(y), F.col("_y"))))
    cross = pairs.withColumn("_t", F.explode(between))
    at = F.col("_x") + (F.col("_t") - F.col("_y")) * (F.col(x) - F.col("_x")) / (F.col(y) - F.col("_y"))
    put = cross.select(*key, at.alias(x), F.col("_t").alias(y), band(F.col("_t")).alias("band"), F.lit(True).alias("crossing"))
    return df.select(*key, x, y, band(F.col(y)).alias("band"), F.lit(False).alias("crossing")).union(put)


def fill_right(columns: Sequence[str], step: float | None = None) -> list[Column]:
    """The columns filled from the first one: with its value, or with an arithmetic series from it."""
    return [(F.col(columns[0]) + F.lit(i * step) if step is not None else F.col(columns[0])).alias(c) for i, c in enumerate(columns)]


def reordered(df: DataFrame, key: Sequence[str], sequence: str, new_order: Sequence) -> DataFrame:
    """The values of the sequence column dealt anew by the new order; only rows that change. A key may be of any size."""
    old = keyed_position(df, key, [sequence], "_n").select(*key, "_n", F.col(sequence).alias("new_value"))
    new = keyed_position(df, key, new_order, "_n")
    return new.join(old, [*key, "_n"]).where(F.col(sequence) != F.col("new_value")).drop("_n")


def downsampled(df: DataFrame, key: Sequence[str], x: str, y: str, tie: str, start, width) -> DataFrame:
    """First, least, greatest and last value of each bucket of x, and whether it holds nulls only."""
    bucket = F.floor((F.col(x) - F.lit(start)) / F.lit(width)).cast("long")
    have = F.when(F.col(y).isNotNull(), F.struct(x, tie))
    return df.groupBy(*key, bucket.alias("bucket")).agg(
        F.min_by(y, have).alias("first_y"), F.min(y).alias("min_y"), F.max(y).alias("max_y"), F.max_by(y, have).alias("last_y"), (F.count(y) == 0).alias("gap"), F.count("*").alias("n")
    )
