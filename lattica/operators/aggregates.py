"""Facets, totals and shares, ranges of series, and slices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lattica.functions.numbers import summed

HIDE_ABOVE = 0.6
#: Texts that are joined to one value at most, where a key's whole text is hashed part by part.
PART_ROWS = 1_000


def facet_counts(df: DataFrame, value: str, array: bool = False) -> DataFrame:
    """(value, n): rows for each value; null counts as '', arrays count once for each element."""
    held = F.explode(F.col(value)) if array else F.col(value)
    return df.select(held.alias("value")).groupBy(F.coalesce("value", F.lit("")).alias("value")).agg(F.count("*").alias("n"))


def shown_total(df: DataFrame, value: str, filtered: Column) -> DataFrame:
    """(value, shown, total): rows that pass the other filters, and all; options without a row shown are left out."""
    out = df.groupBy(F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value")).agg(F.count_if(filtered).alias("shown"), F.count("*").alias("total"))
    return out.where("shown > 0")


def predicate_counts(df: DataFrame, predicates: dict[str, Column], filtered: Column) -> DataFrame:
    """(value, shown, total) for named predicates, in one pass over the rows."""
    parts = [F.struct(F.lit(n).alias("value"), F.count_if(p & filtered).alias("shown"), F.count_if(p).alias("total")) for n, p in predicates.items()]
    return df.agg(F.array(*parts).alias("_p")).select(F.explode("_p").alias("_p")).select("_p.value", "_p.shown", "_p.total")


def unique_ratio(df: DataFrame, columns: Sequence[str], above: float = HIDE_ABOVE, own: dict[str, float] | None = None) -> DataFrame:
    """(column, bins, ratio, hidden): a facet is hidden if too many values are unique or all are one."""
    each = df.agg(F.count("*").alias("n"), *[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    limits = own or {}
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).alias("bins"), (F.col(c) / F.nullif(F.col("n"), F.lit(0))).alias("ratio"), F.lit(limits.get(c, above)).alias("limit")) for c in columns]
    told = each.select(F.explode(F.array(*parts)).alias("_p")).select("_p.*")
    return told.select("column", "bins", "ratio", (F.col("ratio") > F.col("limit")).alias("_many"), (F.col("bins") <= 1).alias("_one")).select("column", "bins", "ratio", (F.col("_many") | F.col("_one")).alias("hidden"))


def totals_by(df: DataFrame, key: Sequence[str], value: str, name: str = "total", digits: int | None = None) -> DataFrame:
    """Sums by key; nulls are skipped. ``digits`` here and below: as in ``summed``."""
    return df.groupBy(*key).agg(summed(F.col(value), digits).alias(name))


def percent_of(df: DataFrame, key: Sequence[str], value: str, name: str = "percent", digits: int | None = None) -> DataFrame:
    """Each value as a percentage of its key's total; 0 where that is zero."""
    totals = df.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(summed(F.col(value), digits).alias("_t"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    return df.join(totals, same).drop(*[f"_{k}" for k in key]).withColumn(name, F.when(F.col("_t") == 0, F.lit(0.0)).otherwise(F.lit(100.0) * F.col(value) / F.col("_t"))).drop("_t")


def sum_within(df: DataFrame, key: Sequence[str], x: str, y: str, low, high, digits: int | None = None) -> DataFrame:
    """Sums by key of what lies strictly between two x."""
    inside = (F.col(x) > F.lit(low)) & (F.col(x) < F.lit(high))
    return df.groupBy(*key).agg(F.coalesce(summed(F.when(inside, F.col(y)), digits), F.lit(0.0)).alias("total"))


def log_range(df: DataFrame, key: Sequence[str], y: str) -> DataFrame:
    """Least and greatest positive value, 1 and 10 where there is none."""
    positive = F.when(F.col(y) > 0, F.col(y))
    return df.groupBy(*key).agg(F.coalesce(F.min(positive), F.lit(1.0)).alias("log_min"), F.coalesce(F.max(positive), F.lit(10.0)).alias("log_max"))


def least_gap(df: DataFrame, key: Sequence[str], x: str, default: float = 0.5) -> DataFrame:
    """The least positive distance between neighbours in x."""
    d = F.col(x) - F.lag(x).over(Window.partitionBy(*key).orderBy(x))
    return df.withColumn("_d", d).groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(default)).alias("min_gap"))


def stacked_extremes(df: DataFrame, index: Sequence[str], y: str, digits: int | None = None) -> DataFrame:
    """The greatest stack of positive and the least stack of negative values over all indices."""
    each = df.groupBy(*index).agg(F.coalesce(summed(F.when(F.col(y) > 0, F.col(y)), digits), F.lit(0.0)).alias("p"), F.coalesce(summed(F.when(F.col(y) < 0, F.col(y)), digits), F.lit(0.0)).alias("n"))
    return each.agg(F.max("p").alias("max_stack"), F.min("n").alias("min_stack"))


def padded_range(df: DataFrame, key: Sequence[str], x: str, y: str, low, high, pad: float = 0.1) -> DataFrame:
    """The range of y within a window of x, padded outwards by a share of each end's size."""
    inside = F.when(F.col(x).between(F.lit(low), F.lit(high)), F.col(y))
    ends = df.groupBy(*key).agg(F.min(inside).alias("_a"), F.max(inside).alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    return ends.select(*key, F.when(a < 0, a * (1 + pad)).otherwise(a * (1 - pad)).alias("y_min"), F.when(b < 0, b * (1 - pad)).otherwise(b * (1 + pad)).alias("y_max"))


def combined_slices(df: DataFrame, key: Sequence[str], label: str, value: str, threshold: float, other: str = "Other", digits: int | None = None) -> DataFrame:
    """(key, label, value, percent, angle): slices of at most ``threshold`` of the total in
    one, if there are two or more of them; values that are null or negative count 0."""
    w = Window.partitionBy(*key)
    rows = df.withColumn("_v", F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("_t", F.sum(F.col("_v") if digits is None else F.col("_v").cast(f"decimal(28,{digits})")).over(w).cast("double"))
    share = F.when(F.col("_t") > 0, F.col("_v") / F.col("_t")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_small", share <= threshold).withColumn("_few", F.count_if(F.col("_small")).over(w))
    named = rows.withColumn("label", F.when(F.col("_small") & (F.col("_few") >= 2), F.lit(other)).otherwise(F.col(label)))
    out = named.groupBy(*key, "label").agg(summed(F.col("_v"), digits).alias("value"), F.max("_t").alias("_t"))
    part = F.when(F.col("_t") > 0, F.col("value") / F.col("_t")).otherwise(F.lit(0.0))
    return out.select(*key, "label", "value", (part * 100).alias("percent"), (part * 360).alias("angle"))


def pie_angles(df: DataFrame, key: Sequence[str], value: str, full: float = 360.0, digits: int | None = None) -> DataFrame:
    """``df`` with ``angle`` (the slice's share of its pie), ``polar_angle`` (all equal) and ``radius``
    (of a polar slice: its share of the pie's greatest value, which is 0 at least). Negative
    values and nulls have no angle; in a pie without positive values no slice has one."""
    pie, v = Window.partitionBy(*key), F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))
    rows = df.withColumn("_v", v if digits is None else v.cast(f"decimal(28,{digits})"))
    total, most = F.sum("_v").over(pie).cast("double"), F.greatest(F.max(value).over(pie), F.lit(0.0))
    rows = rows.withColumns({"_total": total, "_most": most, "_n": F.count("*").over(pie)})
    share = F.coalesce(F.col("_v").cast("double") / F.nullif(F.col("_total"), F.lit(0.0)), F.lit(0.0))
    out = rows.withColumns({"angle": share * full, "polar_angle": F.lit(float(full)) / F.col("_n"), "radius": F.col(value) / F.nullif(F.col("_most"), F.lit(0.0))})
    return out.drop("_v", "_total", "_most", "_n")


def ohlc_range(df: DataFrame, key: Sequence[str], low: str = "l", high: str = "h") -> DataFrame:
    """The y-range of candles: least low and greatest high."""
    return df.groupBy(*key).agg(F.min(low).alias("y_min"), F.max(high).alias("y_max"))


def y_range(df: DataFrame, key: Sequence[str], kind: str, y: str, ends: dict[str, tuple[str, str]], goals: str) -> DataFrame:
    """The y-range of series of several types. ``ends`` names the columns with the least and the
    greatest part of a type: low and high of candles, start and end of ranges, and of boxes,
    five numbers that lie in the parts of a candle, the first and the last. Other types have
    ``y`` alone; ``goals``, an array or null, widens any of them."""
    lows = highs = F.col(y)
    for name, (low, high) in ends.items():
        lows = F.when(F.col(kind) == name, F.least(low, high)).otherwise(lows)
        highs = F.when(F.col(kind) == name, F.greatest(low, high)).otherwise(highs)
    return df.groupBy(*key).agg(F.min(F.least(lows, F.array_min(goals))).alias("y_min"), F.max(F.greatest(highs, F.array_max(goals))).alias("y_max"))


def legend_positions(entries: DataFrame, label: str, at: str, how: str = "ascending", custom: Sequence | None = None) -> DataFrame:
    """Legend entries (few) with ``pos``: by label ascending or descending, ``reverse`` of
    their own order ``at``, or by a ``custom`` order."""
    order = {"ascending": [F.col(label).asc()], "descending": [F.col(label).desc()], "reverse": [F.col(at).desc()]}
    return entries.withColumn("pos", F.row_number().over(Window.orderBy(*(custom or order[how]), at)).cast("long") - 1)


def longest(df: DataFrame, series: str, pos: str) -> DataFrame:
    """The series with the most points, the first one on a tie."""
    each = df.groupBy(series).agg(F.count("*").alias("n"), F.min(pos).alias("_p"))
    return each.agg(F.max_by(series, F.struct("n", -F.col("_p"))).alias(series), F.max("n").alias("n"))


def series_facts(df: DataFrame, series: Sequence[str], x: str, y: str) -> DataFrame:
    """Whether all values of a series are null, whether all are equal, its first x, and
    whether all series have that first x."""
    each = df.groupBy(*series).agg(F.count("*").alias("n"), F.min(x).alias("first_x"), (F.count(y) == 0).alias("all_null"), (F.min(y) == F.max(y)).alias("all_equal"))
    return each.withColumn("shared_first_x", each.agg(F.count_distinct("first_x") <= 1).scalar())


def joined_sha256(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], text: str, sep: str = " ", name: str = "sha256", rows: int = PART_ROWS) -> DataFrame:
    """(*key, ``name``): SHA-256 of each key's texts joined in their order, for keys of any size; null texts are left out.

    Rows are sorted in ranges of (key, order), so that a hot key lies in many of them, and are
    joined there to parts of ``rows`` texts. This hash can only be told from a text's beginning to its
    end, so one task reads a key's parts in turn, but no value and no memory holds a key's
    whole text. Rows that are equal in ``order`` have no fixed order among them.
    """
    cell, part, joined = "_cell", "_part", "_joined"
    held = df.where(F.col(text).isNotNull()).repartitionByRange(*key, *order).withColumn(cell, F.spark_partition_id())
    own = F.row_number().over(Window.partitionBy(*key, cell).orderBy(*order))
    each = F.sort_array(F.collect_list(F.struct(F.col("_no"), F.col(text).alias("_text"))))
    parts = held.withColumn("_no", own).groupBy(*key, cell, F.floor((F.col("_no") - 1) / rows).alias(part)).agg(F.array_join(each["_text"], sep).cast("binary").alias(joined))
    keys, gap = list(key), sep.encode()

    def hashed(batches):
        import hashlib

        import pyarrow as pa

        def rows_of(done, types):
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True), types, strict=True)], [*keys, name])

        now = digest = types = None
        for batch in batches:
            done, types = [], [*[batch.schema.field(k).type for k in keys], pa.string()]
            for *of, piece in zip(*[batch.column(k).to_pylist() for k in keys], batch.column(joined), strict=True):
                if digest is None or of != now:
                    if digest is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = of, hashlib.sha256()
                else:
                    digest.update(gap)
                digest.update(piece.as_buffer())
            if done:
                yield rows_of(done, types)
        if digest is not None:
            yield rows_of([(*now, digest.hexdigest())], types)

    told = parts.repartition(*key).sortWithinPartitions(*key, cell, part).select(*key, joined)
    return told.mapInArrow(hashed, StructType([*df.select(*key).schema.fields, StructField(name, StringType())]))
