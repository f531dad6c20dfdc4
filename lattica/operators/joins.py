"""Positional, nearest, interval and interpolating joins.

Joins on order are unions and windows within a key, or equi-joins on position, never
theta joins over a whole table; interval joins meet in cells first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.written import written

from .ordering import keyed_position, position


def _numbered(df: DataFrame, key: Sequence[str], order: Sequence, name: str, hot: bool) -> DataFrame:
    return keyed_position(df, key, order, name) if hot else df.withColumn(name, position(*key, order=order))


def zip_join(left: DataFrame, right: DataFrame, key: Sequence[str], left_order: Sequence, right_order: Sequence, hot: bool = False) -> DataFrame:
    """The i-th row of the left with the i-th of the right, within a key; the shorter side ends it.
    ``hot``: a key may hold more rows than a task should number."""
    a = _numbered(left, key, left_order, "pos", hot)
    b = _numbered(right, key, right_order, "pos", hot)
    return a.join(b, [*key, "pos"])


def adjacent_pairs(df: DataFrame, key: Sequence[str], order: Sequence, columns: Sequence[str], hot: bool = False) -> DataFrame:
    """Rows 2k and 2k + 1 side by side as ``first_*`` and ``second_*``; an odd last row is left out.
    ``hot``: as in ``zip_join``; the two rows then meet by their pair, not in a window over the key."""
    if hot:
        numbered = keyed_position(df, key, order, "_n").withColumn("pair", F.expr("_n div 2"))
        side = lambda c, odd: F.max(F.when(F.col("_n") % 2 == odd, F.struct(c)))[c]
        both = numbered.groupBy(*key, "pair").agg(F.count("*").alias("_both"), *[side(c, 0).alias(f"first_{c}") for c in columns], *[side(c, 1).alias(f"second_{c}") for c in columns])
        return both.where("_both = 2").drop("_both")
    w = Window.partitionBy(*key).orderBy(*order)
    numbered = df.withColumn("_n", position(*key, order=order))
    ahead = numbered.select(*key, (F.col("_n") / 2).cast("long").alias("pair"), "_n", *[F.col(c).alias(f"first_{c}") for c in columns], *[F.lead(c).over(w).alias(f"second_{c}") for c in columns], F.lead("_n").over(w).alias("_next"))
    return ahead.where("_n % 2 = 0 and _next is not null").drop("_n", "_next")


def with_fallback(left: DataFrame, own: DataFrame, key: Sequence[str], value: str, general: DataFrame) -> DataFrame:
    """``value`` of ``own`` where the key has one, else that of the one-row ``general``, else null."""
    return left.join(own.select(*key, value), list(key), "left").withColumn(value, F.coalesce(value, general.agg(F.first(value)).scalar()))


def outer_align(tables: Sequence[tuple[DataFrame, str]], x: str = "x", mode: str = "retain") -> DataFrame:
    """N-way full outer join on x: one column y_i for each (df(x, y, pos), name).

    For an x that repeats in a table, its last row counts. ``remove`` ignores null rows
    before that; ``retain`` keeps nulls as they are; ``expand`` also marks as ``gap_*``
    the absent slots that touch a null row's slot.
    """
    parts = []
    for df, name in tables:
        rows = df.where("y is not null") if mode == "remove" else df
        parts.append(rows.groupBy(x).agg(F.max_by(F.struct("y"), "pos")["y"].alias(name), F.lit(True).alias(f"_{name}")))
    out = reduce(lambda a, b: a.join(b, x, "full_outer"), parts)
    names = [n for _, n in tables]
    if mode == "expand":
        out = _with_gaps(out, names, x)
    return out.drop(*[f"_{n}" for n in names])


def _with_gaps(aligned: DataFrame, names: Sequence[str], x: str) -> DataFrame:
    """Adds ``gap_*``: explicit nulls, and absent slots next to one through any run of absent slots.

    Windows run within the partitions of a sorted, written copy; what lies before and after
    a partition is one row for each of them.
    """
    spark = aligned.sparkSession
    slot = {n: F.when(F.col(f"_{n}"), F.col(n).isNull()) for n in names}
    held = written(aligned.orderBy(x).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33).cast("int"))
    ends = [e for n in names for e in (F.min_by(slot[n], F.when(slot[n].isNotNull(), F.col("_at"))).alias(f"_first_{n}"), F.max_by(slot[n], F.when(slot[n].isNotNull(), F.col("_at"))).alias(f"_last_{n}"))]
    parts = held.groupBy("_part").agg(*ends).orderBy("_part").collect()  # a row for each partition
    rows = [[r["_part"]] for r in parts]
    for n in names:
        seen = None
        for r, row in zip(parts, rows, strict=True):
            row.append(seen)
            seen = r[f"_last_{n}"] if r[f"_last_{n}"] is not None else seen
        seen = None
        for r, row in zip(reversed(parts), reversed(rows), strict=True):
            row.append(seen)
            seen = r[f"_first_{n}"] if r[f"_first_{n}"] is not None else seen
    schema = "_part int" + "".join(f", `_before_{n}` boolean, `_after_{n}` boolean" for n in names)
    out = held.join(F.broadcast(spark.createDataFrame([tuple(r) for r in rows], schema)), "_part")
    w = Window.partitionBy("_part").orderBy("_at")
    for n in names:
        before = F.coalesce(F.last(slot[n], True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"_before_{n}"), F.lit(False))
        after = F.coalesce(F.first(slot[n], True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col(f"_after_{n}"), F.lit(False))
        out = out.withColumn(f"gap_{n}", F.coalesce(slot[n], before | after))
    return out.drop("_part", "_at", *[f"_{side}_{n}" for n in names for side in ("before", "after")])


def nearest(left: DataFrame, right: DataFrame, key: Sequence[str], x: str, rid: str) -> DataFrame:
    """For each left row the right row with the nearest x within the key; the lower one on a tie.

    One union and two windows over the key; adds ``near_x`` and ``near_id``.
    """
    a = left.withColumn("_side", F.lit(1))
    b = right.select(*key, F.col(x), F.struct(F.col(x).alias("x"), F.col(rid).alias("id")).alias("_r"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(x, "_side", F.col("_r.id"))
    back = Window.partitionBy(*key).orderBy(F.col(x).desc(), F.col("_side"), F.col("_r.id").desc())
    low = F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.last("_r", True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_low", low).withColumn("_high", high).where("_side = 1")
    lower = F.col("_high").isNull() | (F.col("_low").isNotNull() & (F.col(x).cast("double") - F.col("_low.x").cast("double") <= F.col("_high.x").cast("double") - F.col(x).cast("double")))
    pick = F.when(lower, F.col("_low")).otherwise(F.col("_high"))
    return found.withColumn("near_x", pick["x"]).withColumn("near_id", pick["id"]).drop("_side", "_r", "_low", "_high")


def nearest_point(points: DataFrame, px, py, x: str, y: str, item: str, key: Sequence[str] = ()) -> DataFrame:
    """The item nearest to a point in the plane, the first one on a tie."""
    d = (F.col(x) - F.lit(px)) * (F.col(x) - F.lit(px)) + (F.col(y) - F.lit(py)) * (F.col(y) - F.lit(py))
    return points.groupBy(*key).agg(F.min_by(item, F.struct(d, F.col(item))).alias(item), F.min(d).alias("distance2"))


#: Intervals of up to so many cells are kept in them; longer ones in cells that many times as wide, and so on.
LONG, LEVELS = 64, 4


def _own_level(low: str, high: str, width: float) -> Column:
    """The level of cells that suits an interval's length."""
    span = (F.col(high) - F.col(low)) / F.lit(float(width))
    own = F.lit(LEVELS - 1)
    for n in range(LEVELS - 2, -1, -1):
        own = F.when(span < F.lit(float(LONG ** (n + 1))), F.lit(n)).otherwise(own)
    return own


def _top_level(df: DataFrame, low: str, high: str, width: float) -> Column:
    """The coarsest level that suits any interval: beyond it none can meet."""
    return df.agg(F.max(_own_level(low, high, width))).scalar()


def _celled(df: DataFrame, low: str, high: str, width: float, top: Column | None = None) -> DataFrame:
    """``df`` with ``_own``, the level of cells that suits the interval's length, and a row for
    each cell (``_level``, ``_cell``) that it covers on its own and on coarser levels up to
    ``top`` (all without it): ``LONG`` + 1 on any level but the coarsest, at most."""
    held = df.withColumns({"_own": _own_level(low, high, width), "_top": F.lit(LEVELS - 1) if top is None else top})

    def covered(n: int) -> Column:
        at = lambda c: F.floor(F.col(c) / F.lit(float(width * LONG**n))).cast("long")
        cells = F.transform(F.sequence(at(low), at(high)), lambda c: F.struct(F.lit(n).alias("_level"), c.alias("_cell")))
        return F.when(F.lit(n).between(F.col("_own"), F.col("_top")), cells).otherwise(F.array().cast("array<struct<_level:int,_cell:bigint>>"))

    return held.withColumn("_c", F.explode(F.concat(*map(covered, range(LEVELS))))).select("*", "_c._level", "_c._cell").drop("_c", "_top")


def _first_cell(width: float, a: str, b: str) -> Column:
    """The cell, on the row's level, in which two intervals that begin at ``a`` and ``b`` both are for the first time."""
    wide = F.lit(float(width)) * F.pow(F.lit(float(LONG)), F.col("_level"))
    return F.floor(F.greatest(a, b) / wide).cast("long")


def overlaps(df: DataFrame, key: Sequence[str], rid: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs (a_id < b_id) of intervals of a key that touch, ends included.

    Each interval enters the cells of ``width`` that it covers; a long one enters wider
    cells instead, where all intervals can meet it. A pair is taken on the level of the longer
    of the two, in the first cell that both cover, so no pair comes twice, only near rows ever
    meet, and an interval of any length has a bounded number of rows. One aggregate first
    finds the longest interval; levels coarser than its own get no rows.
    """
    cells = _celled(df.select(*key, rid, low, high), low, high, width, _top_level(df, low, high, width))
    a = cells.where("_own = _level").select(*key, "_level", "_cell", F.col(rid).alias("a_id"), F.col(low).alias("a_low"), F.col(high).alias("a_high"))
    b = cells.select(*key, "_level", "_cell", F.col(rid).alias("b_id"), F.col(low).alias("b_low"), F.col(high).alias("b_high"), F.col("_own").alias("b_own"))
    met = a.join(b, [*key, "_level", "_cell"]).where("(b_own < _level or a_id < b_id) and a_low <= b_high and b_low <= a_high")
    met = met.where(F.col("_cell") == _first_cell(width, "a_low", "b_low"))
    return met.select(*key, F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"))


def interpolated(base: DataFrame, other: DataFrame, key: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Both series on the union of their x within the key: (key, x, base_y, other_y, base_gap,
    other_gap), where a value that is missing lies on the line between its neighbours and is
    null beyond the series' ends. Inputs have unique x. A row with a null y is a gap (told by
    ``*_gap`` at its x): the line ends before it and begins anew behind it."""
    a = base.select(*key, F.col(x), F.col(y).alias("base_y"), F.lit(True).alias("_base"))
    b = other.select(*key, F.col(x), F.col(y).alias("other_y"), F.lit(True).alias("_other"))
    both = a.join(b, [*key, x], "full_outer")
    w = Window.partitionBy(*key).orderBy(x)
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)

    def line(name: str) -> Column:
        y, own = F.col(f"{name}_y"), F.col(f"_{name}")
        point = F.when(own, F.struct(F.col(x).alias("x"), y.alias("y")))  # gaps are neighbours too
        p, q = F.last(point, True).over(up), F.first(point, True).over(down)
        between = p["y"] + (q["y"] - p["y"]) * (F.col(x) - p["x"]) / F.nullif(q["x"] - p["x"], F.lit(0.0))
        return F.when(own, y).when(p["y"].isNotNull() & q["y"].isNotNull(), between)

    gap = lambda name: F.coalesce(F.col(f"_{name}") & F.col(f"{name}_y").isNull(), F.lit(False)).alias(f"{name}_gap")
    return both.select(*key, x, line("base").alias("base_y"), line("other").alias("other_y"), gap("base"), gap("other"))


def stacked(base: DataFrame, other: DataFrame, key: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """``other`` on top of ``base``: (key, x, bottom, top) at every x of either within ``other``,
    over zero where ``base`` has no line."""
    both = interpolated(base, other, key, x, y).where("other_y is not null")
    return both.select(*key, x, F.coalesce("base_y", F.lit(0.0)).alias("bottom"), (F.coalesce("base_y", F.lit(0.0)) + F.col("other_y")).alias("top"))


def filled_between(series: DataFrame, partner: DataFrame, key: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """A series with its partner's value as the bottom at every x, nothing added up."""
    both = interpolated(partner, series, key, x, y).where("other_y is not null")
    return both.select(*key, x, F.col("base_y").alias("bottom"), F.col("other_y").alias("top"))


def stacked_lines(base: DataFrame, other: DataFrame, key: Sequence[str], x: str = "x", y: str = "y", add: bool = True, steps: bool = False) -> DataFrame:
    """Lines with gaps over each other: (key, x, seq, bottom, top).

    A row stands wherever both lines are defined, and none where one has not begun, has ended
    or is broken. A gap of ``other``, and one of ``base`` before the end of ``other``, is a row
    of nulls, so that what is drawn breaks there. Without ``add`` the base is only the bottom
    (an area between two lines). With ``steps`` a line keeps its height up to the next point:
    before each point (seq 1) whose top differs from that of the point before it stands one
    (seq 0) at its x with the top and bottom of that point before.
    """
    both = interpolated(base, other, key, x, y)
    end = F.max(F.when(F.col("other_y").isNotNull() | F.col("other_gap"), F.col(x))).over(Window.partitionBy(*key))
    both = both.withColumn("_end", end)
    gap = F.col("other_gap") | (F.col("base_gap") & (F.col(x) < F.col("_end")))
    defined = F.col("base_y").isNotNull() & F.col("other_y").isNotNull()
    top = F.col("base_y") + F.col("other_y") if add else F.col("other_y")
    rows = both.where(defined | gap).select(*key, x, F.lit(1).alias("seq"), F.when(defined, F.col("base_y")).alias("bottom"), F.when(defined, top).alias("top"))
    if not steps:
        return rows
    w = Window.partitionBy(*key).orderBy(x)
    risers = rows.withColumn("_top", F.lag("top").over(w)).withColumn("_bottom", F.lag("bottom").over(w)).where("_top is not null and top is not null and top <> _top")
    return rows.union(risers.select(*key, x, F.lit(0).alias("seq"), "_bottom", "_top"))


def stacked_bars(base: DataFrame, other: DataFrame, key: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Bars on bars: (key, x, bottom, top) at the x of ``other``, over the base's bar of that x or
    over zero; a null bar stays null."""
    below = base.select(*key, F.col(x), F.coalesce(y, F.lit(0.0)).alias("bottom"))
    rows = other.select(*key, F.col(x), F.col(y).alias("_y")).join(below, [*key, x], "left")
    bottom = F.when(F.col("_y").isNotNull(), F.coalesce("bottom", F.lit(0.0)))
    return rows.select(*key, x, bottom.alias("bottom"), (bottom + F.col("_y")).alias("top"))


def overlaid(background: DataFrame, foreground: DataFrame, key: Sequence[str], width: float = 10) -> DataFrame:
    """Clips (clip, start, end) of two timelines that show at the same time, by key.

    As in ``overlaps``, clips meet in cells that suit the longer of the two, a pair in the
    first one that both cover.
    """
    a = _celled(background.select(*key, F.col("clip").alias("bg_clip"), F.col("start").alias("_s1"), F.col("end").alias("_e1")), "_s1", "_e1", width)
    b = _celled(foreground.select(*key, F.col("clip").alias("fg_clip"), F.col("start").alias("_s2"), F.col("end").alias("_e2")), "_s2", "_e2", width)
    on = [*key, "_level", "_cell"]
    longer = a.where("_own = _level").drop("_own").join(b.withColumnRenamed("_own", "_other"), on).where("_other <= _level").drop("_other")
    shorter = b.where("_own = _level").drop("_own").join(a.withColumnRenamed("_own", "_other"), on).where("_other < _level").drop("_other")
    met = longer.unionByName(shorter).where("_s1 < _e2 and _s2 < _e1").where(F.col("_cell") == _first_cell(width, "_s1", "_s2"))
    return met.select(*key, "bg_clip", "fg_clip", F.greatest("_s1", "_s2").alias("start"), F.least("_e1", "_e2").alias("end"))
