"""Queries of positional, nearest, interval and interpolating joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.functions.dates import epoch_micros, from_micros
from lattica.operators import joins as J
from lattica.operators.windows import timeline
from lattica.sources.tables import table

from .base import query


@query("""
WITH bg AS (SELECT l_partkey AS k, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) - 1 AS pos FROM lineitem WHERE l_returnflag = 'A'),
fg AS (SELECT l_partkey AS k, l_orderkey AS fg_order, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) - 1 AS pos FROM lineitem WHERE l_returnflag = 'R')
SELECT k, pos, l_orderkey, l_linenumber, fg_order FROM bg JOIN fg USING (k, pos)
""")
def zip_pairs(spark, sf_dir):
    """The i-th of one list with the i-th of another, by part."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "k")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]
    bg = li.where("l_returnflag = 'A'").select("k", *order)
    fg = li.where("l_returnflag = 'R'").select("k", *[F.col(c).alias(f"fg_{c}") for c in order])
    out = J.zip_join(bg, fg, ["k"], order, [f"fg_{c}" for c in order])
    return out.select("k", "pos", "l_orderkey", "l_linenumber", F.col("fg_l_orderkey").alias("fg_order"))


@query("""
WITH bg AS (SELECT user_id, event_id AS bg_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos FROM events WHERE event_type = 'click'),
fg AS (SELECT user_id, event_id AS fg_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) - 1 AS pos FROM events WHERE event_type = 'view')
SELECT user_id, pos, bg_id, fg_id FROM bg JOIN fg USING (user_id, pos)
""")
def zip_pairs_reversed(spark, sf_dir):
    """One list with the other reversed over its whole length."""
    e = table(spark, sf_dir, "events")
    bg = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("bg_id"), F.col("ts").alias("bg_ts"))
    fg = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("fg_id"), F.col("ts").alias("fg_ts"))
    return J.zip_join(bg, fg, ["user_id"], ["bg_ts"], [F.col("fg_ts").desc()]).select("user_id", "pos", "bg_id", "fg_id")


@query("""
WITH n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos FROM events)
SELECT a.user_id, a.pos // 2 AS pair, a.event_id AS first_event_id, a.value AS first_value, b.event_id AS second_event_id, b.value AS second_value
FROM n a JOIN n b ON a.user_id = b.user_id AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0
""")
def adjacent_pairs(spark, sf_dir):
    """Neighbours two by two, an odd last one left out."""
    return J.adjacent_pairs(table(spark, sf_dir, "events"), ["user_id"], ["ts"], ["event_id", "value"])


_SERIES = "SELECT hour(ts) + 24 * dayofmonth(ts) AS x, event_id AS pos, CASE WHEN value > 60 THEN NULL ELSE value END AS y FROM events WHERE event_type = '{0}'"


def _hourly(spark, sf_dir, kind):
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select((F.hour("ts") + 24 * F.dayofmonth("ts")).cast("long").alias("x"), F.col("event_id").alias("pos"), F.when(F.col("value") <= 60, F.col("value")).alias("y"))


def _align_sql(where: str) -> str:
    ctes = ", ".join(f"{k} AS (SELECT x, arg_max_null(y, pos) AS {k} FROM ({_SERIES.format(k)}) {where} GROUP BY x)" for k in ("click", "view", "error"))
    return f"WITH {ctes} SELECT x, click, view, error FROM click FULL JOIN view USING (x) FULL JOIN error USING (x)"


@query(_align_sql(""))
def outer_align(spark, sf_dir):
    """Three series on the union of their x; the last row of an x counts."""
    return J.outer_align([(_hourly(spark, sf_dir, k), k) for k in ("click", "view", "error")])


@query(_align_sql("WHERE y IS NOT NULL"))
def outer_align_remove(spark, sf_dir):
    """As ``outer_align``, null rows removed first."""
    return J.outer_align([(_hourly(spark, sf_dir, k), k) for k in ("click", "view", "error")], mode="remove")


@query(f"""
WITH a AS (SELECT x, arg_max_null(y, pos) AS click, TRUE AS has FROM ({_SERIES.format('click')}) GROUP BY x), b AS (SELECT x, arg_max_null(y, pos) AS view FROM ({_SERIES.format('view')}) GROUP BY x),
j AS (SELECT x, click, view, has FROM a FULL JOIN b USING (x)), s AS (SELECT *, CASE WHEN has THEN click IS NULL END AS slot FROM j),
w AS (SELECT *, last_value(slot IGNORE NULLS) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, first_value(slot IGNORE NULLS) OVER (ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM s)
SELECT x, click, view, CASE WHEN has THEN click IS NULL ELSE coalesce(p, FALSE) OR coalesce(q, FALSE) END AS gap_click FROM w
""")
def outer_align_expand(spark, sf_dir):
    """Null slots spread to the absent slots beside them."""
    return J.outer_align([(_hourly(spark, sf_dir, k), k) for k in ("click", "view")], mode="expand").drop("gap_view")


@query("""
WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT event_id AS near_id, user_id, ts AS near_ts FROM events WHERE event_type = 'purchase')
SELECT c.event_id, c.user_id, near_id, near_ts FROM c LEFT JOIN p ON c.user_id = p.user_id
QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY abs(epoch_us(near_ts) - epoch_us(c.ts)), near_ts) = 1
""")
def nearest_event(spark, sf_dir):
    """For each click the user's nearest purchase in time, the earlier on a tie."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", epoch_micros(F.col("ts")).alias("us"))
    out = J.nearest(e.where("event_type = 'click'").select("event_id", "user_id", "us"), e.where("event_type = 'purchase'").select("user_id", "us", "event_id"), ["user_id"], "us", "event_id")
    return out.select("event_id", "user_id", "near_id", from_micros(F.col("near_x")).alias("near_ts"))


@query("""
SELECT p_brand, arg_min(p_partkey, (p_size - 20) * (p_size - 20) * 1e9 + (p_retailprice - 950) * (p_retailprice - 950) * 1e9 + p_partkey / 1e6) AS p_partkey,
       min((p_size - 20) * (p_size - 20) + (p_retailprice - 950) * (p_retailprice - 950)) AS distance2
FROM part GROUP BY p_brand
""")
def nearest_point_2d(spark, sf_dir):
    """The item nearest to a point in the plane."""
    return J.nearest_point(table(spark, sf_dir, "part"), 20, 950.0, "p_size", "p_retailprice", "p_partkey", ["p_brand"])


@query("""
WITH r AS (SELECT o_custkey, o_orderkey AS id, datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS a, datediff('day', DATE '1990-01-01', o_orderdate::DATE) + 5 + o_orderkey % 40 AS b FROM orders)
SELECT x.o_custkey, x.id AS a_id, y.id AS b_id FROM r x JOIN r y ON x.o_custkey = y.o_custkey AND x.id < y.id AND x.a <= y.b AND y.a <= x.b
""")
def interval_overlap(spark, sf_dir):
    """Orders of a customer whose periods touch, met in month-long buckets."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.to_date(F.lit("1990-01-01")))
    r = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), day.cast("long").alias("a"), (day + 5 + F.col("o_orderkey") % 40).alias("b"))
    return J.overlaps(r, ["o_custkey"], "id", "a", "b", 30)


_LERP = """
WITH a AS (SELECT user_id, epoch_us(ts) / 1e6 AS x, value AS ya FROM events WHERE event_type = 'click'), b AS (SELECT user_id, epoch_us(ts) / 1e6 AS x, value AS yb FROM events WHERE event_type = 'view'),
j AS (SELECT user_id, x, ya, yb FROM a FULL JOIN b USING (user_id, x)),
w AS (SELECT *, last_value(CASE WHEN ya IS NOT NULL THEN x END IGNORE NULLS) OVER up AS ax0, last_value(ya IGNORE NULLS) OVER up AS ay0, first_value(CASE WHEN ya IS NOT NULL THEN x END IGNORE NULLS) OVER down AS ax1, first_value(ya IGNORE NULLS) OVER down AS ay1,
      last_value(CASE WHEN yb IS NOT NULL THEN x END IGNORE NULLS) OVER up AS bx0, last_value(yb IGNORE NULLS) OVER up AS by0, first_value(CASE WHEN yb IS NOT NULL THEN x END IGNORE NULLS) OVER down AS bx1, first_value(yb IGNORE NULLS) OVER down AS by1
      FROM j WINDOW up AS (PARTITION BY user_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS (PARTITION BY user_id ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT user_id, x, CASE WHEN ya IS NOT NULL THEN ya WHEN ax0 IS NOT NULL AND ax1 IS NOT NULL THEN ay0 + (ay1 - ay0) * (x - ax0) / (ax1 - ax0) END AS a, CASE WHEN yb IS NOT NULL THEN yb WHEN bx0 IS NOT NULL AND bx1 IS NOT NULL THEN by0 + (by1 - by0) * (x - bx0) / (bx1 - bx0) END AS b FROM w)
"""


def _curves(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (epoch_micros(F.col("ts")) / 1e6).alias("x"), F.col("value").alias("y"))
    return e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'view'").drop("event_type")


@query(_LERP + "SELECT user_id, x, round(coalesce(a, 0), 4) AS bottom, round(coalesce(a, 0) + b, 4) AS top FROM l WHERE b IS NOT NULL")
def stacked_lerp(spark, sf_dir):
    """A series stacked on another with interpolation at unmatched x."""
    base, other = _curves(spark, sf_dir)
    return J.stacked(base, other, ["user_id"]).select("user_id", "x", F.round("bottom", 4).alias("bottom"), F.round("top", 4).alias("top"))


@query(_LERP + "SELECT user_id, x, round(a, 4) AS bottom, round(b, 4) AS top FROM l WHERE b IS NOT NULL")
def fill_between(spark, sf_dir):
    """A series with its partner as the bottom."""
    partner, series = _curves(spark, sf_dir)
    return J.filled_between(series, partner, ["user_id"]).select("user_id", "x", F.round("bottom", 4).alias("bottom"), F.round("top", 4).alias("top"))


_BROKEN = """
WITH a AS (SELECT user_id, epoch_us(ts) / 1e6 AS x, CASE WHEN value <= 60 THEN value END AS y, TRUE AS own FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, epoch_us(ts) / 1e6 AS x, CASE WHEN value <= 60 THEN value END AS y, TRUE AS own FROM events WHERE event_type = 'view'),
j AS (SELECT user_id, x, a.y AS ya, b.y AS yb, coalesce(a.own, FALSE) AS oa, coalesce(b.own, FALSE) AS ob FROM a FULL JOIN b USING (user_id, x)),
n AS (SELECT *, last_value(CASE WHEN oa THEN {'x': x, 'y': ya} END IGNORE NULLS) OVER up AS a0, first_value(CASE WHEN oa THEN {'x': x, 'y': ya} END IGNORE NULLS) OVER down AS a1,
             last_value(CASE WHEN ob THEN {'x': x, 'y': yb} END IGNORE NULLS) OVER up AS b0, first_value(CASE WHEN ob THEN {'x': x, 'y': yb} END IGNORE NULLS) OVER down AS b1, max(CASE WHEN ob THEN x END) OVER (PARTITION BY user_id) AS last_b
      FROM j WINDOW up AS (PARTITION BY user_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS (PARTITION BY user_id ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT user_id, x, last_b, oa AND ya IS NULL AS ga, ob AND yb IS NULL AS gb, CASE WHEN oa THEN ya ELSE a0.y + (a1.y - a0.y) * (x - a0.x) / (a1.x - a0.x) END AS a, CASE WHEN ob THEN yb ELSE b0.y + (b1.y - b0.y) * (x - b0.x) / (b1.x - b0.x) END AS b FROM n),
l AS (SELECT user_id, x, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a END AS bottom, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b END AS own, a + b AS top FROM v WHERE (a IS NOT NULL AND b IS NOT NULL) OR gb OR (ga AND x < last_b))
"""


def _broken_curves(spark, sf_dir):
    return [df.withColumn("y", F.when(F.col("y") <= 60, F.col("y"))) for df in _curves(spark, sf_dir)]


def _rounded(df):
    return df.select("user_id", "x", *[c for c in df.columns if c == "seq"], F.round("bottom", 4).alias("bottom"), F.round("top", 4).alias("top"))


@query(_BROKEN + "SELECT user_id, x, 1 AS seq, round(bottom, 4) AS bottom, round(top, 4) AS top FROM l")
def stacked_gaps(spark, sf_dir):
    """Stacked lines that break at nulls of either series."""
    base, other = _broken_curves(spark, sf_dir)
    return _rounded(J.stacked_lines(base, other, ["user_id"]))


@query(_BROKEN + """, r AS (SELECT *, lag(top) OVER w AS t0, lag(bottom) OVER w AS b0 FROM l WINDOW w AS (PARTITION BY user_id ORDER BY x))
SELECT user_id, x, 1 AS seq, round(bottom, 4) AS bottom, round(top, 4) AS top FROM l UNION ALL SELECT user_id, x, 0, round(b0, 4), round(t0, 4) FROM r WHERE t0 <> top""")
def stacked_steps(spark, sf_dir):
    """Stacked lines with gaps that keep their height up to the next point."""
    base, other = _broken_curves(spark, sf_dir)
    return _rounded(J.stacked_lines(base, other, ["user_id"], steps=True))


@query(_BROKEN + "SELECT user_id, x, 1 AS seq, round(bottom, 4) AS bottom, round(own, 4) AS top FROM l")
def fill_between_gaps(spark, sf_dir):
    """The area between two lines that break at nulls."""
    partner, series = _broken_curves(spark, sf_dir)
    return _rounded(J.stacked_lines(partner, series, ["user_id"], add=False))


@query("""
WITH h AS (SELECT event_type, epoch_us(date_trunc('hour', ts)) // 3600000000 AS x, max(value) AS v FROM events GROUP BY ALL), a AS (SELECT x, v FROM h WHERE event_type = 'click'), b AS (SELECT x, CASE WHEN v < 95 THEN v END AS v FROM h WHERE event_type = 'view')
SELECT 1 AS k, x, CASE WHEN b.v IS NOT NULL THEN coalesce(a.v, 0) END AS bottom, coalesce(a.v, 0) + b.v AS top FROM b LEFT JOIN a USING (x)
""")
def stacked_bar_series(spark, sf_dir):
    """Hourly bars on bars, nothing interpolated."""
    us = epoch_micros(F.col("ts"))
    h = table(spark, sf_dir, "events").groupBy("event_type", F.floor(us / 3_600_000_000).cast("long").alias("x")).agg(F.max("value").alias("y"))
    one = lambda kind: h.where(F.col("event_type") == kind).select(F.lit(1).alias("k"), "x", "y")
    return J.stacked_bars(one("click"), one("view").withColumn("y", F.when(F.col("y") < 95, F.col("y"))), ["k"])


@query("SELECT p_partkey, coalesce(lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey), -1) AS below FROM part")
def stack_key_lookup(spark, sf_dir):
    """The last earlier series with the same stack key, -1 without one."""
    below = F.lag("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(below, F.lit(-1)).cast("long").alias("below"))


@query("SELECT event_id, label FROM events JOIN (SELECT unnest(['click', 'view', 'purchase']) AS event_type, unnest(['Clicks', 'Views', 'Sales']) AS label) USING (event_type)")
def legend_lookup(spark, sf_dir):
    """Labels from a small dictionary."""
    names = spark.createDataFrame([("click", "Clicks"), ("view", "Views"), ("purchase", "Sales")], "event_type string, label string")
    return table(spark, sf_dir, "events").join(F.broadcast(names), "event_type").select("event_id", "label")


@query("""
WITH bg AS (SELECT user_id, event_id AS bg_clip, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1) * 2 AS s1 FROM events WHERE event_type = 'click'),
fg AS (SELECT user_id, event_id AS fg_clip, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1) * 3 AS s2 FROM events WHERE event_type = 'purchase')
SELECT user_id, bg_clip, fg_clip, greatest(s1, s2) AS "start", least(s1 + 2, s2 + 3) AS "end" FROM bg JOIN fg USING (user_id) WHERE s1 < s2 + 3 AND s2 < s1 + 2
""")
def overlay_timelines(spark, sf_dir):
    """Two timelines of unequal clips laid over each other."""
    e = table(spark, sf_dir, "events")
    bg = timeline(e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("clip"), F.lit(2).cast("long").alias("d")), ["user_id"], ["ts"], "d")
    fg = timeline(e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("clip"), F.lit(3).cast("long").alias("d")), ["user_id"], ["ts"], "d")
    return J.overlaid(bg, fg, ["user_id"], 12)
