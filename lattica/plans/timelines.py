"""Queries of order-dependent operators: runs, timelines, splits, encodings, crossings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.functions.dates import epoch_micros
from lattica.functions.numbers import summed
from lattica.operators import windows as W
from lattica.operators.ordering import keyed_position
from lattica.sources.tables import table

from .base import query


@query("""
SELECT user_id, event_id, 'frame_' || lpad((row_number() OVER w - 1)::VARCHAR, 4, '0') AS name, CAST((row_number() OVER w - 1) * 500 AS BIGINT) AS "start", CAST(row_number() OVER w * 500 AS BIGINT) AS "end",
       CAST(count(*) OVER (PARTITION BY user_id) * 500 AS BIGINT) AS total
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
""")
def frame_timeline(spark, sf_dir):
    """Frames one after the other, with names and the total length in ms."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.lit(500).cast("long").alias("d"))
    out = W.timeline(e, ["user_id"], ["ts"], "d").withColumn("total", F.sum("d").over(Window.partitionBy("user_id")))
    return out.select("user_id", "event_id", W.frame_name((F.col("start") / 500).cast("long")).alias("name"), "start", "end", "total")


_RUNS = """
WITH v AS (SELECT user_id, event_id, ts, value, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, 'No group') AS "group" FROM events),
f AS (SELECT *, CASE WHEN lag("group") OVER (PARTITION BY user_id ORDER BY ts) = "group" THEN 0 ELSE 1 END AS new FROM v),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM f)
"""


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")))
    return W.runs(e, ["user_id"], ["ts"], "kind")


@query(_RUNS + 'SELECT user_id, group_no, "group", count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM g GROUP BY ALL')
def run_groups(spark, sf_dir):
    """Runs of equal values in a user's events."""
    return _runs(spark, sf_dir).groupBy("user_id", "group_no", "group").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(_RUNS + """, h AS (SELECT *, coalesce(CAST(floor(value / 40) AS BIGINT)::VARCHAR, 'No group') AS inner_group FROM g),
i AS (SELECT *, CASE WHEN lag(inner_group) OVER (PARTITION BY user_id, group_no ORDER BY ts) = inner_group THEN 0 ELSE 1 END AS fresh FROM h)
SELECT user_id, event_id, "group" AS group_1, group_no AS group_no_1, inner_group AS group_2, CAST(sum(fresh) OVER (PARTITION BY user_id, group_no ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no_2 FROM i""")
def nested_run_groups(spark, sf_dir):
    """Runs within runs."""
    e = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type"))).withColumn("size", F.floor(F.col("value") / 40).cast("long"))
    return W.nested_runs(e, ["user_id"], ["ts"], ["kind", "size"]).select("user_id", "event_id", "group_1", "group_no_1", "group_2", "group_no_2")


@query("""
WITH p AS (SELECT user_id, epoch_us(ts) / 1e6 AS x, value AS y FROM events), l AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY x)), t AS (SELECT unnest([10.0, 40.0, 90.0])::DOUBLE AS t)
SELECT user_id, x, y, CAST(y >= 10 AS INTEGER) + CAST(y >= 40 AS INTEGER) + CAST(y >= 90 AS INTEGER) AS band, FALSE AS crossing FROM p
UNION ALL SELECT user_id, x0 + (t - y0) * (x - x0) / (y - y0), t, CAST(t >= 10 AS INTEGER) + CAST(t >= 40 AS INTEGER) + CAST(t >= 90 AS INTEGER), TRUE FROM l, t WHERE y0 IS NOT NULL AND least(y, y0) < t AND t < greatest(y, y0)
""")
def threshold_bands(spark, sf_dir):
    """Bands of a series between several ascending thresholds, with all crossings."""
    e = table(spark, sf_dir, "events").select("user_id", (epoch_micros(F.col("ts")) / 1e6).alias("x"), F.col("value").alias("y"))
    return W.bands(e, ["user_id"], [90, 10, 40])


@query("SELECT l_orderkey, l_linenumber, l_quantity AS c1, l_quantity + 2.5::DOUBLE AS c2, l_quantity + 5.0::DOUBLE AS c3, l_quantity AS d2 FROM lineitem")
def autofill_right(spark, sf_dir):
    """Columns filled from the first one, as a series and as a copy."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("c1"), F.col("l_tax").alias("c2"), F.col("l_discount").alias("c3"))
    return li.select("l_orderkey", "l_linenumber", *W.fill_right(["c1", "c2", "c3"], 2.5), W.fill_right(["c1", "c2"])[1].alias("d2"))


@query(_RUNS + """SELECT user_id, group_no, "group", 1 AS level, CAST(1 AS BIGINT) AS n, event_id FROM g
UNION ALL SELECT user_id, group_no, "group", 0, count(*), -1 FROM g GROUP BY ALL""")
def run_headers(spark, sf_dir):
    """Rows and header rows of runs."""
    return W.with_headers(_runs(spark, sf_dir), ["user_id"], ["event_id"]).fillna(-1, ["event_id"])


@query(_RUNS + """SELECT user_id, group_no, "group", 1 AS level, CAST(1 AS BIGINT) AS n, event_id, NULL::DOUBLE AS total, NULL::DOUBLE AS most FROM g
UNION ALL SELECT user_id, group_no, "group", 0, count(*), NULL, NULL, NULL FROM g GROUP BY ALL
UNION ALL SELECT user_id, group_no, "group", 2, count(*), NULL, CAST(sum(CAST(value AS DECIMAL(28, 4))) AS DOUBLE), max(value) FROM g GROUP BY user_id, group_no, "group" """)
def run_footers(spark, sf_dir):
    """Rows, headers and footers of runs, the latter with sums."""
    return W.with_headers(_runs(spark, sf_dir), ["user_id"], ["event_id"], {"total": summed(F.col("value"), 4), "most": F.max("value")})


@query("""
WITH v AS (SELECT epoch_us(ts) // 3600000000 AS x, event_type IN ('click', 'view') AS stack, event_type, sum(CAST(value AS DECIMAL(28, 4))) AS y FROM events GROUP BY ALL)
SELECT x, stack, event_type, CAST(coalesce(sum(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS bottom, CAST(sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS top
FROM v WINDOW w AS (PARTITION BY x, stack ORDER BY event_type)
""")
def stacked_per_x(spark, sf_dir):
    """At every x the series of a stack on top of each other, in their order."""
    hour, stack = F.floor(epoch_micros(F.col("ts")) / 3_600_000_000).cast("long"), F.col("event_type").isin("click", "view")
    v = table(spark, sf_dir, "events").groupBy(hour.alias("x"), stack.alias("stack"), "event_type").agg(F.sum(F.col("value").cast("decimal(28,4)")).alias("y"))
    top = W.cumulative(v, ["x", "stack"], ["event_type"], "y", "top")
    return top.select("x", "stack", "event_type", (F.col("top") - F.col("y")).cast("double").alias("bottom"), F.col("top").cast("double").alias("top"))


@query("""
WITH t AS (SELECT user_id, event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1) * 500 AS BIGINT) AS s, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, s AS "start", s + 500 AS "end", FALSE AS held FROM t UNION ALL SELECT user_id, event_id, s + 500, s + 1500, TRUE FROM t WHERE s = (n - 1) * 500
""")
def timeline_held(spark, sf_dir):
    """A timeline whose last frame is held for another second."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.lit(500).cast("long").alias("d"))
    return W.held_last(W.timeline(e, ["user_id"], ["ts"], "d").select("user_id", "event_id", "start", "end"), ["user_id"], hold=1000)


@query("""
SELECT user_id, event_type, event_id, CAST(sum(CAST(value AS DECIMAL(20, 4))) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS stacked FROM events
""")
def stacked_cumulative(spark, sf_dir):
    """Values stacked in order within a stack key."""
    e = table(spark, sf_dir, "events").withColumn("v", F.col("value").cast("decimal(20,4)"))
    return W.cumulative(e, ["user_id", "event_type"], ["ts"], "v", "stacked").select("user_id", "event_type", "event_id", F.col("stacked").cast("double").alias("stacked"))


@query("""
WITH p AS (SELECT user_id, epoch_us(ts) / 1e6 AS x, value AS y FROM events), l AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY x))
SELECT user_id, round(x, 3) AS x, y, CASE WHEN y < 20 THEN 'under' ELSE 'over' END AS part FROM p
UNION ALL SELECT user_id, round(x0 + (20 - y0) * (x - x0) / (y - y0), 3), 20.0, 'crossing' FROM l WHERE y0 IS NOT NULL AND (y0 < 20) <> (y < 20) AND y <> 20 AND y0 <> 20
""")
def threshold_split(spark, sf_dir):
    """Parts of a series under and over a threshold, with the crossings."""
    e = table(spark, sf_dir, "events").select("user_id", (epoch_micros(F.col("ts")) / 1e6).alias("x"), F.col("value").alias("y"))
    return W.crossings(e, ["user_id"], 20).withColumn("x", F.round("x", 3))


@query("""
WITH s AS (SELECT o_orderpriority AS v, min(o_orderkey) AS f FROM orders GROUP BY 1), free AS (SELECT v, row_number() OVER (ORDER BY f, v) + 1 AS code FROM s WHERE v NOT IN ('3-MEDIUM', '5-LOW'))
SELECT v AS o_orderpriority, CAST(code AS BIGINT) AS code FROM free UNION ALL SELECT '3-MEDIUM', 0 UNION ALL SELECT '5-LOW', 1
""")
def dictionary_encode(spark, sf_dir):
    """Codes by first appearance, after preset ones."""
    return W.encoded(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", ["3-MEDIUM", "5-LOW"])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_extendedprice) = 1")
def dedupe_keep_first(spark, sf_dir):
    """The first row of each key."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return W.first_of(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS label FROM documents")
def generated_labels(spark, sf_dir):
    """Labels 1 to n."""
    numbered = keyed_position(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])
    return numbered.select("source", "doc_id", (F.col("pos") + 1).alias("label"))


@query("SELECT user_id, min(CASE WHEN value > 20 THEN event_id END) AS first_x, max(CASE WHEN value > 20 THEN event_id END) AS last_x FROM events GROUP BY user_id")
def first_last_filled(spark, sf_dir):
    """The first and last place with a value."""
    e = table(spark, sf_dir, "events").withColumn("y", F.when(F.col("value") > 20, F.col("value")))
    return W.first_last_filled(e, ["user_id"], "event_id", "y")


@query("""
SELECT o_orderkey, o_custkey, first_value(o_orderkey) OVER w + (row_number() OVER w - 1) * 10 AS series, first_value(o_orderstatus) OVER w AS down
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def autofill_series(spark, sf_dir):
    """Arithmetic series and constants from a key's first row."""
    order = ["o_orderdate", "o_orderkey"]
    out = W.series_fill(table(spark, sf_dir, "orders"), ["o_custkey"], order, "o_orderkey", 10, "series")
    return W.fill_down(out, ["o_custkey"], order, "o_orderstatus", "down").select("o_orderkey", "o_custkey", "series", "down")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, first_value(l_partkey) OVER w + (row_number() OVER w - 1) * 10 AS l_partkey,
       first_value(l_partkey) OVER w + (row_number() OVER w - 1) * 10 + 5 AS l_suppkey
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)
""")
def autofill_cells(spark, sf_dir):
    """A series that runs over several columns, row by row."""
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    return W.series_cells(cells, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], ["l_partkey", "l_suppkey"], 5)


@query("""
WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT doc_id, source, CASE WHEN pos % 2 = 0 THEN 'a' ELSE 'b' END AS side, pos // 2 AS side_pos FROM n
""")
def alternating_split(spark, sf_dir):
    """One list dealt out to two."""
    return W.alternating(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"])


@query("""
WITH o AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS p FROM part),
n AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name DESC, p_partkey) AS p FROM part)
SELECT n.p_brand, n.p_partkey, p_name, o.p_partkey AS new_value FROM n JOIN o ON n.p_brand = o.p_brand AND n.p = o.p WHERE n.p_partkey <> o.p_partkey
""")
def row_reorder(spark, sf_dir):
    """Sequence values dealt anew after a move; changed rows only."""
    return W.reordered(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], "p_partkey", [F.col("p_name").desc(), F.col("p_partkey")])


@query("""
WITH p AS (SELECT event_type, epoch_us(ts) // 3600000000 - 473352 AS bucket, epoch_us(ts) AS x, event_id, CASE WHEN value > 60 THEN NULL ELSE value END AS y FROM events)
SELECT event_type, bucket, arg_min(y, x) FILTER (WHERE y IS NOT NULL) AS first_y, min(y) AS min_y, max(y) AS max_y, arg_max(y, x) FILTER (WHERE y IS NOT NULL) AS last_y, count(y) = 0 AS gap, count(*) AS n
FROM p GROUP BY event_type, bucket
""")
def downsample_m4(spark, sf_dir):
    """First, least, greatest and last value an hour."""
    us = epoch_micros(F.col("ts"))
    e = table(spark, sf_dir, "events").select("event_type", us.alias("x"), "event_id", F.when(F.col("value") <= 60, F.col("value")).alias("y"))
    return W.downsampled(e, ["event_type"], "x", "y", "event_id", 473352 * 3_600_000_000, 3_600_000_000)
