"""Queries of series: totals, shares, ranges, slices, time units and scales."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lattica.functions.dates import epoch_micros, strftime
from lattica.functions.numbers import summed
from lattica.operators import aggregates as A
from lattica.operators import timescale as T
from lattica.sources import sinks
from lattica.sources.listing import parsed_series, series_points
from lattica.sources.tables import table

from .base import query

#: Decimals that hold the amounts and values of these tables, which have two.
CENTS = 4


@query("""
SELECT l_returnflag, l_linenumber, CAST(sum(CAST(l_quantity AS DECIMAL(20, 4))) AS DOUBLE) AS total FROM lineitem GROUP BY ALL
""")
def stack_totals(spark, sf_dir):
    """Totals by index across series."""
    return A.totals_by(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], "l_quantity", digits=CENTS)


@query("""
WITH t AS (SELECT l_returnflag, l_linenumber, CAST(sum(CAST(l_quantity AS DECIMAL(20, 4))) AS DOUBLE) AS total FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linenumber, total, CASE WHEN sum(total) OVER (PARTITION BY l_linenumber) = 0 THEN 0 ELSE 100.0::DOUBLE * total / CAST(sum(CAST(total AS DECIMAL(20, 4))) OVER (PARTITION BY l_linenumber) AS DOUBLE) END AS percent
FROM t
""")
def percent_of_total(spark, sf_dir):
    """Percentages of the index total."""
    t = A.totals_by(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], "l_quantity", digits=CENTS)
    return A.percent_of(t, ["l_linenumber"], "total", digits=CENTS)


@query("""
SELECT event_type, coalesce(CAST(sum(CAST(value AS DECIMAL(20, 4))) FILTER (WHERE ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10') AS DOUBLE), 0) AS total FROM events GROUP BY event_type
""")
def series_sum_exclusive_range(spark, sf_dir):
    """Sums strictly between two x."""
    a, b = (F.to_timestamp_ntz(F.lit(x)) for x in ("2024-01-05 00:00:00", "2024-01-10 00:00:00"))
    return A.sum_within(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", a, b, digits=CENTS)


@query("""
SELECT event_type, coalesce(min(value - 50) FILTER (WHERE value - 50 > 0), 1) AS log_min, coalesce(max(value - 50) FILTER (WHERE value - 50 > 0), 10) AS log_max, min(value - 50) AS y_min, max(value - 50) AS y_max
FROM events GROUP BY event_type
""")
def log_minmax(spark, sf_dir):
    """Positive ranges with defaults, and plain ranges."""
    e = table(spark, sf_dir, "events").withColumn("y", F.col("value") - 50)
    return A.log_range(e, ["event_type"], "y").join(e.groupBy("event_type").agg(F.min("y").alias("y_min"), F.max("y").alias("y_max")), "event_type")


@query("""
WITH d AS (SELECT user_id, epoch_us(ts) / 1e6 AS x, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events)
SELECT user_id, coalesce(min(d) FILTER (WHERE d > 0), 0.5) AS min_gap FROM d GROUP BY user_id
""")
def min_gap(spark, sf_dir):
    """The least positive gap in x."""
    e = table(spark, sf_dir, "events").select("user_id", (epoch_micros(F.col("ts")) / 1e6).alias("x"))
    return A.least_gap(e, ["user_id"], "x")


_CANDLES = "SELECT event_type, CAST(ts AS DATE) AS day, arg_min(value, ts) AS o, max(value) AS h, min(value) AS l, arg_max(value, ts) AS c FROM events GROUP BY ALL"


def _candles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.min_by("value", "ts").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", "ts").alias("c"))


@query(_CANDLES)
def candles(spark, sf_dir):
    """Open, high, low and close of a day, the form that candle series come in."""
    return _candles(spark, sf_dir).select("event_type", "day", "o", "h", "l", "c")


@query(f"SELECT event_type, min(l) AS y_min, max(h) AS y_max FROM ({_CANDLES}) GROUP BY event_type")
def candle_range(spark, sf_dir):
    """The y-range of candles."""
    return A.ohlc_range(_candles(spark, sf_dir), ["event_type"])


@query("""
WITH s AS (SELECT c_nationkey, c_mktsegment, CAST(sum(CAST(c_acctbal - 4500 AS DECIMAL(20, 4))) AS DOUBLE) AS y FROM customer GROUP BY ALL),
t AS (SELECT c_nationkey, coalesce(CAST(sum(CAST(y AS DECIMAL(20, 4))) FILTER (WHERE y > 0) AS DOUBLE), 0) AS p, coalesce(CAST(sum(CAST(y AS DECIMAL(20, 4))) FILTER (WHERE y < 0) AS DOUBLE), 0) AS n FROM s GROUP BY 1)
SELECT max(p) AS max_stack, min(n) AS min_stack FROM t
""")
def stacked_extremes(spark, sf_dir):
    """Greatest positive and least negative stack."""
    s = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(summed(F.col("c_acctbal") - 4500, CENTS).alias("y"))
    return A.stacked_extremes(s, ["c_nationkey"], "y", digits=CENTS)


def _window(spark, sf_dir, parts, first, last):
    """The events with their time in microseconds, and the ends of a share of its span."""
    e = table(spark, sf_dir, "events").withColumn("us", epoch_micros(F.col("ts")))
    end = lambda n: e.agg(F.min("us") + F.expr(f"(max(us) - min(us)) * {n} div {parts}")).scalar()
    return e, end(first), end(last)


@query("""
WITH w AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) - min(epoch_us(ts)) AS d FROM events), r AS (
  SELECT event_type, min(value) FILTER (WHERE epoch_us(ts) BETWEEN w.a + d // 4 AND w.a + d * 3 // 4) AS a, max(value) FILTER (WHERE epoch_us(ts) BETWEEN w.a + d // 4 AND w.a + d * 3 // 4) AS b FROM events, w GROUP BY 1)
SELECT event_type, round(CASE WHEN a < 0 THEN a * 1.1 ELSE a * 0.9 END, 6) AS y_min, round(CASE WHEN b < 0 THEN b * 0.9 ELSE b * 1.1 END, 6) AS y_max FROM r
""")
def padded_y_range(spark, sf_dir):
    """The range of y in the middle half of x, padded."""
    e, low, high = _window(spark, sf_dir, 4, 1, 3)
    out = A.padded_range(e, ["event_type"], "us", "value", low, high)
    return out.select("event_type", F.round("y_min", 6).alias("y_min"), F.round("y_max", 6).alias("y_max"))


@query("""
WITH v AS (SELECT p_type, p_brand, CAST(count(*) AS DOUBLE) AS v FROM part GROUP BY ALL), t AS (SELECT *, sum(v) OVER (PARTITION BY p_type) AS t FROM v),
s AS (SELECT *, v / t <= 0.04 AS small FROM t), f AS (SELECT *, count(*) FILTER (WHERE small) OVER (PARTITION BY p_type) AS few FROM s),
g AS (SELECT p_type, CASE WHEN small AND few >= 2 THEN 'Other' ELSE p_brand END AS label, sum(v) AS value, max(t) AS t FROM f GROUP BY ALL)
SELECT p_type, label, value, value / t * 100 AS percent, value / t * 360 AS angle FROM g
""")
def combine_small_slices(spark, sf_dir):
    """Small slices as one, if there are two or more."""
    v = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").cast("double").alias("v"))
    return A.combined_slices(v, ["p_type"], "p_brand", "v", 0.04)


@query("""
WITH v AS (SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(20, 4))) AS DOUBLE) AS v FROM customer GROUP BY 1)
SELECT c_mktsegment, v / CAST(sum(CAST(v AS DECIMAL(20, 4))) OVER () AS DOUBLE) * 360 AS angle, v / CAST(sum(CAST(v AS DECIMAL(20, 4))) OVER () AS DOUBLE) * 480000 AS area, v / max(v) OVER () AS radius, 360.0::DOUBLE / count(*) OVER () AS polar_angle,
       greatest(0, least(v / 1e5, 100))::DOUBLE AS radial
FROM v
""")
def pie_and_treemap(spark, sf_dir):
    """Pie angles, treemap areas, polar and radial values."""
    v = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(summed(F.col("c_acctbal"), CENTS).alias("v"))
    rows = v.withColumn("t", v.agg(summed(F.col("v"), CENTS)).scalar()).withColumn("m", v.agg(F.max("v")).scalar()).withColumn("n", v.agg(F.count("*")).scalar())
    share = F.col("v") / F.col("t")
    return rows.select("c_mktsegment", (share * 360).alias("angle"), (share * 480000).alias("area"), (F.col("v") / F.col("m")).alias("radius"), (F.lit(360.0) / F.col("n")).alias("polar_angle"), F.greatest(F.lit(0.0), F.least(F.col("v") / 1e5, F.lit(100.0))).alias("radial"))


@query("""
WITH v AS (SELECT s_suppkey, CASE WHEN s_acctbal < 0 AND s_suppkey % 2 = 0 THEN -1 ELSE s_nationkey % 5 END AS pie, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal - 500 END AS v FROM supplier),
t AS (SELECT *, greatest(coalesce(v, 0), 0) AS p, CAST(sum(CAST(greatest(coalesce(v, 0), 0) AS DECIMAL(28, 4))) OVER (PARTITION BY pie) AS DOUBLE) AS total, greatest(max(v) OVER (PARTITION BY pie), 0) AS most, count(*) OVER (PARTITION BY pie) AS n FROM v)
SELECT s_suppkey, CASE WHEN total = 0 THEN 0::DOUBLE ELSE CAST(CAST(p AS DECIMAL(28, 4)) AS DOUBLE) / total * 360 END AS angle, 360.0::DOUBLE / n AS polar_angle, v / nullif(most, 0) AS radius FROM t
""")
def pie_angles(spark, sf_dir):
    """Angles of pies with negative values and of one without any positive value."""
    pie = F.when((F.col("s_acctbal") < 0) & (F.col("s_suppkey") % 2 == 0), F.lit(-1)).otherwise(F.col("s_nationkey") % 5)
    v = table(spark, sf_dir, "supplier").select("s_suppkey", pie.alias("pie"), F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal") - 500).alias("v"))
    return A.pie_angles(v, ["pie"], "v", digits=CENTS).select("s_suppkey", "angle", "polar_angle", "radius")


@query("SELECT event_type, n FROM (SELECT event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1) ORDER BY n DESC, f LIMIT 1")
def longest_series(spark, sf_dir):
    """The series with the most points."""
    return A.longest(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("""
WITH s AS (SELECT event_type, count(*) AS n, min(event_id) AS first_x, count(y) = 0 AS all_null, min(y) = max(y) AS all_equal FROM (
  SELECT event_type, event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 1.0 ELSE value END AS y FROM events) GROUP BY 1)
SELECT *, (SELECT count(DISTINCT first_x) FROM s) <= 1 AS shared_first_x FROM s
""")
def series_facts(spark, sf_dir):
    """All null, all equal, first x and whether all series share it."""
    y = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_type") == "view", 1.0).otherwise(F.col("value"))
    return A.series_facts(table(spark, sf_dir, "events").withColumn("y", y), ["event_type"], "event_id", "y")


@query("""
SELECT l_linenumber, l_returnflag, CASE WHEN l_returnflag = 'N' THEN 0.0::DOUBLE ELSE CAST(sum(CAST(l_quantity AS DECIMAL(20, 4))) AS DOUBLE) END AS total FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_linenumber, l_returnflag
""")
def hidden_series(spark, sf_dir):
    """Hidden series left out, or zero where bars are stacked."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'")
    return A.totals_by(li.withColumn("v", F.when(F.col("l_returnflag") == "N", F.lit(0.0)).otherwise(F.col("l_quantity"))), ["l_linenumber", "l_returnflag"], "v", digits=CENTS)


@query("""
SELECT user_id, event_type, idx, CAST(10 + idx * 0.5 AS DOUBLE) AS x, y FROM (SELECT user_id, event_type, unnest(ys) AS y, generate_subscripts(ys, 1) - 1 AS idx FROM (SELECT user_id, event_type, list(value ORDER BY ts) AS ys FROM events GROUP BY user_id, event_type))
""")
def flat_points(spark, sf_dir):
    """Points from one-dimensional arrays by start and step."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "value"))), lambda p: p["value"]).alias("ys"))
    return series_points(e, "ys", 10, 0.5).withColumn("idx", F.col("idx").cast("long"))


@query("""
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS INTEGER) AS pos,
       CASE user_id % 3 WHEN 0 THEN CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END WHEN 1 THEN event_id ELSE 5 + (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1) * 0.5 END::DOUBLE AS x,
       CASE WHEN user_id % 3 = 0 AND event_id % 7 = 0 THEN event_type END AS label, CASE WHEN value <= 90 THEN value END AS y FROM events
""")
def mixed_series(spark, sf_dir):
    """Series as JSON in three forms, objects, pairs and values, parsed to one table of points."""
    y = F.when(F.col("value") <= 90, F.col("value"))
    said = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('"'), y.cast("string"), F.lit('px"'))).otherwise(y.cast("string"))
    said = F.coalesce(said, F.lit("null"))
    last = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("[0, "), said, F.lit("]"))).otherwise(said)
    x = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.col("event_id").cast("string"))
    item = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit('{"x": '), x, F.lit(', "y": '), last, F.lit("}"))).when(F.col("user_id") % 3 == 1, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(", "), said, F.lit("]"))).otherwise(said)
    e = table(spark, sf_dir, "events").select("user_id", "ts", item.alias("item"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("ts", "item"))), lambda p: p["item"])
    series = e.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")).alias("data"))
    return parsed_series(series, "data", 5, 0.5)


_SPANS = """
WITH e AS (SELECT 'events' AS src, event_id % 12 AS k, event_id // pow(2, event_id % 12)::BIGINT AS g, ts AS t FROM events UNION ALL SELECT 'orders', o_orderkey % 12, o_orderkey // pow(2, o_orderkey % 12)::BIGINT, o_orderdate::TIMESTAMP FROM orders),
r AS (SELECT src, k, g, min(t) AS a, max(t) AS b, (epoch_us(max(t)) - epoch_us(min(t))) / 1e6 AS span FROM e GROUP BY ALL)
"""


def _spans(spark, sf_dir):
    """Groups of events and of orders with spans from nothing to years: (src, k, g, a, b, span)."""

    def one(name, rid, at):
        k = F.col(rid) % 12
        return table(spark, sf_dir, name).select(F.lit(name).alias("src"), k.alias("k"), F.floor(F.col(rid) / F.pow(F.lit(2.0), k)).cast("long").alias("g"), F.col(at).cast("timestamp_ntz").alias("t"))

    r = one("events", "event_id", "ts").union(one("orders", "o_orderkey", "o_orderdate")).groupBy("src", "k", "g").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return r.withColumn("span", (epoch_micros(F.col("b")) - epoch_micros(F.col("a"))) / 1e6)


_UNIT = """CASE WHEN s > 5 * 365 * 86400 THEN 'years' WHEN s > 800 * 86400 THEN 'half_year' WHEN s > 180 * 86400 THEN 'months' WHEN s > 90 * 86400 THEN 'months_fortnight' WHEN s > 60 * 86400 THEN 'months_days'
 WHEN s > 30 * 86400 THEN 'week_days' WHEN s > 2 * 86400 THEN 'days' WHEN s > 2.4 * 3600 THEN 'hours' WHEN s > 900 THEN 'minutes_fives' WHEN s > 300 THEN 'minutes' WHEN s > 60 THEN 'seconds_tens' WHEN s > 20 THEN 'seconds_fives' ELSE 'seconds' END"""


@query(f"""
WITH g AS (SELECT event_id // pow(2, event_id % 12)::BIGINT AS g, event_id % 12 AS k, ts FROM events), r AS (SELECT k, g, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS s, count(*) AS n FROM g GROUP BY ALL)
SELECT k, g, s AS span, {_UNIT} AS unit FROM r
""")
def time_unit_choice(spark, sf_dir):
    """The time unit for a span (B1)."""
    us = epoch_micros(F.col("ts"))
    k = F.col("event_id") % 12
    e = table(spark, sf_dir, "events").select(k.alias("k"), F.floor(F.col("event_id") / F.pow(F.lit(2.0), k)).cast("long").alias("g"), us.alias("us"))
    r = e.groupBy("k", "g").agg(((F.max("us") - F.min("us")) / 1e6).alias("span"))
    return r.withColumn("unit", T.unit_of(F.col("span")))


@query("""
SELECT event_type, date_trunc('day', ts) AS at, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(20, 4))) AS DOUBLE) AS total FROM events GROUP BY ALL
""")
def bucket_by_unit(spark, sf_dir):
    """Buckets of the unit that the data's span asks for (B1): days for this month of events."""
    e = table(spark, sf_dir, "events")
    us = epoch_micros(F.col("ts"))
    unit = e.agg(T.unit_of((F.max(us) - F.min(us)) / 1e6)).scalar()
    at = T.truncated(F.col("ts"), F.col("unit"))
    return e.withColumn("unit", unit).groupBy("event_type", at.alias("at")).agg(F.count("*").alias("n"), summed(F.col("value"), CENTS).alias("total"))


@query("""
WITH r AS (SELECT o_orderpriority, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
SELECT o_orderpriority, unnest(generate_series(date_trunc('quarter', a), b, INTERVAL 3 MONTH)) AS tick FROM r
""")
def time_ticks(spark, sf_dir):
    """Quarterly ticks over each range (B2)."""
    r = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return T.calendar_ticks(r, "a", "b", "1 quarter")


@query("""
WITH r AS (SELECT event_type, min(value) AS a, max(value) AS b FROM events GROUP BY 1), p AS (SELECT *, pow(10.0::DOUBLE, floor(log10((b - a) / 10.0::DOUBLE))) AS p FROM r),
s AS (SELECT *, CASE WHEN round((b - a) / 10.0::DOUBLE / p, 9) <= 1 THEN p WHEN round((b - a) / 10.0::DOUBLE / p, 9) <= 2 THEN p * 2 WHEN round((b - a) / 10.0::DOUBLE / p, 9) <= 5 THEN p * 5 ELSE p * 10 END AS step FROM p)
SELECT event_type, step, floor(a / step) * step AS nice_min, ceil(b / step) * step AS nice_max, CAST(round((ceil(b / step) * step - floor(a / step) * step) / step) + 1 AS BIGINT) AS n_ticks FROM s
""")
def nice_scale(spark, sf_dir):
    """Steps and ends that read well."""
    r = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return T.nice_scale(r, "a", "b").select("event_type", "step", "nice_min", "nice_max", "n_ticks")


@query("""
WITH r AS (SELECT p_type, min(p_retailprice) AS a, max(p_retailprice) AS b FROM part GROUP BY 1)
SELECT p_type, i, a + (b - a) * i / 8.0::DOUBLE AS tick FROM (SELECT *, unnest(range(0, 9)) AS i FROM r)
""")
def linear_ticks(spark, sf_dir):
    """Evenly spaced ticks."""
    r = table(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("b"))
    return T.linear_ticks(r, "a", "b", 8)


@query("""
WITH r AS (SELECT event_type, round(ln(min(value)) / ln(10.0::DOUBLE), 9) AS a, round(ln(max(value)) / ln(10.0::DOUBLE), 9) AS b FROM events GROUP BY 1)
SELECT event_type, power, pow(10.0::DOUBLE, power) AS tick FROM (SELECT event_type, unnest(range(CAST(floor(a) AS BIGINT), CAST(ceil(b) AS BIGINT) + 1)) AS power FROM r)
""")
def log_ticks(spark, sf_dir):
    """Powers of ten over a range."""
    r = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return T.log_ticks(r, "a", "b")


@query("""
WITH r AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), s AS (SELECT *, CASE WHEN hi > lo THEN hi - lo ELSE greatest(abs(hi), 1.0) END AS span FROM r),
u AS (SELECT *, pow(10.0::DOUBLE, floor(log10(span))) / 10 AS unit FROM s), l AS (SELECT *, floor((lo - span * 0.1::DOUBLE) / unit) * unit AS a, ceil((hi + span * 0.1::DOUBLE) / unit) * unit AS b FROM u)
SELECT event_type, round(CASE WHEN lo >= 0 AND a < 0 THEN 0.0 ELSE a END, 6) AS low, round(b, 6) AS high, pow(10.0::DOUBLE, floor(round(ln(lo) / ln(10.0::DOUBLE), 9))) AS log_low, pow(10.0::DOUBLE, ceil(round(ln(hi) / ln(10.0::DOUBLE), 9))) AS log_high FROM l
""")
def padded_limits(spark, sf_dir):
    """Padded ranges with a soft lower limit, and ranges in powers."""
    r = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    a, b = T.padded_limits(F.col("lo"), F.col("hi"), soft_low=0.0)
    p, q = T.log_limits(F.col("lo"), F.col("hi"))
    return r.select("event_type", F.round(a, 6).alias("low"), F.round(b, 6).alias("high"), p.alias("log_low"), q.alias("log_high"))


@query("""
WITH r AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), s AS (SELECT *, CASE WHEN hi > lo THEN hi - lo ELSE greatest(abs(hi), 1.0) END AS span FROM r),
u AS (SELECT *, pow(10.0::DOUBLE, floor(log10(span))) / 10 AS unit FROM s)
SELECT user_id, round(greatest(floor((lo - span * 0.1::DOUBLE) / unit) * unit, -2.0::DOUBLE), 6) AS low, round(least(ceil((hi + span * 0.1::DOUBLE) / unit) * unit, 100.0::DOUBLE), 6) AS high FROM u
""")
def hard_limits(spark, sf_dir):
    """Padded ranges that never go beyond hard limits."""
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    a, b = T.padded_limits(F.col("lo"), F.col("hi"), hard_low=-2.0, hard_high=100.0)
    return r.select("user_id", F.round(a, 6).alias("low"), F.round(b, 6).alias("high"))


@query("""
WITH w AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) - min(epoch_us(ts)) AS d FROM events)
SELECT CASE WHEN event_type IN ('click', 'view') THEN 'left' ELSE 'right' END AS scale, min(value) FILTER (WHERE event_type <> 'error' AND epoch_us(ts) BETWEEN a + d // 10 AND a + d * 8 // 10) AS y_min,
       max(value) FILTER (WHERE event_type <> 'error' AND epoch_us(ts) BETWEEN a + d // 10 AND a + d * 8 // 10) AS y_max FROM events, w GROUP BY 1
""")
def scale_extents(spark, sf_dir):
    """Extents of scales over visible series in a window."""
    e, low, high = _window(spark, sf_dir, 10, 1, 8)
    e = e.withColumn("scale", F.when(F.col("event_type").isin("click", "view"), "left").otherwise("right"))
    return T.scale_extents(e, "scale", "us", "value", low, high, F.col("event_type") != "error")


@query("""
WITH s AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'left' ELSE 'right' END AS scale, CAST(ts AS DATE) AS day, min(value) AS a, max(value) AS b FROM events GROUP BY ALL)
SELECT day, scale, a AS y_min, b AS y_max FROM s UNION ALL SELECT day, 'percent', a * 100, b * 100 FROM s WHERE scale = 'left' UNION ALL SELECT day, 'padded', a * 100 - 10, b * 100 + 10 FROM s WHERE scale = 'left'
UNION ALL SELECT day, 'mirror', -b, -a FROM s WHERE scale = 'right'
""")
def derived_scales(spark, sf_dir):
    """Scales taken from others, two levels deep, for each day."""
    scale = F.when(F.col("event_type").isin("click", "view"), "left").otherwise("right")
    own = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), scale.alias("scale")).agg(F.min("value").alias("y_min"), F.max("value").alias("y_max"))
    rules = {"padded": ("percent", lambda a, b: (a - 10, b + 10)), "percent": ("left", lambda a, b: (a * 100, b * 100)), "mirror": ("right", lambda a, b: (-b, -a)), "lost": ("absent", lambda a, b: (a, b))}
    return T.derived_scales(own, rules)


@query(f"""{_SPANS}, w AS (SELECT unnest([1, 10, 100]) AS p), c AS (
  SELECT CAST(m * p AS BIGINT) AS ms FROM w, (SELECT unnest([1, 2, 2.5, 5]) AS m) WHERE m * p % 1 = 0
  UNION ALL SELECT unnest([1, 5, 10, 15, 30]) * 1000 UNION ALL SELECT unnest([1, 5, 10, 15, 30]) * 60000 UNION ALL SELECT unnest([1, 2, 3, 4, 6, 8, 12]) * 3600000
  UNION ALL SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15]) * 86400000 UNION ALL SELECT unnest([1, 2, 3, 4, 6])::BIGINT * 2592000000 UNION ALL SELECT unnest([1, 2, 5, 10, 25, 50, 100])::BIGINT * 31536000000)
SELECT src, k, g, (SELECT min(ms) FROM c WHERE ms * 10::DOUBLE >= span * 1000) AS ms FROM r
""")
def tick_increments(spark, sf_dir):
    """The least tick size of the catalogue, 1 ms to 100 years, that gives at most ten steps over a span."""
    return _spans(spark, sf_dir).select("src", "k", "g", T.least_increment(F.col("span"), 10).alias("ms"))


@query("""
WITH t AS (SELECT c_mktsegment AS label, CAST(sum(CAST(c_acctbal AS DECIMAL(20, 4))) AS DOUBLE) AS total, min(c_custkey) AS "at" FROM customer GROUP BY 1)
SELECT 'ascending' AS how, label, total, row_number() OVER (ORDER BY label) - 1 AS pos FROM t UNION ALL SELECT 'descending', label, total, row_number() OVER (ORDER BY label DESC) - 1 FROM t
UNION ALL SELECT 'reverse', label, total, row_number() OVER (ORDER BY "at" DESC) - 1 FROM t UNION ALL SELECT 'custom', label, total, row_number() OVER (ORDER BY length(label), total DESC) - 1 FROM t
""")
def legend_order(spark, sf_dir):
    """Legend entries in ascending, descending, reversed and a custom order."""
    t = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(summed(F.col("c_acctbal"), CENTS).alias("total"), F.min("c_custkey").alias("at"))
    ways = [(how, None) for how in ("ascending", "descending", "reverse")] + [("custom", [F.length("label"), F.col("total").desc()])]
    return reduce(lambda a, b: a.union(b), [A.legend_positions(t, "label", "at", how, custom).select(F.lit(how).alias("how"), "label", "total", "pos") for how, custom in ways])


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT CAST(floor(value / 100) * 100 AS BIGINT))), ',') AS thresholds FROM events GROUP BY user_id")
def threshold_list(spark, sf_dir):
    """Sorted lists of thresholds."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set((F.floor(F.col("value") / 100) * 100).cast("long"))), ",").alias("thresholds"))


@query("""
SELECT day, replace(label, ',', '') AS label, click, view, error FROM (
  SELECT CAST(ts AS DATE) AS day, strftime(ts, '%d, %b') AS label, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY ALL)
""")
def chart_csv_rows(spark, sf_dir):
    """Wide rows of a chart export, delimiters taken from labels."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), strftime(F.col("ts"), "%d, %b").alias("label"), "event_type", F.lit(1).alias("label_"))
    wide = e.groupBy("day", "label").pivot("event_type", ["click", "view", "error"]).agg(F.count("label_"))
    return wide.select("day", F.replace("label", F.lit(","), F.lit("")).alias("label"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("click", "view", "error")])


@query("""
SELECT event_type, CAST(ts AS DATE) AS day, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS "close",
       round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, min(event_id) AS range_start, max(event_id) AS range_end
FROM events GROUP BY ALL
""")
def chart_csv_typed(spark, sf_dir):
    """Candle, box and range series of a chart export, a column for each of their parts."""
    quarters = F.transform(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))), lambda q: F.round(q, 6))
    candle = F.array(F.min_by("value", "ts"), F.max("value"), F.min("value"), F.max_by("value", "ts"))
    series = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(candle.alias("candle"), quarters.alias("box"), F.array(F.min("event_id"), F.max("event_id")).alias("span"))
    return sinks.expanded(sinks.expanded(sinks.expanded(series, "candle", ["open", "high", "low", "close"]), "box", ["q1", "median", "q3"]), "span", ["range_start", "range_end"])


@query("""
WITH s AS (SELECT s_nationkey, s_suppkey % 4 AS kind, s_acctbal AS y, s_acctbal - 100 AS lo, s_acctbal + 50 AS hi, s_acctbal - 170 AS o, s_acctbal + 90 AS c, CASE WHEN s_suppkey % 7 = 0 THEN 12000.0 END AS goal FROM supplier)
SELECT s_nationkey, min(least(CASE kind WHEN 0 THEN y WHEN 3 THEN o ELSE lo END, goal)) AS y_min, max(greatest(CASE kind WHEN 0 THEN y WHEN 3 THEN c ELSE hi END, goal)) AS y_max FROM s GROUP BY 1
""")
def typed_y_range(spark, sf_dir):
    """The y-range of line, range, candle and box series with goals."""
    kind = F.element_at(F.array(*map(F.lit, ("line", "range", "candle", "box"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    s = table(spark, sf_dir, "supplier").select("s_nationkey", kind.alias("kind"), F.col("s_acctbal").alias("y"), (F.col("s_acctbal") - 100).alias("lo"), (F.col("s_acctbal") + 50).alias("hi"), (F.col("s_acctbal") - 170).alias("o"), (F.col("s_acctbal") + 90).alias("c"), F.when(F.col("s_suppkey") % 7 == 0, F.array(F.lit(12000.0))).alias("goals"))
    return A.y_range(s, ["s_nationkey"], "kind", "y", {"range": ("lo", "hi"), "candle": ("lo", "hi"), "box": ("o", "c")}, "goals")


@query(f"""
SELECT strftime(day, '%Y-%m-%d') AS category, event_type || ' open' AS "column", o AS value FROM ({_CANDLES}) UNION ALL SELECT strftime(day, '%Y-%m-%d'), event_type || ' high', h FROM ({_CANDLES})
UNION ALL SELECT strftime(day, '%Y-%m-%d'), event_type || ' low', l FROM ({_CANDLES}) UNION ALL SELECT strftime(day, '%Y-%m-%d'), event_type || ' close', c FROM ({_CANDLES})
""")
def candle_csv_cells(spark, sf_dir):
    """Cells of an export of candles, a column for each of their values."""
    parts = F.array(*[F.struct(F.concat("event_type", F.lit(f" {name}")).alias("column"), F.col(c).alias("value")) for name, c in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"))])
    return _candles(spark, sf_dir).select(F.date_format("day", "yyyy-MM-dd").alias("category"), F.inline(parts))


@query("""
WITH p AS (SELECT event_id, ts, ['years', 'half_year', 'months', 'months_fortnight', 'months_days', 'week_days', 'days', 'hours', 'minutes_fives', 'minutes', 'seconds_tens', 'seconds_fives', 'seconds'][CAST(event_id % 13 + 1 AS INTEGER)] AS unit FROM events)
SELECT unit, CASE unit WHEN 'years' THEN date_trunc('year', ts) WHEN 'half_year' THEN date_trunc('year', ts) + to_months(CAST((month(ts) - 1) // 6 * 6 AS INTEGER)) WHEN 'months' THEN date_trunc('month', ts)
  WHEN 'months_fortnight' THEN date_trunc('month', ts) + CASE WHEN day(ts) > 14 THEN INTERVAL 14 DAY ELSE INTERVAL 0 DAY END WHEN 'hours' THEN date_trunc('hour', ts)
  WHEN 'minutes_fives' THEN time_bucket(INTERVAL 5 MINUTE, ts) WHEN 'minutes' THEN date_trunc('minute', ts) WHEN 'seconds_tens' THEN time_bucket(INTERVAL 10 SECOND, ts)
  WHEN 'seconds_fives' THEN time_bucket(INTERVAL 5 SECOND, ts) WHEN 'seconds' THEN date_trunc('second', ts) ELSE date_trunc('day', ts) END AS at, count(*) AS n
FROM p GROUP BY ALL
""")
def bucket_by_each_unit(spark, sf_dir):
    """Buckets of every unit, fortnights and fives among them (B1)."""
    names = [n for n, _ in T.UNITS] + ["seconds"]
    e = table(spark, sf_dir, "events").withColumn("unit", F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 13 + 1).cast("int")))
    return e.groupBy("unit", T.truncated(F.col("ts"), F.col("unit")).alias("at")).agg(F.count("*").alias("n"))


_STEP_SECONDS = "[1, 2, 5, 10, 30, 60, 120, 300, 600, 1800, 3600, 7200, 14400, 28800, 43200, 86400, 172800, 259200, 648000, 1296000, 2592000, 5184000, 7776000, 15552000, 31556952]"


@query(f"""
WITH g AS (SELECT event_id % 12 AS k, event_id // pow(2, event_id % 12)::BIGINT AS g, epoch_us(ts) AS us FROM events), r AS (SELECT k, g, (max(us) - min(us)) / 1e6 AS span FROM g GROUP BY ALL),
s AS (SELECT unnest({_STEP_SECONDS}) AS len, generate_subscripts({_STEP_SECONDS}, 1) AS i), n AS (SELECT i, len, (len + lead(len) OVER (ORDER BY i)) / 2 AS until FROM s),
u AS (SELECT i, unnest([1, 2, 5, 10, 30, 1, 2, 5, 10, 30, 1, 2, 4, 8, 12, 1, 2, 3, 0.25, 0.5, 1, 2, 3, 6, 1])::DOUBLE AS size FROM (SELECT 0 AS i)), z AS (SELECT row_number() OVER () AS i, size FROM u)
SELECT k, g, z.size, CASE WHEN z.i <= 5 THEN 'second' WHEN z.i <= 10 THEN 'minute' WHEN z.i <= 15 THEN 'hour' WHEN z.i <= 18 THEN 'day' WHEN z.i <= 24 THEN 'month' ELSE 'year' END AS unit
FROM r JOIN z ON z.i = coalesce((SELECT min(i) FROM n WHERE span / 8.0::DOUBLE < until), 25)
""")
def time_step_choice(spark, sf_dir):
    """Size and unit of the steps for about eight ticks over a span (B2)."""
    k = F.col("event_id") % 12
    us = epoch_micros(F.col("ts"))
    e = table(spark, sf_dir, "events").select(k.alias("k"), F.floor(F.col("event_id") / F.pow(F.lit(2.0), k)).cast("long").alias("g"), us.alias("us"))
    return e.groupBy("k", "g").agg(((F.max("us") - F.min("us")) / 1e6).alias("span")).withColumn("_s", T.chosen_step(F.col("span"), 8)).select("k", "g", "_s.size", "_s.unit")


_STEP_SIZES = "[1, 2, 5, 10, 30, 1, 2, 5, 10, 30, 1, 2, 4, 8, 12, 1, 2, 3, 0.25, 0.5, 1, 2, 3, 6, 1]::DOUBLE[]"


@query(f"""{_SPANS}, s AS (SELECT unnest({_STEP_SECONDS}) AS len, generate_subscripts({_STEP_SECONDS}, 1) AS i), n AS (SELECT i, (len + lead(len) OVER (ORDER BY i)) / 2 AS until FROM s),
c AS (SELECT r.*, coalesce((SELECT min(i) FROM n WHERE span / 3.0::DOUBLE < until), 25) AS i, span / 3.0::DOUBLE / (365.2425 * 86400)::DOUBLE AS y FROM r),
p AS (SELECT *, CASE WHEN i = 25 THEN pow(10.0::DOUBLE, floor(log10(y))) END AS p FROM c),
z AS (SELECT *, CASE WHEN i < 25 THEN ({_STEP_SIZES})[i] ELSE greatest(1, CASE WHEN y / p < 1.5 THEN p WHEN y / p < 3 THEN 2 * p WHEN y / p < 7.5 THEN 5 * p ELSE 10 * p END) END AS size,
             CASE WHEN i <= 5 THEN 'second' WHEN i <= 10 THEN 'minute' WHEN i <= 15 THEN 'hour' WHEN i <= 18 THEN 'day' WHEN i <= 24 THEN 'month' ELSE 'year' END AS unit FROM p),
clock AS (SELECT *, CASE unit WHEN 'second' THEN date_trunc('minute', a) + to_seconds(floor(second(a) / size) * size) WHEN 'minute' THEN date_trunc('hour', a) + to_seconds(60 * floor(minute(a) / size) * size)
                              WHEN 'hour' THEN date_trunc('day', a) + to_seconds(3600 * floor(hour(a) / size) * size) ELSE date_trunc('day', a) END AS f,
                 to_seconds(size * CASE unit WHEN 'second' THEN 1 WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 ELSE 86400 END) AS step FROM z WHERE i <= 18),
parts AS (SELECT *, unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS m FROM z WHERE size < 1),
piece AS (SELECT *, m + to_days(CAST(floor(round(unnest(range(CAST(1 / size AS BIGINT))) * datediff('day', m, m + INTERVAL 1 MONTH) * size, 6)) AS INTEGER)) AS tick FROM parts),
whole AS (SELECT *, CASE WHEN unit = 'year' THEN make_timestamp(CAST(floor(year(a) / size) * size AS BIGINT), 1, 1, 0, 0, 0)
                         ELSE make_timestamp(year(a), CAST(1 + CASE WHEN size = 1 THEN month(a) - 1 WHEN size = 2 THEN floor(floor((month(a) - 1) / 2) * 2 / 3) * 3 ELSE floor((month(a) - 1) / size) * size END AS BIGINT), 1, 0, 0, 0) END AS f,
                 to_months(CAST(size * CASE unit WHEN 'year' THEN 12 ELSE 1 END AS INTEGER)) AS step FROM z WHERE i > 18 AND size >= 1)
SELECT src, k, g, size, unit, unnest(generate_series(f, b, step)) AS tick FROM clock UNION ALL SELECT src, k, g, size, unit, tick FROM piece WHERE tick <= b UNION ALL SELECT src, k, g, size, unit, unnest(generate_series(f, b, step)) FROM whole
""")
def time_step_ticks(spark, sf_dir):
    """The ticks of each span by the step that was chosen for it, from seconds to years, parts of months too (B2)."""
    r = _spans(spark, sf_dir).withColumn("_s", T.chosen_step(F.col("span"), 3)).select("src", "k", "g", "a", "b", "_s.size", "_s.unit")
    return T.stepped_ticks(r, "a", "b", "size", "unit").select("src", "k", "g", "size", "unit", "tick")


@query("""
WITH r AS (SELECT s_nationkey, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier GROUP BY 1), f AS (SELECT s_nationkey, lo, CASE WHEN hi <= 0 THEN greatest(lo, 10.0) ELSE hi END AS hi FROM r),
l AS (SELECT s_nationkey, ln(CASE WHEN lo <= 0 THEN least(hi, 10.0) ELSE lo END) / ln(10.0::DOUBLE) AS a, ln(hi) / ln(10.0::DOUBLE) AS b FROM f), n AS (SELECT *, CAST(floor(b - a + 0.5) AS INTEGER) AS n FROM l)
SELECT s_nationkey, i, round(pow(10.0::DOUBLE, CASE WHEN i = n THEN b ELSE a + (b - a) / n * i END), 6) AS tick FROM (SELECT *, unnest(range(n + 1)) AS i FROM n)
""")
def log_spaced_ticks(spark, sf_dir):
    """Ticks evenly spaced in the logarithm, ends exact."""
    r = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    return T.log_spaced(r, "lo", "hi").withColumn("tick", F.round("tick", 6))
