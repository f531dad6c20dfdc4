"""Queries of scalar functions: text, dates, geometry, rounding, classes and scales."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.functions import dates as D
from lattica.functions import numbers as N
from lattica.functions import text as X
from lattica.sources.tables import table

from .base import query


@query(r"""
WITH a AS (SELECT page_id, html, regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, html, regexp_replace(t, '(?s)<!--.*?-->', '', 'g') AS t FROM a),
c AS (SELECT page_id, html, regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS t FROM b),
d AS (SELECT page_id, html, replace(replace(replace(replace(replace(replace(replace(t, chr(10), ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM c)
SELECT page_id, t AS plain, length(t) AS n_chars, sha256(regexp_replace(html, '<[^>]*>', '', 'g')) AS no_tags FROM d
""")
def html_strip(spark, sf_dir):
    """Export text of HTML and tag-free text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.explode(F.array(X.plain_text(F.col("html")))).alias("plain"))  # a generator's column is worked out once
    return pages.select("page_id", "plain", F.length("plain").cast("long").alias("n_chars"), F.sha2(X.strip_tags(F.col("html")).cast("binary"), 256).alias("no_tags"))


@query(r"""
SELECT event_id, TRY_CAST(nullif(regexp_extract(value || 'px', '^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE) AS lead,
       TRY_CAST(nullif(regexp_extract(event_type, '^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE) AS none,
       regexp_replace(regexp_replace(CAST(CAST(value AS DECIMAL(38, 10)) AS VARCHAR), '(\.[0-9]*?)0+$', '\1'), '\.$', '') AS plain,
       regexp_replace(regexp_replace('0.00000000000000' || lpad(CAST(event_id AS VARCHAR), 12, '0'), '0+$', ''), '\.$', '') AS tiny, CASE WHEN event_id = 0 THEN '0' ELSE CAST(event_id AS VARCHAR) || '000000000000' END AS huge
FROM events
""")
def number_text(spark, sf_dir):
    """Numbers from text and text from numbers without exponent."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", X.leading_number(F.concat(v.cast("string"), F.lit("px"))).alias("lead"), X.leading_number(F.col("event_type")).alias("none"), X.plain_number(v).alias("plain"), X.plain_number(F.concat("event_id", F.lit("e-26")).cast("double")).alias("tiny"), X.plain_number(F.concat("event_id", F.lit("e12")).cast("double")).alias("huge"))


@query("""
SELECT event_id, strftime(ts, '%a %b %d %H:%M:%S %Y') AS spelled, strftime(ts, '%I') || lower(strftime(ts, '%p')) || ' Q' || quarter(ts) || ' w' || dayofweek(ts) AS parts,
       strftime(ts, '%Y-%m-%d') || ' ' || (CAST((hour(ts) + 11) % 12 + 1 AS VARCHAR)) || ':' || strftime(ts, '%M') || lower(strftime(ts, '%p')) AS brace,
       strftime(ts, '%d.%m.%y') || ' ' || strftime(ts, '%H:%M:%S') || '.' || lpad((millisecond(ts) % 1000)::VARCHAR, 3, '0') || ' ' || upper(strftime(ts, '%p')) AS token
FROM events
""")
def date_format_three(spark, sf_dir):
    """Dates by three kinds of patterns."""
    at = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", D.strftime(at, "%a %b %d %H:%M:%S %Y").alias("spelled"), D.strftime(at, "%I%p Q%q w%w").alias("parts"), D.template(at, "{YYYY}-{MM}-{DD} {h}:{mm}{aa}").alias("brace"), D.token_format(at, "dd.MM.yy HH:mm:ss.fff TT").alias("token"))


@query("""
SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofyear(o_orderdate) AS doy, day(last_day(o_orderdate)) AS days_in_month,
       CASE WHEN (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 THEN 366 ELSE 365 END AS days_in_year,
       dayofweek(o_orderdate) AS weekday
FROM orders
""")
def date_parts(spark, sf_dir):
    """Parts of dates."""
    at = F.col("o_orderdate")
    parts = {"y": F.year(at), "m": F.month(at), "d": F.dayofmonth(at), "doy": F.dayofyear(at), "days_in_month": F.dayofmonth(F.last_day(at)), "days_in_year": D.days_in_year(at).cast("int"), "weekday": F.dayofweek(at) - 1}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.cast("int" if n == "days_in_year" else "long").alias(n) for n, c in parts.items()])


@query("""
SELECT event_id, make_timestamp(event_id * 86400 * 1000000) AS seconds, make_timestamp(event_id * 1000) AS millis, make_timestamp(event_id) AS micros,
       CAST(275760 AS INTEGER) AS clamped_year, ts + INTERVAL 2 HOUR AS shifted
FROM events
""")
def epoch_units(spark, sf_dir):
    """Timestamps from epochs of three units, clamped, and by zone."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", D.from_epoch(n * 86400, "seconds").alias("seconds"), D.from_epoch(n, "milliseconds").alias("millis"), D.from_epoch(n, "microseconds").alias("micros"),
        F.year(D.from_epoch(F.lit(8_640_000_000_000_001), "milliseconds")).alias("clamped_year"), (F.col("ts") + F.expr("interval 2 hours")).alias("shifted"),
    )


_ZONED = """
WITH e AS (SELECT event_id, ts + INTERVAL 60 DAY AS t FROM events), z AS (SELECT unnest(['America/New_York', 'Europe/Berlin', 'Asia/Kathmandu']) AS zone),
l AS (SELECT event_id, zone, t, timezone(zone, timezone('UTC', t)) AS shown, (epoch_us(timezone(zone, timezone('UTC', t))) - epoch_us(t)) // 60000000 AS off FROM e, z)
"""


@query(_ZONED + """SELECT event_id, zone, shown, strftime(shown, '%Y-%m-%d %H:%M:%S ') || CASE WHEN off < 0 THEN '-' ELSE '+' END || lpad((abs(off) // 60)::VARCHAR, 2, '0') || ':' || lpad((abs(off) % 60)::VARCHAR, 2, '0') || ' K' AS text,
       epoch_us(shown) // 3600000000 - epoch_us(t) // 3600000000 AS hours FROM l""")
def zone_clocks(spark, sf_dir):
    """What clocks of three zones show, with their offsets, over weeks in which two of them are put forward."""
    zones = F.explode(F.array(*map(F.lit, ("America/New_York", "Europe/Berlin", "Asia/Kathmandu"))))
    e = table(spark, sf_dir, "events").select("event_id", D.plus(F.col("ts"), days=F.lit(60)).alias("t"), zones.alias("zone"))
    hour = lambda at: F.floor(D.epoch_micros(at) / 3_600_000_000)
    e = e.withColumn("shown", D.in_zone(F.col("t"), F.col("zone")))
    return e.select("event_id", "zone", "shown", D.token_format(F.col("t"), "yyyy-MM-dd HH:mm:ss K \\K", F.col("zone")).alias("text"), (hour(F.col("shown")) - hour(F.col("t"))).alias("hours"))


@query("""
WITH e AS (SELECT event_id, ts + INTERVAL 60 DAY AS t FROM events) SELECT event_id, timezone('UTC', timezone('Europe/Berlin', t)) AS utc FROM e WHERE NOT (t >= TIMESTAMP '2024-03-31 02:00:00' AND t < TIMESTAMP '2024-03-31 03:00:00')
""")
def clocks_to_utc(spark, sf_dir):
    """UTC from what a clock shows, but for the hour that it skips."""
    e = table(spark, sf_dir, "events").select("event_id", D.plus(F.col("ts"), days=F.lit(60)).alias("t"))
    skipped = [F.to_timestamp_ntz(F.lit(x)) for x in ("2024-03-31 02:00:00", "2024-03-31 03:00:00")]
    return e.where(~((F.col("t") >= skipped[0]) & (F.col("t") < skipped[1]))).select("event_id", D.out_of_zone(F.col("t"), "Europe/Berlin").alias("utc"))


@query("""
WITH t AS (SELECT DATE '1998-03-15' AS today), r AS (
  SELECT 'today' AS name, today AS a, today AS b FROM t UNION ALL SELECT 'yesterday', today - 1, today - 1 FROM t UNION ALL SELECT 'last 7 days', today - 6, today FROM t
  UNION ALL SELECT 'last 30 days', today - 29, today FROM t UNION ALL SELECT 'this month', date_trunc('month', today)::DATE, last_day(today) FROM t
  UNION ALL SELECT 'last month', (date_trunc('month', today) - INTERVAL 1 MONTH)::DATE, date_trunc('month', today)::DATE - 1 FROM t)
SELECT name, a AS begins, b AS ends, (SELECT count(*) FROM orders WHERE o_orderdate::DATE BETWEEN a AND b) AS n FROM r
""")
def date_presets(spark, sf_dir):
    """Orders in named date ranges."""
    today, day = F.to_date(F.lit("1998-03-15")), F.col("o_orderdate").cast("date")
    ranges = D.presets(today)
    parts = [F.struct(F.lit(n).alias("name"), a.cast("date").alias("begins"), b.cast("date").alias("ends"), F.count_if(day.between(a, b)).alias("n")) for n, (a, b) in ranges.items()]
    return table(spark, sf_dir, "orders").agg(F.array(*parts).alias("_p")).select(F.inline("_p"))


@query("""
SELECT o_orderkey, least(greatest(o_orderdate::DATE - 20, DATE '1995-01-01'), DATE '1996-12-31') AS begins, least(greatest(o_orderdate::DATE + 20, DATE '1995-01-01'), DATE '1996-12-31') AS ends FROM orders
""")
def date_range_clamped(spark, sf_dir):
    """Ranges of dates held within the earliest and latest allowed one."""
    day = F.col("o_orderdate").cast("date")
    begins, ends = D.clamped_range(F.date_sub(day, 20), F.date_add(day, 20), F.to_date(F.lit("1995-01-01")), F.to_date(F.lit("1996-12-31")))
    return table(spark, sf_dir, "orders").select("o_orderkey", begins.alias("begins"), ends.alias("ends"))


@query("""
WITH g AS (SELECT p_partkey, CAST(p_size * 97 AS BIGINT) AS w, CAST(p_size * 41 AS BIGINT) AS h FROM part)
SELECT p_partkey, w + w % 2 AS even_w, h + h % 2 AS even_h, CASE WHEN w > 1920 THEN (w - 1920) // 2 ELSE 0 END AS crop_left, CASE WHEN h > 1080 THEN (h - 1080) // 2 ELSE 0 END AS crop_top,
       least(w, 1920) AS crop_w, least(h, 1080) AS crop_h, w // 2 AS half_w, greatest(1, CAST(trunc(w * CAST(0.6 AS DOUBLE)) AS BIGINT)) AS fg_w, greatest(1, CAST(trunc(h * CAST(0.4 AS DOUBLE)) AS BIGINT)) AS fg_h,
       CAST(trunc(w * CAST(0.5 AS DOUBLE)) AS BIGINT) AS side_w, least(w, h, 1500) AS common, 1.0::DOUBLE + 0.2::DOUBLE * (h % 3) / 2.0::DOUBLE AS zoom
FROM g
""")
def frame_geometry(spark, sf_dir):
    """Even sizes, centred crops, halves, overlays, common durations, zoom."""
    g = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 97).cast("long").alias("w"), (F.col("p_size") * 41).cast("long").alias("h"))
    w, h = F.col("w"), F.col("h")
    return g.select(
        "p_partkey", N.even(w).alias("even_w"), N.even(h).alias("even_h"), N.crop_start(w, N.FRAME_W).alias("crop_left"), N.crop_start(h, N.FRAME_H).alias("crop_top"), N.crop_size(w, N.FRAME_W).alias("crop_w"), N.crop_size(h, N.FRAME_H).alias("crop_h"),
        F.expr("w div 2").alias("half_w"), N.share_of(w, 0.6, 1).alias("fg_w"), N.share_of(h, 0.4, 1).alias("fg_h"), N.share_of(w, 0.5).alias("side_w"), F.least(w, h, F.lit(1500)).cast("long").alias("common"), (F.lit(1.0) + F.lit(0.2) * F.expr("h % 3") / F.lit(2.0)).alias("zoom"),
    )


@query("""
SELECT event_id, floor(value / 2.5::DOUBLE + 0.5::DOUBLE) * 2.5::DOUBLE AS rounded, ceil(value / 2.5::DOUBLE) * 2.5::DOUBLE AS up, floor(value / 2.5::DOUBLE) * 2.5::DOUBLE AS down, least(greatest(value, 10.0), 100.0)::DOUBLE AS clamped,
       round(ln(value) / ln(10.0::DOUBLE), 6) AS lg, pow(10.0::DOUBLE, floor(round(ln(value) / ln(10.0::DOUBLE), 9))) AS power, round(ln(greatest(value, 1.0::DOUBLE)), 6) AS log_y,
       round(exp(ln(greatest(value, 1.0::DOUBLE))), 6) AS back, CASE WHEN value > 90 THEN 1e300::DOUBLE ELSE value END AS held
FROM events
""")
def rounding_and_logs(spark, sf_dir):
    """Rounding to increments, clamps, logarithms, saturation."""
    v = F.col("value")
    sat = F.coalesce(N.saturated(F.when(v > 90, F.lit(float("inf"))), 1e300), v)
    return table(spark, sf_dir, "events").select(
        "event_id", N.round_to(v, 2.5).alias("rounded"), N.ceil_to(v, 2.5).alias("up"), N.floor_to(v, 2.5).alias("down"), N.clamp(v, 10.0, 100.0).alias("clamped"),
        F.round(N.log_base(v, 10), 6).alias("lg"), N.power_below(v, 10).alias("power"), F.round(N.log_clamped(v, 1.0), 6).alias("log_y"), F.round(F.exp(N.log_clamped(v, 1.0)), 6).alias("back"), sat.alias("held"),
    )


@query("""
WITH r AS (SELECT p_brand, max(p_retailprice) - min(p_retailprice) AS span, min(p_retailprice) AS low FROM part GROUP BY p_brand)
SELECT p_brand, CASE WHEN span < 5 THEN printf('%.1f', low) ELSE printf('%.0f', round(low)) END AS label FROM r
""")
def axis_labels(spark, sf_dir):
    """Labels with one decimal for short ranges, none for others."""
    r = table(spark, sf_dir, "part").groupBy("p_brand").agg((F.max("p_retailprice") - F.min("p_retailprice")).alias("span"), F.min("p_retailprice").alias("low"))
    return r.select("p_brand", F.when(F.col("span") < 5, F.format_string("%.1f", "low")).otherwise(F.format_string("%.0f", F.round("low"))).alias("label"))


@query("""
SELECT p_partkey, CASE WHEN p_size = 25 THEN 'exact' WHEN p_size <= 10 THEN 'low' WHEN p_size >= 10 AND p_size <= 30 THEN 'mid' WHEN p_size >= 30 THEN 'high' END AS first_class,
       CASE WHEN p_size BETWEEN 20 AND 50 THEN 'c' WHEN p_size BETWEEN 10 AND 30 THEN 'b' WHEN p_size BETWEEN 1 AND 20 THEN 'a' END AS last_class
FROM part
""")
def range_classes(spark, sf_dir):
    """Classes by the first and by the last matching range."""
    x = F.col("p_size")
    first = N.first_class(x, [(None, 10, "low"), (10, 30, "mid"), (30, None, "high")], exact=[(25, "exact")])
    return table(spark, sf_dir, "part").select("p_partkey", first.alias("first_class"), N.last_class(x, [(1, 20, "a"), (10, 30, "b"), (20, 50, "c")]).alias("last_class"))


@query("""
WITH r AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 0 WHEN event_id % 7 = 0 THEN value / 1000 ELSE value END AS v, event_type FROM events), e AS (SELECT event_type, CASE WHEN event_type = 'view' THEN 0 ELSE 2 END AS lo, CASE WHEN event_type = 'error' THEN 0 ELSE 1000 END AS hi FROM r GROUP BY 1),
l AS (SELECT event_type, CASE lo WHEN 0 THEN -1 ELSE ln(lo) / ln(10::DOUBLE) END AS a, CASE hi WHEN 0 THEN 0 ELSE ln(hi) / ln(10::DOUBLE) END AS b FROM e)
SELECT event_id, round(CASE WHEN v = 0 THEN 0 WHEN v < 1 THEN v / (b - a) ELSE (ln(v) / ln(10::DOUBLE) - a) / (b - a) END, 6) AS height FROM r JOIN l USING (event_type)
""")
def log_heights(spark, sf_dir):
    """Heights on logarithmic axes, with zeros and values below 1 (P25)."""
    n, kind = F.col("event_id"), F.col("event_type")
    v = F.when(n % 50 == 0, F.lit(0.0)).when(n % 7 == 0, F.col("value") / 1000).otherwise(F.col("value"))
    low, high = F.when(kind == "view", 0.0).otherwise(2.0), F.when(kind == "error", 0.0).otherwise(1000.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(N.log_height(v, low, high, 10), 6).alias("height"))


@query("""
WITH v AS (SELECT p_brand, p_partkey, CASE WHEN p_brand < 'Brand#3' THEN round(p_retailprice) WHEN p_brand < 'Brand#5' THEN round(p_retailprice) / 4 ELSE round(p_retailprice) / 1000 END AS v FROM part),
d AS (SELECT *, length(regexp_extract(rtrim(printf('%.6f', v), '0'), '[.]([0-9]*)$', 1)) AS d FROM v), r AS (SELECT p_brand, max(d) AS d, max(v) - min(v) AS span FROM d GROUP BY 1)
SELECT p_partkey, CASE WHEN r.d = 1 THEN printf('%.1f', v) WHEN r.d = 2 THEN printf('%.2f', v) WHEN r.d = 3 THEN printf('%.3f', v) WHEN span < 5 THEN printf('%.1f', v) ELSE printf('%.0f', v) END AS label FROM v JOIN r USING (p_brand)
""")
def axis_labels_decimals(spark, sf_dir):
    """Labels with as many decimals as the data of their axis need."""
    whole = F.round("p_retailprice")
    v = F.when(F.col("p_brand") < "Brand#3", whole).when(F.col("p_brand") < "Brand#5", whole / 4).otherwise(whole / 1000)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", v.alias("v"))
    axes = p.groupBy("p_brand").agg(F.max(N.decimals_of(F.col("v"), 6)).alias("d"), (F.max("v") - F.min("v")).alias("span"))
    return p.join(axes, "p_brand").select("p_partkey", N.axis_label(F.col("v"), F.col("d"), F.col("span")).alias("label"))


@query("""
WITH s AS (SELECT s_suppkey, s_acctbal AS v, min(s_acctbal) OVER () AS lo, max(s_acctbal) OVER () AS hi FROM supplier)
SELECT s_suppkey, CASE WHEN v BETWEEN 2000 AND 9000 THEN 'c' WHEN v BETWEEN 0 AND 3000 THEN 'b' WHEN v BETWEEN -100 AND 100 THEN 'a' END AS class,
       CASE WHEN v BETWEEN 2000 AND 9000 THEN 100.0::DOUBLE * v / 11000 WHEN v BETWEEN 0 AND 3000 THEN 100.0::DOUBLE * v / 3000 WHEN v BETWEEN -100 AND 100 THEN 100.0::DOUBLE * v / 200 ELSE 100.0::DOUBLE * v / (abs(hi) + abs(lo)) END AS percent
FROM s
""")
def class_percents(spark, sf_dir):
    """The last range that holds a value, and the percentage within it."""
    s, v, ranges = table(spark, sf_dir, "supplier"), F.col("s_acctbal"), [(-100, 100, "a"), (0, 3000, "b"), (2000, 9000, "c")]
    ends = s.agg(F.min("s_acctbal")).scalar(), s.agg(F.max("s_acctbal")).scalar()
    return s.select("s_suppkey", N.last_class(v, ranges).alias("class"), N.class_percent(v, ranges, *ends).alias("percent"))


@query("""
WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer), r AS (SELECT min(v) AS lo, max(v) AS hi FROM s),
t AS (SELECT c_custkey, v, least(greatest((v - lo) / (hi - lo), 0), 1) * 200.0::DOUBLE AS q FROM s, r),
c AS (SELECT c_custkey, v, CASE WHEN q < 120 THEN [200.0 - q, 0.0, 0.0]::DOUBLE[] ELSE [80.0, q - 120, 0.0]::DOUBLE[] END AS rgb FROM t)
SELECT c_custkey, CASE WHEN v IS NULL THEN '#ffffff' ELSE '#' || lpad(lower(printf('%x', CAST(floor(round(rgb[1], 6)) AS BIGINT))), 2, '0') || lpad(printf('%x', CAST(floor(round(rgb[2], 6)) AS BIGINT)), 2, '0') || '00' END AS colour FROM c
""")
def scale_colours(spark, sf_dir):
    """Values as colours of a scale through three of them, a default for what has no value."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal")).alias("v"))
    return c.select("c_custkey", N.colour_of(F.col("v"), c.agg(F.min("v")).scalar(), c.agg(F.max("v")).scalar(), ["#c80000", "#500000", "#505000"], "#ffffff").alias("colour"))


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal, min(s_acctbal) OVER (PARTITION BY s_nationkey) AS lo, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS hi,
                  (SELECT min(s_acctbal) FROM supplier) AS glo, (SELECT max(s_acctbal) FROM supplier) AS ghi FROM supplier)
SELECT s_suppkey, CASE WHEN lo = hi THEN 0.5::DOUBLE ELSE (s_acctbal - lo) / (hi - lo) END AS height, round(pow((s_acctbal - glo) / (ghi - glo), 0.2::DOUBLE), 6) AS colour,
       round((s_acctbal + abs(lo)) / nullif(abs(hi - lo), 0), 6) AS radius
FROM s
""")
def minmax_scale(spark, sf_dir):
    """Min-max scales by group and over all, polynomial normaliser, radar share."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    least, most = s.agg(F.min("s_acctbal")).scalar(), s.agg(F.max("s_acctbal")).scalar()
    w = Window.partitionBy("s_nationkey")
    rows = s.withColumn("lo", F.min("s_acctbal").over(w)).withColumn("hi", F.max("s_acctbal").over(w)).withColumn("glo", least).withColumn("ghi", most)
    v, lo, hi = F.col("s_acctbal"), F.col("lo"), F.col("hi")
    return rows.select("s_suppkey", N.scaled(v, lo, hi).alias("height"), F.round(F.pow(N.scaled(v, F.col("glo"), F.col("ghi")), F.lit(0.2)), 6).alias("colour"), F.round((v + F.abs(lo)) / F.nullif(F.abs(hi - lo), F.lit(0.0)), 6).alias("radius"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity - coalesce(CASE WHEN l_returnflag = 'A' THEN l_discount END, l_tax) AS low, l_quantity + coalesce(l_tax, CASE WHEN l_returnflag = 'A' THEN l_discount END) AS high
FROM lineitem
""")
def error_bars(spark, sf_dir):
    """Ends of error bars, one missing side taken from the other; columns in a new order."""
    low, high = N.bar_ends(F.col("l_quantity"), F.when(F.col("l_returnflag") == "A", F.col("l_discount")), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", "l_suppkey", "l_partkey", high.alias("high"), low.alias("low"))
