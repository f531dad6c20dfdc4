"""Queries of grids: filters, sorting, pages, facets and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import predicates as P
from lattica.operators import aggregates as A
from lattica.operators import ordering
from lattica.sources.tables import table

from .base import query


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE contains(p_name, 'ed') AND p_size = 11 AND TRUE")
def grid_filter_contains(spark, sf_dir):
    """A conjunction of grid filters; empty ones pass."""
    p = table(spark, sf_dir, "part")
    where = P.all_of([P.grid_text(F.col("p_name"), "ed"), P.grid_equal(F.col("p_size"), 11), P.grid_text(F.col("p_brand"), ""), P.grid_choice(F.col("p_size"), 0), P.grid_equal(F.col("p_type"), None)])
    return p.where(where).select("p_partkey", "p_name", "p_brand", "p_size")


@query("SELECT p_partkey, p_brand AS brand, p_size + 1 AS size FROM part WHERE p_brand = 'Brand#7'")
def nested_paths(spark, sf_dir):
    """Nested fields read by path and set."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("a")).alias("item"))
    changed = p.withColumn("item", F.col("item").withField("a.size", F.col("item.a.size") + 1))
    return changed.where(F.col("item.a.brand") == "Brand#7").select("p_partkey", F.col("item.a.brand").alias("brand"), F.col("item.a.size").alias("size"))


@query("""
SELECT c_custkey, seg, row_number() OVER (ORDER BY seg ASC NULLS FIRST, c_custkey) - 1 AS pos
FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer)
""")
def grid_sort_nulls_first(spark, sf_dir):
    """Sorting as strings, nulls first."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("seg"))
    return ordering.global_position(c, [F.col("seg").asc_nulls_first(), F.col("c_custkey")])


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN NULL ELSE p_size - 10 END AS n, CASE WHEN p_size > 45 THEN NULL ELSE TIMESTAMP '1969-12-20' + to_days(CAST(p_size AS INTEGER)) END AS d,
                  CASE WHEN p_size > 45 THEN 'none' ELSE p_retailprice || 'px' END AS s, p_retailprice AS r, p_size FROM part)
SELECT 'number' AS kind, p_partkey, row_number() OVER (ORDER BY coalesce(n, 0), p_partkey) - 1 AS pos FROM p UNION ALL SELECT 'date', p_partkey, row_number() OVER (ORDER BY coalesce(d, TIMESTAMP '1970-01-01'), p_partkey) - 1 FROM p
UNION ALL SELECT 'numberAsString', p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size > 45 THEN NULL ELSE r END NULLS LAST, p_partkey) - 1 FROM p
""")
def grid_sort_kinds(spark, sf_dir):
    """Sorting as numbers, dates and numbers in texts."""
    some = F.col("p_size") <= 45
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(some, F.col("p_size") - 10).alias("number"), F.when(some, F.to_timestamp_ntz(F.lit("1969-12-20 00:00:00")) + F.make_dt_interval(days=F.col("p_size").cast("int"))).alias("date"), F.when(some, F.concat(F.col("p_retailprice").cast("string"), F.lit("px"))).otherwise("none").alias("numberAsString"))
    each = [ordering.global_position(p.select(F.lit(k).alias("kind"), "p_partkey", F.col(k).alias("v")), [ordering.sort_key(F.col("v"), k), F.col("p_partkey")]).select("kind", "p_partkey", "pos") for k in ("number", "date", "numberAsString")]
    return each[0].union(each[1]).union(each[2])


_ACCENTED = "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, 'e', 'é') WHEN 3 THEN replace(replace(p_name, 'a', 'ä'), 'o', 'Ö') ELSE p_name END"


@query(f"""
WITH p AS (SELECT p_partkey, {_ACCENTED} AS name FROM part)
SELECT 'up' AS way, p_partkey, name, row_number() OVER (ORDER BY name COLLATE en NULLS FIRST, p_partkey) - 1 AS pos FROM p
UNION ALL SELECT 'down', p_partkey, name, row_number() OVER (ORDER BY name COLLATE en DESC NULLS LAST, p_partkey) - 1 FROM p
""")
def grid_sort_locale(spark, sf_dir):
    """Accented names in mixed case, in the order of a locale and in the opposite one."""
    n, name = F.col("p_partkey") % 5, F.col("p_name")
    told = F.when(n == 1, F.upper(name)).when(n == 2, F.replace(name, F.lit("e"), F.lit("é"))).when(n == 3, F.replace(F.replace(name, F.lit("a"), F.lit("ä")), F.lit("o"), F.lit("Ö"))).when(n == 4, name)
    p = table(spark, sf_dir, "part").select("p_partkey", told.alias("name"))
    each = [ordering.global_position(p.select(F.lit(way).alias("way"), "p_partkey", "name"), [ordering.sort_key(F.col("name"), "string", down, "UNICODE"), F.col("p_partkey")]) for way, down in (("up", False), ("down", True))]
    return each[0].union(each[1])


@query("""
SELECT c_custkey, bal, row_number() OVER (ORDER BY coalesce(bal, 0) DESC, c_custkey) - 1 AS pos FROM (SELECT c_custkey, CASE WHEN c_acctbal > 500 THEN c_acctbal WHEN c_acctbal < 0 THEN c_acctbal END AS bal FROM customer)
""")
def grid_sort_descending(spark, sf_dir):
    """A grid sorted by the same number column again: the other way round, null as zero."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when((F.col("c_acctbal") > 500) | (F.col("c_acctbal") < 0), F.col("c_acctbal")).alias("bal"))
    return ordering.global_position(c, [ordering.sort_key(F.col("bal"), "number", ordering.toggled("bal", "bal", False)), F.col("c_custkey")])


@query("""
SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS pos, CAST(3 AS BIGINT) AS page, CAST(ceil((SELECT count(*) FROM customer) / 20.0) AS BIGINT) AS n_pages
FROM customer QUALIFY pos BETWEEN 40 AND 59
""")
def grid_page(spark, sf_dir):
    """Sort and page of twenty, pushed down as a top-k."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return ordering.grid_page(c, [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders QUALIFY pos BETWEEN 5 AND 24")
def position_range(spark, sf_dir):
    """Rows between two positions given in reverse."""
    return ordering.between_positions(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderkey")], 24, 5)


@query("SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events QUALIFY pos BETWEEN 33 AND 52")
def scroll_window(spark, sf_dir):
    """The rows shown at a pixel offset."""
    return ordering.scroll_window(table(spark, sf_dir, "events").select("event_id", "value"), [F.col("event_id")], 1009, 30, 20)


@query("SELECT coalesce(value, '') AS value, count(*) AS n FROM (SELECT CASE WHEN o_totalprice < 20000 THEN NULL ELSE o_orderpriority END AS value FROM orders) GROUP BY 1")
def facet_counts(spark, sf_dir):
    """Values and their rows, null as '' (A8)."""
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_totalprice") >= 20000, F.col("o_orderpriority")).alias("value"))
    return A.facet_counts(o, "value")


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY 1")
def facet_array_counts(spark, sf_dir):
    """Elements of arrays and their rows."""
    return A.facet_counts(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("value")), "value", array=True)


@query("""
SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'LARGE') AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')
  AND (list_contains(string_split(p_name, ' '), 'red') OR list_contains(string_split(p_name, ' '), 'ring'))
""")
def facet_filter(spark, sf_dir):
    """Or within a pane, and across panes, membership in arrays."""
    words = F.split("p_name", " ")
    where = P.facet(F.col("p_type"), ["SMALL", "LARGE"]) & P.facet(F.col("p_brand"), ["Brand#1", "Brand#2", "Brand#3"]) & P.facet_array(words, ["red", "ring"]) & P.facet(F.col("p_brand"), [])
    return table(spark, sf_dir, "part").where(where).select("p_partkey")


@query("""
SELECT p_brand AS value, count(*) FILTER (WHERE p_size > 40 AND p_type = 'SMALL') AS shown, count(*) AS total FROM part
GROUP BY p_brand HAVING count(*) FILTER (WHERE p_size > 40 AND p_type = 'SMALL') > 0
""")
def facet_shown_total(spark, sf_dir):
    """Rows shown under the other filters and in total; options without rows fall away."""
    p = table(spark, sf_dir, "part")
    return A.shown_total(p, "p_brand", (F.col("p_size") > 40) & (F.col("p_type") == "SMALL"))


@query("""
SELECT 'cheap' AS value, count(*) FILTER (WHERE p_retailprice < 920 AND p_size > 10) AS shown, count(*) FILTER (WHERE p_retailprice < 920) AS total FROM part
UNION ALL SELECT 'large', count(*) FILTER (WHERE p_type = 'LARGE' AND p_size > 10), count(*) FILTER (WHERE p_type = 'LARGE') FROM part
UNION ALL SELECT 'both', count(*) FILTER (WHERE p_retailprice < 920 AND p_type = 'LARGE' AND p_size > 10), count(*) FILTER (WHERE p_retailprice < 920 AND p_type = 'LARGE') FROM part
""")
def facet_predicates(spark, sf_dir):
    """Counts of predicates, alone and combined with and."""
    cheap, large = F.col("p_retailprice") < 920, F.col("p_type") == "LARGE"
    return A.predicate_counts(table(spark, sf_dir, "part"), {"cheap": cheap, "large": large, "both": cheap & large}, F.col("p_size") > 10)


@query("""
WITH c AS (SELECT 'c_mktsegment' AS "column", count(DISTINCT c_mktsegment) AS bins, count(*) AS n, 0.6 AS lim FROM customer
  UNION ALL SELECT 'c_name', count(DISTINCT c_name), count(*), 0.6 FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey), count(*), 0.001 FROM customer)
SELECT "column", bins, bins / n AS ratio, bins / n > lim OR bins <= 1 AS hidden FROM c
""")
def facet_unique_ratio(spark, sf_dir):
    """Which facets are hidden for too many unique values."""
    return A.unique_ratio(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_name", "c_nationkey"], own={"c_nationkey": 0.001})


@query("""
SELECT 'required' AS rule, count(*) FILTER (WHERE text IS NULL OR text = '') AS violations FROM documents
UNION ALL SELECT 'rangeLength', count(*) FILTER (WHERE length(text) NOT BETWEEN 100 AND 5000) FROM documents
UNION ALL SELECT 'minLength', count(*) FILTER (WHERE length(text) < 300) FROM documents
UNION ALL SELECT 'maxLength', count(*) FILTER (WHERE length(text) > 4000) FROM documents
UNION ALL SELECT 'pattern', count(*) FILTER (WHERE NOT regexp_matches(source, '^(?:src1[0-9]?)$')) FROM documents
UNION ALL SELECT 'range', count(*) FILTER (WHERE n_chars NOT BETWEEN 200 AND 3000) FROM documents
UNION ALL SELECT 'min', count(*) FILTER (WHERE n_chars < 150) FROM documents
UNION ALL SELECT 'max', count(*) FILTER (WHERE n_chars > 9000) FROM documents
""")
def validator_violations(spark, sf_dir):
    """Violations of each validation rule in one pass (F16)."""
    text, n = F.col("text"), F.col("n_chars")
    rules = {
        "required": P.required(text), "rangeLength": P.length_range(text, 100, 5000), "minLength": P.length_range(text, low=300), "maxLength": P.length_range(text, high=4000),
        "pattern": P.pattern(F.col("source"), "src1[0-9]?"), "range": P.number_range(n, 200, 3000), "min": P.number_range(n, low=150), "max": P.number_range(n, high=9000),
    }
    parts = [F.struct(F.lit(k).alias("rule"), F.count_if(~valid).alias("violations")) for k, valid in rules.items()]
    return table(spark, sf_dir, "documents").agg(F.array(*parts).alias("_p")).select(F.inline("_p"))


@query("SELECT event_id, ts, value FROM events WHERE value BETWEEN 20 AND 30 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def zoom_range(spark, sf_dir):
    """Ranges of numbers and times from ends in either order."""
    e = table(spark, sf_dir, "events")
    ends = [F.to_timestamp_ntz(F.lit(x)) for x in ("2024-01-20 00:00:00", "2024-01-05 00:00:00")]
    return e.where(P.in_range(F.col("value"), 30.0, 20.0) & P.in_range(F.col("ts"), *ends)).select("event_id", "ts", "value")


@query("""
WITH hit AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'), sel AS (SELECT * FROM hit WHERE o_totalprice > 450000)
SELECT * FROM sel UNION ALL SELECT * FROM hit WHERE NOT EXISTS (SELECT 1 FROM sel)
""")
def export_selection(spark, sf_dir):
    """Rows to export: those selected among the hits, or all hits if none is."""
    hit = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_totalprice").withColumn("_sel", F.col("o_totalprice") > 450000)
    some = hit.agg(F.coalesce(F.max("_sel"), F.lit(False))).scalar()
    return hit.where(F.col("_sel") | ~some).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT count(*) AS rows, 1 AS header_rows, count(*) + 1 AS lines FROM orders")
def export_counts(spark, sf_dir):
    """Rows and lines of an export."""
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("rows"), F.lit(1).alias("header_rows"), (F.count("*") + 1).alias("lines"))
