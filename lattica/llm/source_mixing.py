"""Mixing of sources to target weights by a low-discrepancy schedule.

A source's documents, shuffled by the MD5 of their id, size and number among equal rows and
repeated once, are its stream of words. The schedule is a row of slots, one for each ``BLOCK`` words of all targets:
slot i maps the golden-ratio point frac(i * phi), in steps of 2^-32, through the
cumulative target weights to a source, and slots are ranked within their source. A source
whose share is too small for a point gets one slot after all others, in the order of the
sources, so there are no more slots than blocks and sources. A source's target, in words,
is cut into equal blocks, one for each of its slots (of about ``BLOCK`` words therefore);
the slot of rank r takes block r of the stream. A document's words come in the slots whose
blocks its two places in the stream overlap; these make what it gives, and the order of
the mix: its first slot and their number.

Targets: sources in code-point order, null last, weigh 3, 1, 2, repeating, and share 1.5
times all words; a target stops at 2 times its source's words and the excess is shared
again by weight, which is the level of a water-filling, found by one sort.

Streams and ranks are prefix sums in two steps (sums of small ranges of hashes or slots,
then sums within a range), so a source with a third of all rows is spread over many tasks.
The windows over sources hold a row a source.

Defined results: a null text has size 0 and is never taken; repeated rows have places of
their own in the stream; a null id shuffles as ''; the null source is one source; a text of
any length is one size, and as many slots as its words reach; other columns are ignored by
``plan`` and pass through ``mixed``; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import fresh, quoted, saved

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK = 1024
#: Rows of a range of hashes, about, and slots of a range of slots.
RANGE = 512
#: Equal rows that one task numbers at most.
PART = 10_000
#: The golden ratio's fraction in units of 2^-32, and the number of points after which they repeat (so that products stay in 63 bits).
PHI, PERIOD = 2_654_435_769, 1 << 31


def words(text):
    """The number of runs of characters other than the six ASCII spaces."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, sid, source_size, target) from (source, source_size); one row a source."""
    every, order = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("sid", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") - 1) % len(WEIGHTS) + 1))
    ranked = ranked.withColumn("total", F.sum("source_size").over(every)).withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    by_ratio = Window.orderBy("ratio", "sid")
    level = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    level = level.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    level = level.withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = level.withColumn("level", (F.lit(SHARE) * F.col("total") - F.col("before")) / F.col("left"))
    full = F.col("ratio") < F.col("level")
    first = F.min(F.when(~full, F.struct("ratio", "sid", "level"))).over(every)["level"]
    return level.withColumn("first", first).select("source", "sid", "source_size", F.when(full, F.col("cap")).otherwise(F.col("first") * F.col("weight")).alias("target"))


def _ranges(rows: DataFrame, key: list[str], cell: str, **sums) -> DataFrame:
    """For each (key, cell): the sums over the key's earlier cells."""
    each = rows.groupBy(*key, cell).agg(*[e.alias(n) for n, e in sums.items()])
    before = Window.partitionBy(*key).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*key, cell, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in sums])


def keyed(rows: DataFrame, n: int) -> DataFrame:
    """``n`` ``rows`` (sid, doc_id, size, ...) with the hash that shuffles them (``key``) and its range (``cell``).

    Equal rows are counted and told apart by their number among them, which is hashed too, so
    that neither one id's copies nor all rows without an id fall into one range. A large
    group is numbered in parts that many tasks take.
    """
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    parts = lambda low, high: F.explode(F.sequence(F.lit(low).cast("long") if isinstance(low, int) else low, high))
    few = equal.where(F.col("copies") <= PART).select(*rows.columns, parts(1, F.col("copies")).alias("copy"))
    many = equal.where(F.col("copies") > PART).select(*rows.columns, "copies", parts(0, F.expr(f"(copies - 1) div {PART}")).alias("part")).repartition("doc_id", "size", "part")
    many = many.select(*rows.columns, parts(F.col("part") * PART + 1, F.least(F.col("part") * PART + PART, F.col("copies"))).alias("copy"))
    text = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("copy").cast("string"))
    hashed = few.union(many).withColumn("key", F.md5(text.cast("binary"))).drop("copy")
    return hashed.withColumn("cell", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(max(1, ceil(n / RANGE))) / F.lit(1 << 32)).cast("long"))


def streams(rows: DataFrame) -> DataFrame:
    """``rows`` (sid, doc_id, size, ...) with ``pos``, the row's number in its source's
    shuffled stream, and ``lo``, the words before it."""
    keyed_ = keyed(rows, rows.count())
    ranges = _ranges(keyed_, ["sid"], "cell", n=F.count("*"), size=F.sum("size"))
    own = Window.partitionBy("sid", "cell").orderBy("key", "size", "doc_id")
    within = keyed_.withColumn("rn", F.row_number().over(own)).withColumn("upto", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return within.join(ranges, ["sid", "cell"]).withColumn("pos", F.col("n_before") + F.col("rn")).withColumn("lo", F.col("size_before") + F.col("upto") - F.col("size")).drop("key", "cell", "rn", "upto", "n_before", "size_before")


def schedule(wanted: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, sid, rank, width, words): the mix in order; block ``rank`` of a source starts at word
    rank * width of its stream. ``wanted``: written table (sid, quota)."""
    spark = wanted.sparkSession
    quotas = wanted.where("quota > 0").withColumn("hi", F.sum("quota").over(Window.orderBy("sid"))).withColumn("lo", F.col("hi") - F.col("quota"))
    total, sources = wanted.where("quota > 0").agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    n = ceil(total / block)
    cell = max(1, ceil(total / max(1024, 4 * sources)))
    point = (F.col("id") % PERIOD * PHI % (1 << 32)) / F.lit(float(1 << 32))
    points = spark.range(n).select(F.col("id").alias("slot"), F.least(F.floor(point * F.lit(float(total))).cast("long"), F.lit(total - 1)).alias("x")).withColumn("cell", F.expr(f"x div {cell}"))
    cells = quotas.select("sid", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))).alias("cell"))
    drawn = saved(points.join(cells, "cell").where("x >= lo and x < hi").select("slot", "sid", F.expr(f"slot div {RANGE}").alias("part")))
    counts = drawn.groupBy("sid").agg(F.count("*").alias("slots"))
    each = quotas.select("sid", "quota").join(counts, "sid", "left").withColumn("late", F.col("slots").isNull())
    each = each.withColumn("late_slot", F.when(F.col("late"), F.lit(n) + F.count_if("late").over(Window.orderBy("sid")) - 1)).withColumn("width", F.ceil(F.col("quota") / F.coalesce("slots", F.lit(1))))
    ranges = _ranges(drawn, ["sid"], "part", n=F.count("*"))
    rank = F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot"))
    ranked = drawn.withColumn("rn", rank).join(ranges, ["sid", "part"]).select("slot", "sid", (F.col("n_before") + F.col("rn") - 1).alias("rank"))
    every = ranked.union(each.where("late").select("late_slot", "sid", F.lit(0).cast("long"))).join(each.select("sid", "quota", "width"), "sid")
    return every.where("rank * width < quota").select("slot", "sid", "rank", "width", F.least("width", F.col("quota") - F.col("rank") * F.col("width")).alias("words"))


def _met(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The documents with their places in the streams, and (sid, pos, turn, slot, w): the
    words of each place (``turn`` 0 or 1) in each slot."""
    rows = saved(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    told = saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("quota", F.floor(F.col("target") + F.lit(0.5)).cast("long")))
    slots = saved(schedule(told.select("sid", "quota"), block))
    widths = slots.groupBy("sid").agg(F.first("width").alias("width"))
    own = told.join(widths, "sid", "left").select(F.col("source").alias("_s"), "sid", "source_size", "target", "quota", "width")
    placed = saved(streams(rows.join(own, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")))
    starts = placed.where("size > 0").select("sid", "pos", "size", "quota", "width", F.posexplode(F.array(F.col("lo"), F.col("lo") + F.col("source_size"))).alias("turn", "lo")).where("lo < quota")
    starts = starts.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("quota")))
    pieces = starts.select("sid", "pos", "turn", "lo", "hi", F.explode(F.sequence(F.expr("lo div width"), F.expr("(hi - 1) div width"))).alias("rank"))
    base = F.col("rank") * F.col("width")
    met = pieces.join(slots, ["sid", "rank"]).select("sid", "pos", "turn", "slot", (F.least("hi", base + F.col("words")) - F.greatest("lo", base)).alias("w"))
    return placed, met.where("w > 0")


def plan(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, n_slots) for every row of ``docs``."""
    placed, met = _met(docs, block)
    taken = met.groupBy("sid", "pos", "slot").agg(F.sum("w").alias("w")).groupBy("sid", "pos").agg(F.sum("w").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return placed.join(taken, ["sid", "pos"], "left").select("doc_id", "size", "source_size", "target", zero("taken"), "first_slot", zero("n_slots"))


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` as the mix has them, in the order of their slots: each as often (0, 1 or 2
    times) as the nearest whole number of times its words are taken; rows of one id go alike."""
    id_, slots_, slot_ = fresh(docs, "_id", "_slots", "_slot")
    placed, met = _met(docs, block)
    turns = met.groupBy("sid", "pos", "turn").agg(F.sum("w").alias("t"), F.min("slot").alias("slot"))
    each = turns.join(placed.select("sid", "pos", "doc_id", "size"), ["sid", "pos"]).groupBy("doc_id", "turn").agg(F.sum("t").alias("t"), F.min("slot").alias("slot"))
    sizes = placed.groupBy("doc_id").agg(F.sum("size").alias("n"))
    times = each.groupBy(F.col("doc_id").alias(id_)).agg(F.sum("t").alias("t"), F.sort_array(F.collect_list("slot")).alias(slots_))
    times = times.join(sizes, F.col(id_).eqNullSafe(F.col("doc_id"))).select(id_, F.slice(slots_, F.lit(1), F.round(F.col("t") / F.col("n")).cast("int")).alias(slots_)).where(F.size(slots_) > 0)
    rows = docs.join(times, F.col("doc_id").eqNullSafe(F.col(id_)))
    return rows.withColumn(slot_, F.explode(slots_)).repartitionByRange(slot_, id_).sortWithinPartitions(slot_, id_).select(*quoted(docs.columns))


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's target and share of the mix, and its slots in the schedule."""
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || row_number() OVER (PARTITION BY source, doc_id, size)) AS key
  FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents)
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(2.0 AS DOUBLE) * source_size AS cap
  FROM sources
), ratios AS (
  SELECT *, cap / weight AS ratio FROM weighed
), levels AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * total
             - coalesce(sum(cap) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / CAST(sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ratios
), told AS (
  SELECT *, CASE WHEN ratio < level THEN cap
                 ELSE weight * (SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, sid LIMIT 1) END AS target
  FROM levels
), quotas AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM told
), ranged AS (
  SELECT sid, quota, CAST(sum(quota) OVER (ORDER BY sid) AS BIGINT) AS hi, CAST(sum(quota) OVER () AS BIGINT) AS whole
  FROM quotas WHERE quota > 0
), blocks AS (
  SELECT CAST(ceil(max(whole) / 1024.0) AS BIGINT) AS n, max(whole) AS whole FROM ranged
), points AS (
  SELECT slot, least(CAST(floor((slot % 2147483648 * 2654435769 % 4294967296) / CAST(4294967296.0 AS DOUBLE) * CAST(whole AS DOUBLE)) AS BIGINT), whole - 1) AS x
  FROM (SELECT unnest(range(n)) AS slot, whole FROM blocks)
), drawn AS (
  SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank
  FROM points JOIN ranged ON x >= hi - quota AND x < hi
), late AS (
  SELECT (SELECT n FROM blocks) + row_number() OVER (ORDER BY sid) - 1 AS slot, sid, 0 AS rank
  FROM ranged WHERE sid NOT IN (SELECT sid FROM drawn)
), slots AS (
  SELECT slot, sid, rank, CAST(ceil(quota / CAST(count(*) OVER (PARTITION BY sid) AS DOUBLE)) AS BIGINT) AS width
  FROM (FROM drawn UNION ALL FROM late) JOIN quotas USING (sid)
), placed AS (
  SELECT s.doc_id, s.size, t.sid, t.source_size, t.target, t.quota,
         row_number() OVER (PARTITION BY t.sid ORDER BY s.key, s.size, s.doc_id) AS pos,
         CAST(sum(s.size) OVER (PARTITION BY t.sid ORDER BY s.key, s.size, s.doc_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - s.size AS lo
  FROM sized s JOIN quotas t ON s.source IS NOT DISTINCT FROM t.source
), starts AS (
  SELECT sid, pos, size, quota, unnest([lo, lo + source_size]) AS lo FROM placed WHERE size > 0
), met AS (
  SELECT sid, pos, slot, least(lo + size, quota, (rank + 1) * width) - greatest(lo, rank * width) AS w
  FROM starts JOIN slots USING (sid) WHERE lo < quota AND rank * width < least(lo + size, quota) AND (rank + 1) * width > lo
), taken AS (
  SELECT sid, pos, CAST(sum(w) AS BIGINT) AS taken, min(slot) AS first_slot, count(DISTINCT slot) AS n_slots FROM met GROUP BY sid, pos
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots
FROM placed LEFT JOIN taken USING (sid, pos)
"""
