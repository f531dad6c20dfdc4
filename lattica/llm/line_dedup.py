"""Removal of lines that many documents share, in DataFrame operations only.

Lines are split at \\n; a line's key is the line without the ASCII spaces at its ends
and with A-Z lower-cased. Keys are hashed to two 64-bit values (128 bits), distinct
documents are counted for each hash, and keys found in ``min_docs`` documents or more
lose all their lines. Only (document, position, hash) is shuffled by hash; the text itself moves once,
when a row meets the sorted positions of its dropped lines, and what stays is the runs
between those positions, so a text's reassembly is linear in its lines.

Defined results: a null or empty text is one empty line and stays ''; a text of any
length is split whole, and only its lines' hashes are shuffled by themselves; empty keys are
never dropped; a document is a doc_id, so repeated rows count once and are treated
alike; rows with a null id are kept and count as one document; other columns pass
through ``dedup``, but ones named as the counts are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, saved

MIN_DOCS = 10
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    """The line without ASCII spaces at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = 1, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with its columns, ``text`` reassembled, and its lines and dropped lines counted in ``counts``."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    lines = docs.select(F.col("doc_id").alias("id"), mark.alias("mark"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("id", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_length)
    hashed = saved(keys.select("id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")))
    # two aggregates instead of count(distinct): both combine before they shuffle
    once = hashed.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    common = saved(once.groupBy("h1", "h2").agg(F.count("one").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2"))
    found = hashed.join(common, ["h1", "h2"]).groupBy("id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    id_, mark_, at_, own_ = fresh(docs, "_id", "_mark", "_at", "_own")
    found = found.select(F.col("id").alias(id_), F.col("mark").alias(mark_), F.col("at").alias(at_))
    joined = docs.withColumn(own_, mark).join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own_) == F.col(mark_)), "left")
    lines, n = _lines(F.col("text")), F.size(_lines(F.col("text")))
    cuts = F.concat(F.array(F.lit(-1)), F.col(at_), F.array(n))
    runs = F.transform(F.sequence(F.lit(0), F.size(at_)), lambda i: F.slice(lines, F.get(cuts, i) + 2, F.get(cuts, i + 1) - F.get(cuts, i) - 1))
    whole = F.coalesce(F.col("text"), F.lit(""))
    out = joined.withColumns(
        {
            counts[0]: n.cast("long"),
            counts[1]: F.coalesce(F.size(at_), F.lit(0)).cast("long"),
            "text": F.when(F.col(at_).isNull(), whole).otherwise(F.array_join(F.flatten(runs), "\n")),
        }
    )
    return out.drop(own_, id_, mark_, at_)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line counts and the SHA-256 of what stays, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
  SELECT no, doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT row_number() OVER () AS no, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 10
), told AS (
  SELECT no, doc_id, pos, line, k IN (SELECT k FROM common) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY no, doc_id
"""
