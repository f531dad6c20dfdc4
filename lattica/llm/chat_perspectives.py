"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation (each role but ``system`` that speaks in it)
the dialogue is rendered once with that speaker as the assistant and all other speakers
as named users. The mask says which characters are trained on: those of the assistant's
texts, as half-open character spans of the rendered text.

A conversation's turns are shuffled once, by conv_id; participants, places and rendering
are windows and aggregates over that distribution. The work grows with turns times
participants of one conversation, which is what is put out.

Defined results: turns are ordered by (turn, role, text), nulls first, and repeated
turns are rendered as often as they occur; a null role speaks as ``unknown``, and is one
speaker with a role of that name; roles and texts are written as they are, marks and all, so
whoever fears forged turns strips the marks before; a null text is '', a text of any length is rendered whole; a conversation without participants (system turns only) has no rendering;
a null conv_id is one conversation; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def perspectives(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, n_turns, n_trained, trained_chars, rendered, mask)."""
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    speakers = F.collect_set(F.when(F.col("role") != "system", F.col("role"))).over(Window.partitionBy("conv_id"))
    each = said.withColumn("speakers", speakers).select("conv_id", "turn", "role", "text", F.explode("speakers").alias("perspective"))
    own = F.col("role") == F.col("perspective")
    head = F.concat(F.lit(OPEN), F.when(own, F.lit("assistant")).when(F.col("role") == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), F.col("role"))), F.lit("\n"))
    order = Window.partitionBy("conv_id", "perspective").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    shown = each.withColumn("own", own).withColumn("head", head).withColumn("shown", F.concat("head", "text", F.lit(CLOSE)))
    shown = shown.withColumn("no", F.row_number().over(order)).withColumn("upto", F.sum(F.length("shown")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    shown = shown.withColumn("from", F.col("upto") - F.length("shown") + F.length("head")).withColumn("to", F.col("from") + F.length("text"))
    parts = F.sort_array(F.collect_list(F.struct("no", "shown")))
    spans = F.sort_array(F.collect_list(F.when(F.col("own"), F.struct("no", F.concat(F.col("from").cast("string"), F.lit(":"), F.col("to").cast("string")).alias("span")))))
    return shown.groupBy("conv_id", "perspective").agg(
        F.count("*").alias("n_turns"),
        F.count_if("own").alias("n_trained"),
        F.coalesce(F.sum(F.when(F.col("own"), F.length("text"))), F.lit(0)).cast("long").alias("trained_chars"),
        F.array_join(F.transform(parts, lambda x: x["shown"]), "").alias("rendered"),
        F.array_join(F.transform(spans, lambda x: x["span"]), ",").alias("mask"),
    )


def op5_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each of its participants."""
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP5_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'
), headed AS (
  SELECT s.*, p.perspective, s.role = p.perspective AS own,
         '<|im_start|>' || CASE WHEN s.role = p.perspective THEN 'assistant' WHEN s.role = 'system' THEN 'system'
                                ELSE 'user name=' || s.role END || chr(10) AS head
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), shown AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS shown FROM headed
), placed AS (
  SELECT *, row_number() OVER w AS no,
         sum(length(shown)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(shown) + length(head) AS begun
  FROM shown
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_trained,
       CAST(coalesce(sum(length(text)) FILTER (WHERE own), 0) AS BIGINT) AS trained_chars,
       string_agg(shown, '' ORDER BY no) AS rendered,
       coalesce(string_agg(CAST(begun AS BIGINT)::VARCHAR || ':' || CAST(begun + length(text) AS BIGINT)::VARCHAR, ',' ORDER BY no)
                FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, perspective
"""
