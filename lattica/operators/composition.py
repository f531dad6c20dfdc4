"""The frame plan of a composition: what a renderer would be handed.

scan -> filter -> position -> pair -> timeline, for two lists of images by composition;
rendering itself is a sink outside Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import numbers as N
from lattica.functions import predicates as P

from .joins import adjacent_pairs, zip_join
from .windows import frame_name


def frames(background: DataFrame, foreground: DataFrame, key: list[str], right_to_left: bool = False, duration_ms: int = 1000) -> DataFrame:
    """Frames (key, pos, name, bg_key, fg_key, start, end) of the i-th images of both lists.

    Inputs: key columns and ``object``; what is no image is left out first. For right to
    left the foreground is taken from its end. All frames last equally long, so a frame's
    start follows from its place. A key (a bucket) may be of any size.
    """
    images = lambda df, name: df.where(P.has_suffix(F.col("object"), P.IMAGES)).select(*key, F.col("object").alias(name))
    last = F.col("fg_key").desc() if right_to_left else F.col("fg_key")
    pairs = zip_join(images(background, "bg_key"), images(foreground, "fg_key"), key, ["bg_key"], [last], hot=True)
    start = F.col("pos") * F.lit(duration_ms).cast("long")
    return pairs.select(*key, "pos", frame_name(F.col("pos"), "merged", 3).alias("name"), "bg_key", "fg_key", start.alias("start"), (start + duration_ms).alias("end"))


def composites(plan: DataFrame, key: list[str]) -> DataFrame:
    """Two frames in one: n frames become half as many, an odd last one is left out."""
    return adjacent_pairs(plan, key, ["pos"], ["name"], hot=True).withColumn("name", frame_name(F.col("pair")))


def side_by_side(plan: DataFrame, bg_width, bg_height) -> DataFrame:
    """Sizes of a frame with the foreground at half the background's width beside it, made even."""
    w, h = F.col(bg_width), F.col(bg_height)
    return plan.withColumn("frame_w", N.even(w + N.share_of(w, 0.5))).withColumn("frame_h", N.even(h))
