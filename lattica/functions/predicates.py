"""Boolean columns: lookups, grid and facet filters, ranges and validation rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types by how they are handled.
IMAGES = (".png", ".jpg", ".jpeg")
SAMPLES = (*IMAGES, ".gif")
VIDEOS = (".mp4", ".avi", ".mov", ".mkv")


def iexact(name: Column, value: Column | str) -> Column:
    return F.lower(name) == F.lower(F.lit(value) if isinstance(value, str) else value)


def has_suffix(key: Column, suffixes: Sequence[str]) -> Column:
    return F.lower(key).rlike("(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$")


# Fixed value: what names of buckets look like.
BUCKET_NAME = "^[a-z0-9][a-z0-9-]{1,61}[a-z0-9]$"


def media_kind(ext: Column) -> Column:
    return F.when(ext.isin(*IMAGES), "image").when(ext == ".gif", "gif").when(ext.isin(*VIDEOS), "video").otherwise("unsupported")


def valid_bucket_name(name: Column) -> Column:
    return name.rlike(BUCKET_NAME)


def filled(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def grid_text(value: Column, needle: str | None) -> Column:
    """Case-sensitive containment; an empty needle passes."""
    return value.contains(needle) if needle else F.lit(True)


def grid_equal(value: Column, wanted) -> Column:
    """Equality; nothing wanted passes."""
    return F.lit(True) if wanted is None else value == F.lit(wanted)


def grid_choice(value: Column, wanted: int | None) -> Column:
    """Equality with a choice whose 0 means any."""
    return value == F.lit(wanted) if wanted else F.lit(True)


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def facet(value: Column, chosen: Sequence[str]) -> Column:
    """One of the chosen values (null counts as ''); nothing chosen passes."""
    return F.coalesce(value, F.lit("")).isin(*chosen) if chosen else F.lit(True)


def facet_array(values: Column, chosen: Sequence[str]) -> Column:
    """An array that holds one of the chosen values."""
    return F.coalesce(F.arrays_overlap(values, F.array(*map(F.lit, chosen))), F.lit(False)) if chosen else F.lit(True)


def in_range(value: Column, a, b) -> Column:
    """Between two ends given in either order, both included."""
    return value.between(F.least(F.lit(a), F.lit(b)), F.greatest(F.lit(a), F.lit(b)))


# Validation rules: each is true where a value is valid; nulls fail only ``required``.
def required(value: Column) -> Column:
    return filled(value.cast("string"))


def length_range(value: Column, low: int | None = None, high: int | None = None) -> Column:
    n = F.length(value)
    return F.coalesce(all_of(([n >= low] if low is not None else []) + ([n <= high] if high is not None else [])), F.lit(True))


def pattern(value: Column, regex: str) -> Column:
    """The whole value matches."""
    return F.coalesce(value.rlike(f"^(?:{regex})$"), F.lit(True))


def number_range(value: Column, low=None, high=None) -> Column:
    return F.coalesce(all_of(([value >= F.lit(low)] if low is not None else []) + ([value <= F.lit(high)] if high is not None else [])), F.lit(True))
