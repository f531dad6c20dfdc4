"""Numeric columns: geometry of frames, rounding, logarithms, classes and scales."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size of a frame in pixels.
FRAME_W, FRAME_H = 1920, 1080


def even(n: Column) -> Column:
    """The next even number."""
    return n + F.pmod(n, F.lit(2))


def crop_start(n: Column, limit: int) -> Column:
    """Where a centred crop to ``limit`` begins."""
    return F.when(n > limit, F.floor((n - F.lit(limit)) / 2)).otherwise(F.lit(0)).cast("long")


def crop_size(n: Column, limit: int) -> Column:
    return F.least(n, F.lit(limit)).cast("long")


def share_of(n: Column, share: float, least: int = 0) -> Column:
    """A truncated share of a length, ``least`` at least."""
    return F.greatest(F.lit(least), (n * F.lit(share)).cast("long")).cast("long")


def zoom(start: float, end: float, t: Column, duration: float) -> Column:
    """A factor that goes from start to end over the duration."""
    return F.lit(start) + F.lit(end - start) * t / F.lit(duration)


def floor(x: Column) -> Column:
    """The whole number not above x as a double, so that none is too large; infinities and NaN stay."""
    near = F.rint(x)
    return F.when(near > x, near - F.lit(1.0)).otherwise(near)


def ceil(x: Column) -> Column:
    return -floor(-x)


def ln(x: Column) -> Column:
    """The natural logarithm; minus infinity for 0, NaN below it (Spark's own is null for both)."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def whole_power(base: float, n: Column) -> Column:
    """The base to a whole power. Negative ones are divisions as far as powers of ten are exact
    doubles: Spark's 10 to the -5 is 0.000009999999999999999."""
    return F.when(n.between(-22, -1), F.lit(1.0) / F.pow(F.lit(float(base)), -n)).otherwise(F.pow(F.lit(float(base)), n))


def round_to(x: Column, step: float) -> Column:
    return floor(x / F.lit(step) + F.lit(0.5)) * F.lit(step)


def ceil_to(x: Column, step: float) -> Column:
    return ceil(x / F.lit(step)) * F.lit(step)


def floor_to(x: Column, step: float) -> Column:
    return floor(x / F.lit(step)) * F.lit(step)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def log_base(x: Column, base: float) -> Column:
    """Minus infinity for 0, NaN below it."""
    return ln(x) / F.lit(math.log(base))


def power_below(x: Column, base: float) -> Column:
    """The largest whole power of the base that is not above x; 0 for 0, NaN below it."""
    return whole_power(base, floor(F.round(log_base(x, base), 9)))


def log_clamped(x: Column, least: float) -> Column:
    """The natural logarithm with a lower bound on its argument."""
    return F.ln(F.greatest(x, F.lit(least)))


def log_height(x: Column, low: Column, high: Column, base: float) -> Column:
    """The height of x on a logarithmic axis from ``low`` to ``high``, as a share of it: 0 for 0, in
    proportion to x below 1; an end that is 0 counts as a power below 1 (``low``) or as 1."""
    bottom = F.when(low == 0, F.lit(-1.0)).otherwise(log_base(low, base))
    levels = F.nullif(F.when(high == 0, F.lit(0.0)).otherwise(log_base(high, base)) - bottom, F.lit(0.0))
    return F.when(x == 0, F.lit(0.0)).when(x < 1, x / levels).otherwise((log_base(x, base) - bottom) / levels)


def decimals_of(x: Column, most: int = 10) -> Column:
    """How many decimals a value needs, ``most`` at most."""
    text = F.regexp_replace(F.format_string(f"%.{most}f", x.cast("double")), "0+$", "")
    return F.when(x.isNotNull(), F.length(F.substring_index(text, ".", -1)))


def axis_label(x: Column, decimals: Column, span: Column) -> Column:
    """A value as an axis shows it: with the decimals that the data need, or if they need none with one for a span under 5."""
    with_them = F.concat(F.lit("%."), F.when(decimals > 0, decimals).when(span < 5, 1).otherwise(0).cast("string"), F.lit("f"))
    return F.when(x.isNotNull(), F.call_function("format_string", with_them, x.cast("double")))


def percent_of_ends(x: Column, low: Column, high: Column) -> Column:
    """x as a percentage of the sizes of both ends together; a range of nothing counts as a tiny negative one."""
    size = F.abs(low) + F.abs(high)
    return F.lit(100.0) * x / F.when(size == 0, F.lit(-0.000001)).otherwise(size)


def class_percent(x: Column, ranges: Sequence[tuple[float, float, str]], low: Column, high: Column) -> Column:
    """``percent_of_ends`` within the last range that holds x, else within ``low`` and ``high``."""
    out = percent_of_ends(x, low, high)
    for a, b, _ in ranges:
        out = F.when((x >= a) & (x <= b), percent_of_ends(x, F.lit(float(a)), F.lit(float(b)))).otherwise(out)
    return out


def colour_of(x: Column, low: Column, high: Column, colours: Sequence[str], default: str) -> Column:
    """The colour of x on a scale that goes through ``colours`` (such as #c8eeff), which lie apart
    by their distance as points of red, green and blue; ``default`` for null and NaN."""
    rgb = [[int(c.lstrip("#")[i : i + 2], 16) for i in (0, 2, 4)] for c in colours]
    lengths = [math.dist(a, b) for a, b in zip(rgb, rgb[1:])]
    whole = sum(lengths) or 1.0
    at = F.least(F.greatest((x - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * F.lit(whole)
    parts = []
    for channel in range(3):
        out, begun = F.lit(float(rgb[-1][channel])), sum(lengths)
        for a, b, n in reversed(list(zip(rgb, rgb[1:], lengths))):
            begun -= n
            out = F.when(at < begun + n, a[channel] + (at - F.lit(begun)) / F.lit(n or 1.0) * (b[channel] - a[channel])).otherwise(out)
        parts.append(F.lpad(F.lower(F.hex(F.floor(F.round(out, 6)).cast("long"))), 2, "0"))
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(default)).otherwise(F.concat(F.lit("#"), *parts))


def saturated(x: Column, most: float) -> Column:
    """Infinities as the largest finite value of either sign."""
    return F.when(x == float("inf"), F.lit(most)).when(x == float("-inf"), F.lit(-most)).otherwise(x)


def first_class(x: Column, ranges: Sequence[tuple[float | None, float | None, str]], exact: Sequence[tuple[float, str]] = ()) -> Column:
    """The label of the first range that holds x, ends included and optional; exact values come first."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(ranges):
        out = F.when((x >= low if low is not None else F.lit(True)) & (x <= high if high is not None else F.lit(True)), F.lit(label)).otherwise(out)
    for value, label in reversed(exact):
        out = F.when(x == value, F.lit(label)).otherwise(out)
    return F.when(x.isNotNull(), out)


def last_class(x: Column, ranges: Sequence[tuple[float, float, str]]) -> Column:
    """As ``first_class``, but the last range wins."""
    return first_class(x, list(reversed(ranges)))


def scaled(x: Column, low: Column, high: Column, flat: float = 0.5) -> Column:
    """(x - low) / (high - low), or ``flat`` where the range is empty."""
    return F.when(high == low, F.lit(flat)).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)))


def bar_ends(y: Column, lower: Column, upper: Column) -> tuple[Column, Column]:
    """The ends of an error bar; one missing error is taken from the other."""
    return y - F.coalesce(lower, upper), y + F.coalesce(upper, lower)


def summed(x: Column, digits: int | None = None) -> Column:
    """A sum of doubles. Where the caller knows that ``digits`` decimals hold every term
    (amounts of money, say), the sum is exact and does not depend on the order of terms."""
    return F.sum(x.cast("double") if digits is None else x.cast(f"decimal(28,{digits})")).cast("double")
