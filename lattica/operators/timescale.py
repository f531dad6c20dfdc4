"""Time units and ticks, and numeric scales."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import numbers as N
from lattica.functions.dates import day_start, epoch_micros, plus, truncated_to

# The unit by the span it is used above, in days, hours, minutes or seconds.
UNITS = (
    ("years", 5 * 365 * 86400.0), ("half_year", 800 * 86400.0), ("months", 180 * 86400.0), ("months_fortnight", 90 * 86400.0), ("months_days", 60 * 86400.0), ("week_days", 30 * 86400.0),
    ("days", 2 * 86400.0), ("hours", 2.4 * 3600), ("minutes_fives", 15 * 60.0), ("minutes", 5 * 60.0), ("seconds_tens", 60.0), ("seconds_fives", 20.0),
)
#: What a unit truncates to; the rest of it comes in steps of its own, see ``truncated``.
TRUNCATED = {"years": "year", "months": "month", "months_days": "day", "week_days": "day", "days": "day", "hours": "hour", "minutes": "minute", "seconds": "second"}
# Tick sizes in milliseconds from 1 ms to 100 years.
INCREMENTS = (
    1, 2, 5, 10, 20, 25, 50, 100, 200, 250, 500,
    1_000, 5_000, 10_000, 15_000, 30_000,
    60_000, 300_000, 600_000, 900_000, 1_800_000,
    3_600_000, 7_200_000, 10_800_000, 14_400_000, 21_600_000, 28_800_000, 43_200_000,
    86_400_000, 172_800_000, 259_200_000, 345_600_000, 432_000_000, 518_400_000, 604_800_000, 691_200_000, 777_600_000, 864_000_000, 1_296_000_000,
    2_592_000_000, 5_184_000_000, 7_776_000_000, 10_368_000_000, 15_552_000_000,
    31_536_000_000, 63_072_000_000, 157_680_000_000, 315_360_000_000, 788_400_000_000, 1_576_800_000_000, 3_153_600_000_000,
)
# Steps of a time axis (size, unit), and the length of a unit in seconds.
STEPS = (
    (1, "second"), (2, "second"), (5, "second"), (10, "second"), (30, "second"), (1, "minute"), (2, "minute"), (5, "minute"), (10, "minute"), (30, "minute"),
    (1, "hour"), (2, "hour"), (4, "hour"), (8, "hour"), (12, "hour"), (1, "day"), (2, "day"), (3, "day"), (0.25, "month"), (0.5, "month"), (1, "month"), (2, "month"),
)
MONTHS, QUARTERS = ((3, "month"), (6, "month"), (1, "year")), ((1, "quarter"), (2, "quarter"), (1, "year"))
LENGTHS = {"second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0, "month": 30 * 86400.0, "quarter": 90 * 86400.0, "year": 365.2425 * 86400.0}


def unit_of(span_seconds: Column) -> Column:
    """The unit for a span."""
    out = F.lit("seconds")
    for name, above in reversed(UNITS):
        out = F.when(span_seconds > above, F.lit(name)).otherwise(out)
    return out


def truncated(at: Column, unit: Column) -> Column:
    """``at`` truncated to the unit, without zone."""
    out = truncated_to(at, "second")
    for name, part in TRUNCATED.items():
        out = F.when(unit == name, truncated_to(at, part)).otherwise(out)
    year, month, minute = (truncated_to(at, p) for p in ("year", "month", "minute"))
    half = F.make_timestamp_ntz(F.year(at), F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    out = F.when(unit == "half_year", F.when(F.month(at) > 6, half).otherwise(year)).otherwise(out)
    out = F.when(unit == "months_fortnight", F.when(F.dayofmonth(at) > 14, plus(month, days=F.lit(14))).otherwise(month)).otherwise(out)
    out = F.when(unit == "minutes_fives", plus(minute, seconds=-60 * (F.minute(at) % 5))).otherwise(out)
    for name, n in (("seconds_tens", 10), ("seconds_fives", 5)):
        second = F.second(at)
        out = F.when(unit == name, plus(minute, seconds=second - second % n)).otherwise(out)
    return out


def chosen_step(span_seconds: Column, ticks: float, quarters: bool = False) -> Column:
    """(size, unit) of the steps for about ``ticks`` ticks over a span: the first step whose
    mean with the next one is above the distance asked for; beyond, the one of 1, 2, 5 and 10
    times a power of ten years that is nearest to it."""
    spec = STEPS + (QUARTERS if quarters else MONTHS)
    length = [n * LENGTHS[u] for n, u in spec]
    delta = span_seconds / F.lit(float(ticks))
    pick = lambda n, u: F.struct(n.cast("double").alias("size"), F.lit(u).alias("unit"))
    years = delta / F.lit(LENGTHS["year"])
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.nullif(years, F.lit(0.0)))))
    part = years / power
    out = pick(F.greatest(F.lit(1.0), F.when(part < 1.5, power).when(part < 3, power * 2).when(part < 7.5, power * 5).otherwise(power * 10)), "year")
    for i in range(len(spec) - 2, -1, -1):
        out = F.when(delta < (length[i] + length[i + 1]) / 2, pick(F.lit(spec[i][0]), spec[i][1])).otherwise(out)
    return out


def least_increment(span_seconds: Column, steps: int) -> Column:
    """The least tick size of the catalogue, in milliseconds, that gives at most so many steps over a span; null beyond it."""
    needed, first = span_seconds * 1000, F
    for ms in INCREMENTS:
        first = first.when(needed <= float(ms) * steps, F.lit(ms).cast("long"))
    return first


def calendar_ticks(ends: DataFrame, low: str, high: str, step: str) -> DataFrame:
    """(…, tick): ticks from the one at or before ``low`` to ``high``; one step for all rows, such as '3 months' or '1 day'."""
    n, unit = step.split()
    stepped = stepped_ticks(ends.withColumns({"_size": F.lit(float(n)), "_unit": F.lit(unit.rstrip("s"))}), low, high, "_size", "_unit")
    return stepped.drop("_size", "_unit")


def stepped_ticks(ends: DataFrame, low: str, high: str, size: str, unit: str) -> DataFrame:
    """(…, tick): ticks from the one at or before ``low`` to ``high``, by each row's own step, as
    ``chosen_step`` gives it: ``size`` a column of numbers, ``unit`` of names.

    The first tick is ``low`` floored: seconds, minutes and hours to a multiple of the size
    within their larger unit, days to midnight, months, quarters and years to a multiple of
    the size; steps of four days or more begin with a month, of two months with a quarter, of
    half a year with a half of the year, of a year with the year. A size below 1 (of
    a month or a quarter) divides each into parts of whole days.
    """
    at, n, what = F.col(low), F.col(size), F.col(unit)
    whole = F.greatest(n, F.lit(1.0)).cast("int")
    floored = lambda part: (F.floor(part / whole) * whole).cast("int")
    day, minute = truncated_to(at, "day"), truncated_to(at, "minute")
    seconds = n * F.element_at(F.create_map(*[F.lit(x) for u in ("second", "minute", "hour", "day") for x in (u, LENGTHS[u])]), what)
    clock = F.when(what == "second", plus(minute, seconds=floored(F.second(at)))).when(what == "minute", plus(truncated_to(at, "hour"), seconds=60 * floored(F.minute(at)))).when(what == "hour", plus(day, seconds=3600 * floored(F.hour(at)))).otherwise(day)
    clock = F.when((what == "day") & (n >= 4), truncated_to(at, "month")).otherwise(clock)
    months = F.when(what == "quarter", n * 3).when(what == "year", n * 12).otherwise(n)
    # the month, counted from the year 0, that the first step begins with
    month = F.month(at) - 1
    begun = F.when(months < 2, floored(month)).when(what == "month", F.floor(floored(month) / 3) * 3).otherwise(F.floor(month / 3 / whole) * 3 * whole)
    begun = F.when(what == "year", F.lit(0)).when(months >= 6, F.floor(begun / 6) * 6).otherwise(begun)
    year = F.when(what == "year", floored(F.year(at))).otherwise(F.year(at))
    first = year * 12 + begun
    by_clock = what.isin("second", "minute", "hour", "day")
    keep = [c for c in ends.columns if c not in (low, high)]
    held = ends.select(*keep, F.col(high).alias("_high"), clock.alias("_clock"), seconds.alias("_seconds"), months.alias("_months"), first.alias("_first"), by_clock.alias("_by_clock"))
    ahead = (epoch_micros(F.col("_high")) - epoch_micros(F.col("_clock"))) / (F.col("_seconds") * 1_000_000)
    last_month = F.year("_high") * 12 + F.month("_high") - 1
    held = held.withColumn("_count", F.when(F.col("_by_clock"), F.floor(ahead)).otherwise(F.floor((last_month - F.col("_first") + 1) / F.col("_months"))))
    k = F.col("_k")
    ticks = held.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("_count", F.lit(0)).cast("long"))))
    # a part of a month or quarter: its month by whole months, then days of it
    span = F.greatest("_months", F.lit(1.0))
    span = F.when(what == "quarter", F.greatest(F.lit(3.0), F.col("_months"))).otherwise(span)
    parts = F.round(span / F.col("_months")).cast("long")
    at_month = F.col("_first") + F.floor(k / parts) * span
    begin = lambda m: F.make_date(F.floor(m / 12).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"), F.lit(1))
    length = F.date_diff(begin(at_month + span), begin(at_month))
    into = F.floor(F.round(F.pmod(k, parts) * length / parts, 6)).cast("int")
    by_month = day_start(F.date_add(begin(at_month), into))
    tick = F.when(F.col("_by_clock"), plus(F.col("_clock"), F.floor(k * F.col("_seconds") / 86400), k * F.col("_seconds") - F.floor(k * F.col("_seconds") / 86400) * 86400)).otherwise(by_month)
    told = ticks.select(*keep, F.explode(F.array(tick)).alias("tick"), "_high")  # a generator's column is worked out once
    return told.where(F.col("tick") <= F.col("_high")).drop("_high")


def nice_step(span: Column, ticks: int) -> Column:
    """The least of 1, 2, 5 and 10 times a power of ten that gives at most ``ticks`` steps."""
    raw = F.nullif(span, F.lit(0.0)) / F.lit(float(ticks))
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = F.round(raw / power, 9)
    return F.coalesce(F.when(part <= 1, power).when(part <= 2, power * 2).when(part <= 5, power * 5).otherwise(power * 10), F.lit(1.0))


def nice_scale(ranges: DataFrame, low: str, high: str, ticks: int = 10) -> DataFrame:
    """``ranges`` with step, nice_min, nice_max and n_ticks."""
    step = ranges.withColumn("step", nice_step(F.col(high) - F.col(low), ticks))
    ends = step.withColumn("nice_min", F.floor(F.col(low) / F.col("step")) * F.col("step")).withColumn("nice_max", F.ceil(F.col(high) / F.col("step")) * F.col("step"))
    return ends.withColumn("n_ticks", (F.round((F.col("nice_max") - F.col("nice_min")) / F.col("step")) + 1).cast("long"))


def linear_ticks(ranges: DataFrame, low: str, high: str, n: int) -> DataFrame:
    """(…, i, tick): n + 1 evenly spaced ticks."""
    keep = [c for c in ranges.columns if c not in (low, high)]
    return ranges.select(*keep, low, high, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i")).select(*keep, F.col("i").cast("long").alias("i"), (F.col(low) + (F.col(high) - F.col(low)) * F.col("i") / F.lit(float(n))).alias("tick"))


def log_ticks(ranges: DataFrame, low: str, high: str, base: float = 10.0) -> DataFrame:
    """(…, tick): powers of the base from the one below ``low`` to the one above ``high``."""
    lg = lambda c: F.round(F.ln(F.col(c)) / F.lit(math.log(base)), 9)
    keep = [c for c in ranges.columns if c not in (low, high)]
    powers = F.sequence(F.floor(lg(low)).cast("int"), F.ceil(lg(high)).cast("int"))
    return ranges.select(*keep, F.explode(powers).alias("power")).select(*keep, F.col("power").cast("long").alias("power"), F.pow(F.lit(base), F.col("power")).alias("tick"))


def log_spaced(ranges: DataFrame, low: str, high: str, base: float = 10.0) -> DataFrame:
    """(…, i, tick): ticks evenly spaced in the logarithm from ``low`` to ``high`` exactly, as
    many as there are powers of the base between them, and one more at the end."""
    lg = lambda c: F.ln(c) / F.lit(math.log(base))
    keep = [c for c in ranges.columns if c not in (low, high)]
    top = F.when(F.col(high) > 0, F.col(high)).otherwise(F.greatest(F.col(low), F.lit(base)))
    bottom = F.when(F.col(low) > 0, F.col(low)).otherwise(F.least(top, F.lit(base)))
    held = ranges.select(*keep, lg(bottom).alias("_a"), lg(top).alias("_b")).withColumn("_n", F.floor(F.col("_b") - F.col("_a") + 0.5).cast("int"))
    ticks = held.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = F.when(F.col("i") == F.col("_n"), F.col("_b")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) / F.nullif(F.col("_n"), F.lit(0)) * F.col("i"))
    return ticks.select(*keep, F.col("i").cast("long").alias("i"), F.pow(F.lit(base), at).alias("tick"))


def padded_limits(low: Column, high: Column, pad: float = 0.1, soft_low: float | None = None, soft_high: float | None = None, hard_low: float | None = None, hard_high: float | None = None) -> tuple[Column, Column]:
    """A range padded by a share of its span, rounded outwards to a tenth of the span's
    power of ten, held at a soft limit that the data do not cross, and never beyond a hard one."""
    span = F.when(high > low, high - low).otherwise(F.greatest(F.abs(high), F.lit(1.0)))
    unit = N.whole_power(10, F.floor(F.log10(span))) / 10
    a, b = N.floor((low - span * pad) / unit) * unit, N.ceil((high + span * pad) / unit) * unit
    a = F.when((low >= soft_low) & (a < soft_low), F.lit(soft_low)).otherwise(a) if soft_low is not None else a
    b = F.when((high <= soft_high) & (b > soft_high), F.lit(soft_high)).otherwise(b) if soft_high is not None else b
    a = F.greatest(a, F.lit(float(hard_low))) if hard_low is not None else a
    b = F.least(b, F.lit(float(hard_high))) if hard_high is not None else b
    return a, b


def log_limits(low: Column, high: Column, base: float = 10.0) -> tuple[Column, Column]:
    """A range widened to whole powers of the base; an end of 0 stays 0, a negative one gives NaN."""
    lg = lambda c: F.round(N.ln(c) / F.lit(math.log(base)), 9)
    return N.whole_power(base, N.floor(lg(low))), N.whole_power(base, N.ceil(lg(high)))


def scale_extents(points: DataFrame, scale: str, x: str, y: str, low, high, visible: Column) -> DataFrame:
    """The extent of each scale over its visible series within a window of x."""
    inside = visible & F.col(x).between(F.lit(low), F.lit(high))
    return points.groupBy(scale).agg(F.min(F.when(inside, F.col(y))).alias("y_min"), F.max(F.when(inside, F.col(y))).alias("y_max"))


def derived_scales(extents: DataFrame, rules: dict[str, tuple[str, Callable[[Column, Column], tuple[Column, Column]]]], scale: str = "scale", low: str = "y_min", high: str = "y_max") -> DataFrame:
    """``extents`` and, for each rule name: (from, range), a scale whose ends ``range`` makes of
    another's, which may itself be derived. A scale whose source is absent is absent too.

    Rules are put in the order in which they depend on each other; a ring is refused. What
    derives from one scale is put out beside its row, so ``extents`` is evaluated once.
    """
    known: dict[str, tuple[str, list[str]]] = {}  # the scale at the root, and the rules that lead from it

    def chain(name: str, seen: tuple[str, ...] = ()) -> tuple[str, list[str]]:
        if name in seen:
            raise ValueError(f"scales derive from each other: {' from '.join((*seen, name))}")
        if name not in rules:
            return name, []
        if name not in known:
            root, path = chain(rules[name][0], (*seen, name))
            known[name] = root, [*path, name]
        return known[name]

    keep = [c for c in extents.columns if c not in (scale, low, high)]
    ends = lambda name, a, b: F.struct(F.lit(name).alias(scale) if isinstance(name, str) else name.alias(scale), a.cast("double").alias(low), b.cast("double").alias(high))
    every = [ends(F.col(scale), F.col(low), F.col(high))]
    for name in rules:
        root, path = chain(name)
        a, b = F.col(low).cast("double"), F.col(high).cast("double")
        for step in path:
            a, b = rules[step][1](a, b)
        every.append(F.when(F.col(scale) == root, ends(name, a, b)))
    told = extents.where(~F.col(scale).isin(*rules)) if rules else extents
    return told.select(*keep, F.explode(F.array_compact(F.array(*every))).alias("_s")).select(*keep, "_s.*")
