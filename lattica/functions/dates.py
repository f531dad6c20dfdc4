"""Date columns: patterns of three formats, parts, epochs and presets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(at: Column) -> Column:
    """Microseconds from 1970 to a time without zone, whatever the session's zone is."""
    day = F.unix_date(at.cast("date")).cast("long") * 86_400_000_000
    return day + F.hour(at).cast("long") * 3_600_000_000 + F.minute(at).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def from_micros(us: Column) -> Column:
    """The time without zone so many microseconds after 1970."""
    day = F.floor(us / F.lit(86_400_000_000).cast("decimal(20,0)")).cast("long")
    rest = ((us - day * 86_400_000_000).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(day.cast("int"), F.lit(0), F.lit(0), rest)


def plus(at: Column, days: Column | None = None, seconds: Column | None = None) -> Column:
    """``at`` and so many days and seconds later, without zone."""
    zero = F.lit(0)
    return at + F.make_dt_interval(zero if days is None else days.cast("int"), zero, zero, (zero if seconds is None else seconds).cast("decimal(18,6)"))


def day_start(day: Column) -> Column:
    """The midnight that a date begins with, as a time without zone."""
    return day.cast("timestamp_ntz")


def truncated_to(at: Column, part: str) -> Column:
    """``at`` truncated to second, minute, hour, day, month, quarter or year, without zone."""
    if part in ("second", "minute", "hour"):
        parts = [F.year(at), F.month(at), F.dayofmonth(at), F.hour(at), F.lit(0) if part == "hour" else F.minute(at), F.second(at) if part == "second" else F.lit(0)]
        return F.make_timestamp_ntz(*parts)
    day = at.cast("date")
    return day_start(day if part == "day" else F.trunc(day, part))


def in_zone(at: Column, zone: str | Column) -> Column:
    """What a clock of ``zone`` shows at a time without zone that is meant as UTC."""
    return F.convert_timezone(F.lit("UTC"), zone if isinstance(zone, Column) else F.lit(zone), at)


def out_of_zone(at: Column, zone: str | Column) -> Column:
    """UTC from what a clock of ``zone`` shows; an hour that a clock skips counts as the one after
    it, one that it shows twice as the first."""
    return F.convert_timezone(zone if isinstance(zone, Column) else F.lit(zone), F.lit("UTC"), at)


def zone_offset(utc: Column, zone: str | Column | None) -> Column:
    """The offset of ``zone`` at a UTC time as text: Z, +01:00 or -03:30."""
    if zone is None:
        return F.lit("Z")
    minutes = F.floor((epoch_micros(in_zone(utc, zone)) - epoch_micros(utc)) / 60_000_000)
    size = F.abs(minutes)
    two = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
    return F.when(minutes == 0, "Z").otherwise(F.concat(F.when(minutes > 0, "+").otherwise("-"), two(size / 60), F.lit(":"), two(size % 60)))


def _f(at: Column, pattern: str) -> Column:
    """A pattern of date parts; a date has them in every zone of the session."""
    return F.date_format(at.cast("date"), pattern)


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _millis(at: Column) -> Column:
    return F.pmod(F.floor(F.extract(F.lit("SECOND"), at) * 1000), F.lit(1000)).cast("int")


def _hour12(at: Column) -> Column:
    return (F.pmod(F.hour(at) + 11, F.lit(12)) + 1).cast("string")


def _half(at: Column) -> Column:
    return F.when(F.hour(at) < 12, "am").otherwise("pm")


# The letters of the three kinds of patterns.
#: Parts of ``strftime`` patterns; %p is lower case and %P upper case, %q the quarter, %w the weekday from Sunday, 0.
STRFTIME = {
    "a": lambda t: _f(t, "EEE"), "b": lambda t: _f(t, "MMM"), "d": lambda t: _f(t, "dd"), "e": lambda t: F.lpad(F.dayofmonth(t).cast("string"), 2, " "),
    "H": lambda t: _two(F.hour(t)), "I": lambda t: F.lpad(_hour12(t), 2, "0"), "l": lambda t: F.lpad(_hour12(t), 2, " "), "m": lambda t: _f(t, "MM"), "M": lambda t: _two(F.minute(t)),
    "q": lambda t: F.quarter(t).cast("string"), "S": lambda t: _two(F.second(t)), "y": lambda t: _f(t, "yy"), "Y": lambda t: _f(t, "yyyy"),
    "p": _half, "P": lambda t: F.upper(_half(t)), "w": lambda t: (F.dayofweek(t) - 1).cast("string"),
}
#: Parts of brace templates such as {YYYY}-{MM}-{DD} {h}:{mm}{aa}.
BRACES = {
    "YYYY": STRFTIME["Y"], "YY": STRFTIME["y"], "MMMM": lambda t: _f(t, "MMMM"), "MMM": STRFTIME["b"], "MM": STRFTIME["m"], "M": lambda t: F.month(t).cast("string"),
    "DD": STRFTIME["d"], "D": lambda t: F.dayofmonth(t).cast("string"), "WWWW": lambda t: _f(t, "EEEE"), "WWW": STRFTIME["a"], "HH": STRFTIME["H"], "H": lambda t: F.hour(t).cast("string"),
    "h": _hour12, "AA": STRFTIME["P"], "aa": _half, "mm": STRFTIME["M"], "m": lambda t: F.minute(t).cast("string"), "ss": STRFTIME["S"], "s": lambda t: F.second(t).cast("string"), "fff": lambda t: F.lpad(_millis(t).cast("string"), 3, "0"),
}
#: Parts of token patterns such as yyyy-MM-dd HH:mm:ss.fff TT K; one letter is the number without a leading zero.
TOKENS = {
    "yyyy": STRFTIME["Y"], "yy": STRFTIME["y"], "y": STRFTIME["Y"], "MMMM": BRACES["MMMM"], "MMM": STRFTIME["b"], "MM": STRFTIME["m"], "M": BRACES["M"], "dddd": BRACES["WWWW"], "ddd": STRFTIME["a"], "dd": STRFTIME["d"], "d": BRACES["D"],
    "HH": STRFTIME["H"], "H": BRACES["H"], "hh": STRFTIME["I"], "h": _hour12, "mm": STRFTIME["M"], "m": BRACES["m"], "ss": STRFTIME["S"], "s": BRACES["s"], "fff": BRACES["fff"], "ff": lambda t: _two(F.round(_millis(t) / 10).cast("int")), "f": lambda t: F.round(F.round(_millis(t) / 10) / 10).cast("int").cast("string"),
    "TT": STRFTIME["P"], "T": lambda t: F.substring(F.upper(_half(t)), 1, 1), "tt": _half, "t": lambda t: F.substring(_half(t), 1, 1),
}


def _parts(at: Column, text: str, regex: str, parts: dict) -> Column:
    pieces, end = [], 0
    for m in re.finditer(regex, text):
        pieces += [F.lit(text[end : m.start()]), parts[m[1]](at)]
        end = m.end()
    return F.concat(*pieces, F.lit(text[end:]))


def strftime(at: Column, text: str) -> Column:
    return _parts(at, text, "%([" + "".join(STRFTIME) + "])", STRFTIME)


def template(at: Column, text: str) -> Column:
    return _parts(at, text, r"\{(" + "|".join(sorted(BRACES, key=len, reverse=True)) + r")\}", BRACES)


def token_format(at: Column, text: str, zone: str | Column | None = None) -> Column:
    """``at``, a time without zone meant as UTC, by tokens, as a clock of ``zone`` shows it; ``K`` is
    the zone's offset then, and a letter behind a backslash is meant as it is."""
    parts = {**TOKENS, "K": lambda t: zone_offset(at, zone)}
    pieces, end, shown = [], 0, at if zone is None else in_zone(at, zone)
    for m in re.finditer(r"\\(.)|(" + "|".join(sorted(parts, key=len, reverse=True)) + ")", text):
        pieces += [F.lit(text[end : m.start()]), F.lit(m[1]) if m[1] else parts[m[2]](shown)]
        end = m.end()
    return F.concat(*pieces, F.lit(text[end:]))


def leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_in_year(at: Column) -> Column:
    return F.when(leap_year(F.year(at)), 366).otherwise(365)


def from_epoch(n: Column, unit: str) -> Column:
    """A timestamp without zone from seconds, milliseconds or microseconds, clamped to 100 million days
    on either side of 1970 (years beyond 9999 stay in Spark: Python's dates end there)."""
    per = {"seconds": 1, "milliseconds": 1000, "microseconds": 1_000_000}[unit]
    most = 8_640_000_000_000 * per
    held = F.least(F.greatest(n, F.lit(-most)), F.lit(most))
    return from_micros(held * F.lit(1_000_000 // per))


def clamped_range(begins: Column, ends: Column, least: Column, most: Column) -> tuple[Column, Column]:
    """A chosen range moved into the allowed one: each end that lies outside becomes the nearer bound."""
    held = lambda at: F.least(F.greatest(at, least), most)
    return held(begins), held(ends)


def presets(today: Column) -> dict[str, tuple[Column, Column]]:
    """Named date ranges, both ends included."""
    month = F.trunc(today, "month")
    return {
        "today": (today, today),
        "yesterday": (F.date_sub(today, 1), F.date_sub(today, 1)),
        "last 7 days": (F.date_sub(today, 6), today),
        "last 30 days": (F.date_sub(today, 29), today),
        "this month": (month, F.last_day(today)),
        "last month": (F.add_months(month, -1), F.date_sub(month, 1)),
    }
