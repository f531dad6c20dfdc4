"""String columns: names, paths, URLs, cleaning and number text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(name: Column) -> Column:
    """Lower case with spaces as hyphens."""
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def type_name(name: Column) -> Column:
    """Lower case with hyphens as underscores."""
    return F.replace(F.lower(name), F.lit("-"), F.lit("_"))


def join_url(base: Column, slug: Column) -> Column:
    """``base/slug`` with the slashes between them reduced to one; null unless both have text."""
    left, right = F.regexp_replace(base, "/+$", ""), F.regexp_replace(slug, "^/+", "")
    return F.when((F.length(left) > 0) & (F.length(right) > 0), F.concat(left, F.lit("/"), right))


def object_url(bucket: Column, key: Column) -> Column:
    """The public address of an object."""
    return F.concat(F.lit("https://"), bucket, F.lit(".s3.amazonaws.com/"), key)


def base_name(key: Column) -> Column:
    return F.regexp_extract(key, "([^/]*)$", 1)


def extension(key: Column) -> Column:
    """With its dot and in lower case; empty if the base name has none."""
    return F.lower(F.regexp_extract(key, "(\\.[^./]*)$", 1))


def clean_key(key: Column) -> Column:
    """A key without spaces around it and slashes before it."""
    return F.regexp_replace(F.trim(key), "^/+", "")


def token(*parts: Column, length: int = 8) -> Column:
    """A fixed stand-in for a random suffix: the first hex digits of a hash of ``parts``."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, length)


def auto_name(prefix: str, at: Column, *parts: Column) -> Column:
    """``prefix_yyyymmddhhmmss_suffix``."""
    from .dates import strftime

    return F.concat(F.lit(f"{prefix}_"), strftime(at.cast("timestamp_ntz"), "%Y%m%d%H%M%S"), F.lit("_"), token(*parts, length=6))


def slug_or_token(slug: Column, *parts: Column) -> Column:
    """The slug given, or a token where it is empty."""
    return F.coalesce(F.nullif(slug, F.lit("")), token(*parts))


def resized_path(path: Column) -> Column:
    return F.replace(path, F.lit(".jpg"), F.lit("_resized.jpg"))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


# The entities that exports decode.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain_text(html: Column) -> Column:
    """Without scripts, comments and tags, trimmed, in one line, entities decoded."""
    out = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>", "")
    out = F.regexp_replace(out, "(?s)<!--.*?-->", "")
    out = F.regexp_replace(strip_tags(out), "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", "")
    out = F.replace(out, F.lit("\n"), F.lit(" "))
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def leading_number(text: Column) -> Column:
    """The number that a text begins with, as a double; null if there is none."""
    found = F.regexp_extract(text, "^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that it uses several times and that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def plain_number(value: Column) -> Column:
    """A number's whole text without an exponent and without trailing zeros, whatever its size."""
    bare = lambda number: F.regexp_replace(number, "^(-?)0*(?=[0-9])|\\.0*$|(\\.[0-9]*?[1-9])0+$", "$1$2")

    def moved(s: Column) -> Column:
        """The digits with the point moved by the power; zeros fill up to it, and before it."""
        whole = F.concat(F.repeat(F.lit("0"), 1 - s["point"]), F.rpad(s["digits"], F.greatest(s["point"], F.length(s["digits"])), F.lit("0")))
        at = F.greatest(s["point"], F.lit(1))
        return _once(whole, lambda w: F.concat(s["sign"], F.substring(w, F.lit(1), at), F.lit("."), F.substring(w, at + 1, F.length(w))))

    def told(text: Column) -> Column:
        sign, mantissa = F.when(text.startswith("-"), "-").otherwise(""), F.ltrim(F.substring_index(F.upper(text), "E", 1), F.lit("-"))
        point = F.length(F.substring_index(mantissa, ".", 1)) + F.substring_index(F.upper(text), "E", -1).cast("int")
        parts = F.struct(sign.alias("sign"), F.replace(mantissa, F.lit("."), F.lit("")).alias("digits"), point.alias("point"))
        plain = F.when(text.rlike("^-?[0-9]+(?:\\.[0-9]+)?$"), bare(text))
        return plain.when(text.rlike("^-?[0-9]+(?:\\.[0-9]+)?[eE][+-]?[0-9]+$"), bare(_once(parts, moved))).otherwise(text)

    return _once(value.cast("string"), told)


def csv_field(value: Column, quote: str = '"') -> Column:
    """Quoted, quotes inside doubled; null as an empty field."""
    return F.concat(F.lit(quote), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit(quote), F.lit(quote * 2)), F.lit(quote))
