"""Small text helpers shared by all operators.

Convention: an absent string is ``""`` (never null); absent numbers and
timestamps are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonblank(c: Column) -> Column:
    """True when the text holds at least one non-space character."""
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def blank(c: Column) -> Column:
    return ~nonblank(c)


def text(c: Column) -> Column:
    """Null-safe text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def first_nonblank(*cols: Column) -> Column:
    """First argument that is not blank, otherwise ``""``."""
    return F.coalesce(*[F.when(nonblank(c), c) for c in cols], F.lit(""))


WHITE_SPACE = " \t\n\r\f\v"


def strip(c: Column) -> Column:
    """Trim every kind of white space on both sides."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE_SPACE))


def decoded(content: Column) -> Column:
    """Text of a file's bytes by its byte order mark; UTF-8 without one, where broken bytes become U+FFFD."""
    mark = F.hex(F.substring(content, 1, 2))
    rest = lambda n: F.substring(content, n, F.greatest(F.length(content), F.lit(1)))
    return (
        F.when(mark == "FFFE", F.decode(rest(3), "UTF-16LE"))
        .when(mark == "FEFF", F.decode(rest(3), "UTF-16BE"))
        .otherwise(F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\uFEFF", "")))


def distinct_ci(values: Column, limit: int | None = None) -> Column:
    """Distinct texts ignoring case, first spelling kept, at most ``limit``.

    The values are folded into a growing list, so their expression runs once.
    """
    def fold(kept: Column, v: Column) -> Column:
        known = F.exists(kept, lambda k: F.lower(k) == F.lower(v))
        if limit is not None:
            known = (F.size(kept) >= limit) | known
        return F.when(known, kept).otherwise(F.concat(kept, F.array(v)))

    return F.aggregate(values, F.array().cast("array<string>"), fold)


def norm(c: Column) -> Column:
    """Trimmed and lower-cased: the key for case-insensitive comparison."""
    return F.lower(strip(text(c)))


def same_text(a: Column, b: Column) -> Column:
    """Case-insensitive equality of two non-blank values."""
    return nonblank(a) & nonblank(b) & (F.lower(a) == F.lower(b))


def contains_ci(haystack: Column, needle: str) -> Column:
    return F.contains(F.lower(haystack), F.lit(needle.lower()))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def contains_any(haystack: Column, needles) -> Column:
    """True when the (already lower-cased) text holds one of the words."""
    return any_of(F.contains(haystack, F.lit(n)) for n in needles)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First regex match as text, ``""`` when there is none."""
    return F.regexp_extract(c, pattern, group)


def lines_of(c: Column) -> Column:
    return F.split(c, "\n")


def joined(arr: Column, sep: str) -> Column:
    return F.array_join(arr, sep)


def hex_sha256(c: Column) -> Column:
    return F.upper(F.sha2(c, 256))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def int_div(c: Column, n: int) -> Column:
    """Integer division for non-negative values."""
    return F.floor(c / F.lit(n)).cast("int")
