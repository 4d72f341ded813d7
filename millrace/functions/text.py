"""String helpers shared by all operators. Everything is a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the characters str.strip() and str.split() treat as white space.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
          "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
SPACE = f"[{SPACES}]"


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends (one-argument SQL ``trim`` removes blanks only)."""
    return F.trim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def between(c: Column, opening: str, closing: str) -> Column:
    """Text between the first ``opening`` and the first ``closing`` after it; null without both."""
    start = F.instr(c, opening)
    body = start + F.lit(len(opening))
    end = F.position(F.lit(closing), c, body)
    return F.when((start > 0) & (end > 0), F.substring(c, body, end - body))


def after_last(c: Column, marker: str) -> Column:
    """Text after the last ``marker``, or all of it when the marker is absent."""
    return F.substring_index(c, marker, -1)


def before_first(c: Column, marker: str) -> Column:
    return F.substring_index(c, marker, 1)


def count_of(c: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def find(pattern: str, c: Column, group: int = 0) -> Column:
    """Regex search giving null without a match, for patterns whose group is never empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def find_any(pattern: str, c: Column, group: int = 0) -> Column:
    """As ``find`` for patterns whose group may be empty."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def last_match(pattern: str, c: Column, group: int = 0) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def hash60(*parts: Column) -> Column:
    """Repeatable 60-bit hash of a key: the seeded replacement for random draws."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("bigint")


def starts_of(sizes: Column, block: int = 256) -> Column:
    """Where each part starts, from the sizes of all parts in order. Sums run within blocks and over block totals, so that
    the cost per part doesn't grow with their number as it does for one growing array."""
    def running(base: Column, part: Column) -> Column:
        start = F.struct(base.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                           lambda acc: acc["out"])

    def blocks(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(running(F.lit(0), totals), parts, running))

    last = F.greatest(F.floor((F.size(sizes) - 1) / block).cast("int"), F.lit(0))
    return let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(sizes, b * block + 1, F.lit(block))), blocks)


def instant(df: DataFrame, ts: str) -> Column:
    """A log time as a timestamp; one without zone is read as UTC whatever the session zone."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.concat(F.col(ts).cast("string"), F.lit("Z")).cast("timestamp")
    return F.col(ts).cast("timestamp")


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` for costly expressions that later filters and projections use.

    The optimizer copies a plain alias into every later use; it does not look through a generator, so
    passing the value through a one-element ``inline`` keeps it to one evaluation per row.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
