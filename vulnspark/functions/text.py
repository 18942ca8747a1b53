"""Text, array and number helpers written as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once.

    Without it an expression that uses a derived value several times repeats
    its whole tree, and nested uses grow the plan exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank(c: Column | str) -> Column:
    """Null as the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def present(c: Column | str) -> Column:
    """True when the text is neither null nor empty; never null itself."""
    return blank(c) != ""


def empty_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def null_like(c: Column | str) -> Column:
    """The text ``null`` and the empty string both mean missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~c.isin("null", ""), c)


def null_like_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: null_like(c) for c in columns if c in df.columns})


def unescape_path(c: Column | str) -> Column:
    """Halve doubled backslashes left by one JSON encoding too many."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(c, F.lit("\\\\"), F.lit("\\"))


def base_name(c: Column | str) -> Column:
    """The last path segment, for either separator."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"^.*[\\/]", "")


def glob_match(c: Column | str, pattern: str) -> Column:
    """Case-insensitive match of a ``*`` pattern; ``*`` alone keeps every row."""
    c = F.col(c) if isinstance(c, str) else c
    if pattern == "*":
        return F.lit(True)
    if "*" not in pattern:
        return F.lower(c) == pattern.lower()
    body = ".*".join(re.escape(p) for p in pattern.split("*"))
    return c.rlike(f"(?is)^{body}$")


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A capture group, or null where the pattern does not match."""
    c = F.col(c) if isinstance(c, str) else c
    got = F.regexp_extract(c, pattern, group)
    return F.when(got != "", got)


def try_double(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("double")


def try_long(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("bigint")


def md5_prefix_number(c: Column, digits: int) -> Column:
    """The first hex digits of an md5 as a number."""
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("bigint")


def package_from_purl(c: Column | str) -> Column:
    """The package a purl, or a plain ``Name@Version``, names.

    The namespace is dropped for deb, rpm and apk, where it is the
    distribution, and kept elsewhere, where it is part of the name.
    """
    # Plain text functions on values made once, as this runs on every row of an inventory; patterns only where those cannot do.
    end = F.lit(2**31 - 1)

    def parsed(c: Column) -> Column:
        return let(F.substring(c, F.lit(5), end), lambda rest: let(named(c, rest), decoded))

    def named(c: Column, rest: Column) -> Column:
        slash, query = F.instr(rest, "/"), F.instr(rest, "?")
        tail = F.when((slash > 1) & ((query == 0) | (query > slash)), F.substring(rest, slash + 1, end)).otherwise(rest)
        tail = F.when(query > 0, F.regexp_replace(tail, r"\?.*$", "")).otherwise(tail)
        name = F.substring_index(F.when(c.startswith("pkg:"), tail).otherwise(c), "@", 1)
        kind = F.substring_index(F.substring_index(rest, "/", 1), "?", 1)
        distribution = c.startswith("pkg:") & kind.isin("deb", "rpm", "apk")
        return F.when(distribution, F.substring_index(name, "/", -1)).otherwise(name)

    def decoded(name: Column) -> Column:
        return F.when(F.contains(name, F.lit("%")), F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)

    return let(F.col(c) if isinstance(c, str) else c, parsed)


def duration_text(seconds: Column) -> Column:
    """Seconds as ``[D+]HH:MM:SS``."""
    s = seconds.cast("bigint")
    days = F.floor(s / 86400)
    clock = F.format_string(
        "%02d:%02d:%02d",
        F.floor(s % 86400 / 3600),
        F.floor(s % 3600 / 60),
        s % 60,
    )
    return F.when(days > 0, F.concat(days.cast("string"), F.lit("+"), clock)).otherwise(clock)


def commas(c: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(c.cast("bigint"), 0)


def stamp_text(epoch: Column, fmt: str = "yyyy-MM-dd HH:mm") -> Column:
    """Epoch seconds as UTC text, whatever the session's time zone."""
    zero = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.date_format(F.timestamp_add("SECOND", epoch.cast("bigint"), zero), fmt)


def day_epoch(c: Column | str) -> Column:
    """Epoch seconds at the UTC start of an ISO date text, null when it is not one."""
    return F.unix_date(F.try_to_date(empty_to_null(c), "yyyy-MM-dd")).cast("bigint") * 86400


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share of a total, null when the total is zero."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def age_days(epoch: Column, now: int, digits: int = 1) -> Column:
    return F.round((F.lit(now) - epoch) / 86400.0, digits)
