"""Text of times, sizes and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlake.functions.geometry import fixed, jround


def clock(seconds: Column) -> Column:
    """m:ss"""
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad(F.floor(seconds % 60).cast("string"), 2, "0"))


def file_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(fixed(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(fixed(n / (1024 * 1024), 1), F.lit(" MB")))


def eta(done: Column, total: Column, elapsed_s: Column) -> Column:
    rate = F.try_divide(done.cast("double"), elapsed_s)
    left = F.try_divide((total - done).cast("double"), rate)
    return F.when(F.coalesce(rate, F.lit(0.0)) == 0, "--").when(left < 60, F.concat(F.ceil(left).cast("string"), F.lit("s"))).otherwise(F.concat(F.ceil(left / 60).cast("string"), F.lit("m")))


def likely_duration(n_bytes: Column) -> Column:
    """About one megabyte a minute, from a minute to an hour and a half."""
    return F.greatest(F.lit(60.0), F.least(F.lit(5400.0), jround(n_bytes / (1024 * 1024) * 60, 0)))


def percent_value(text: Column) -> Column:
    """The number that a text such as 55% starts with."""
    return F.regexp_extract(text, r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1).cast("double")


def upload_percent(done: Column, total: Column) -> Column:
    return jround(F.try_divide(done * 100.0, total), 0).cast("long")


def plain_number(x: Column) -> Column:
    """A number with one decimal at most, whole ones without."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.format_string("%.1f", x))


def file_stem(title: Column) -> Column:
    return F.regexp_replace(title, r"\s+", "_")


def short_error(text: Column) -> Column:
    return F.left(text, F.lit(200))


def long_date(ts: Column) -> Column:
    return F.date_format(ts, "EEEE, d MMMM yyyy")


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM yyyy")


def link_until(at: Column, hours: int = 1) -> Column:
    """When a link that is signed at a time ends, in milliseconds of the epoch; null if there is no time."""
    return F.unix_millis(at) + F.lit(hours * 3_600_000)
