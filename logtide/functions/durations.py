"""Durations and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros_between(a: Column, b: Column) -> Column:
    """Microseconds from a to b, times without a zone."""
    return F.timestamp_diff("MICROSECOND", a, b)


def hours(micros: Column) -> Column:
    """HH:MM:SS of the absolute duration; hours may pass 24."""
    s = F.abs(micros).cast("bigint")
    s = F.floor(s / F.lit(1_000_000)).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), (s % 60).cast("bigint"))


def human(micros: Column) -> Column:
    """Days, hours, minutes and seconds that aren't zero; null for a negative duration."""
    s = F.floor(micros / F.lit(1_000_000)).cast("bigint")
    parts = [(F.floor(s / 86400), "d"), (F.floor(s % 86400 / 3600), "h"), (F.floor(s % 3600 / 60), "m"), (s % 60, "s")]
    text = F.concat_ws(" ", *[F.when(n > 0, F.concat(n.cast("bigint").cast("string"), F.lit(u))) for n, u in parts])
    return F.when(micros >= 0, F.when(text == "", F.lit("0s")).otherwise(text))


def seconds_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def z_score(gap_ms: Column, mean: Column, std: Column) -> Column:
    """Standard deviations above the mean; where the deviation is 0, without end, or not a number for the mean itself."""
    off = gap_ms.cast("double") - mean
    return F.when(std == 0, F.when(off == 0, F.lit(float("nan"))).otherwise(F.signum(off) * float("inf"))).otherwise(F.try_divide(off, std))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
