"""Timestamps in text: find, change, parse. All of it is Spark expressions.

Times carry no zone: an offset behind them is ignored and the type is TIMESTAMP_NTZ.
The session's time zone must be UTC, as session() sets it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TimestampFormat

#: strftime directive -> Spark's pattern
_DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "H": "HH", "k": "H", "I": "h", "l": "h", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "f": "SSSSSS", ".f": "[.SSSSSS]", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "R": "HH:mm", "%": "'%'"}


def spark_pattern(strftime: str) -> str:
    """The datetime pattern that reads what ``strftime`` describes."""
    out, k = [], 0
    while k < len(strftime):
        c = strftime[k]
        if c == "%":
            d = strftime[k + 1 : k + 3] if strftime[k + 1 : k + 2] == "." else strftime[k + 1 : k + 2]
            if d not in _DIRECTIVES:
                raise ValueError(f"no such directive: %{d}")
            out.append(_DIRECTIVES[d])
            k += 1 + len(d)
        else:
            out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
            k += 1
    return "".join(out).replace("''", "") if "'" not in strftime else "".join(out)


CHANGES: dict[str, Callable[[Column], Column]] = {
    "first_ten_digits": lambda s: F.substring(s, 1, 10),
    "year_1970": lambda s: F.concat(F.lit("1970 "), s),
}


def found(text: Column, fmt: TimestampFormat) -> Column:
    """Does the text hold the format anywhere? (Whether it can be parsed is another matter.)"""
    return text.rlike(f"({fmt.regex})")


def parsed(match: Column, fmt: TimestampFormat) -> Column:
    """The matched text as a time; null if it can't be."""
    s = CHANGES[fmt.change](match) if fmt.change else match
    if fmt.strftime == "%s":
        return F.timestamp_add("SECOND", F.expr("0") + s.try_cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    tight = F.regexp_replace(s, r"\s+", " ")
    pattern = spark_pattern(fmt.strftime).replace("HH", "H").replace("dd", "d") if fmt.strftime.startswith("%b") else spark_pattern(fmt.strftime)
    return F.try_to_timestamp(tight, F.lit(pattern)).cast("timestamp_ntz")


def extracted(text: Column, fmt: TimestampFormat) -> Column:
    """struct(matched, ts): the leftmost match and its time. matched without ts is a parse failure."""
    match = F.regexp_extract(text, f"({fmt.regex})", 0)
    has = F.coalesce(found(text, fmt), F.lit(False))
    return F.struct(has.alias("matched"), F.when(has, parsed(match, fmt)).alias("ts"))


def first_format(text: Column, formats: Sequence[TimestampFormat]) -> Column:
    """Number of the first format that the text holds; null if it holds none."""
    out = F.lit(None).cast("int")
    for k in range(len(formats) - 1, -1, -1):
        out = F.when(found(text, formats[k]), F.lit(k)).otherwise(out)
    return out
