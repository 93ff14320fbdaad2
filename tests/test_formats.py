"""Timestamp formats and redaction rules on texts that should and shouldn't match."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logtide.config import REDACTION_RULES, builtin_formats
from logtide.functions import jsonpaths, timestamps
from logtide.functions.patterns import needed
from logtide.operators.redactions import array_hits, hits

NEW_YEAR = dt.datetime(2023, 1, 1, 1)

#: format number -> texts that mean the time beside them
GOOD = {
    0: [("2023-01-01T01:00:00.000000Z", NEW_YEAR), ("2023-01-01T01:00:00.000Z", NEW_YEAR), ("2023-01-01T01:00:00Z", NEW_YEAR)],
    1: [("2023-01-01T01:00:00.000", NEW_YEAR), ("2023-01-01T01:00:00.000-0400", NEW_YEAR), ("2023-01-01T01:00:00.25", NEW_YEAR.replace(microsecond=250_000)), ("2023-01-01T01:00:00", NEW_YEAR)],
    2: [("2023-01-01 01:00:00", NEW_YEAR), ("at 2023-01-01 01:00:00.000001 sharp", NEW_YEAR.replace(microsecond=1))],
    3: [("Jan 1, 2023 1:00:00 AM", NEW_YEAR), ("Jan 1, 2023 12:00:00 PM", NEW_YEAR.replace(hour=12))],
    4: [("Jan 1 2023 01:00:00", NEW_YEAR), ("Jan 1 2023 1:00:00", NEW_YEAR), ("Jan 01 2023 1:00:00", NEW_YEAR)],
    5: [("01/01/2023 01:00:00 AM", NEW_YEAR), ("01/01/2023 1:00:00 AM", NEW_YEAR)],
    6: [("1672534800", NEW_YEAR), ("date:1672534800", NEW_YEAR), ('"ts":1672534800.000000', NEW_YEAR)],
    7: [("1672534800000", NEW_YEAR), ("date:1672534800999", NEW_YEAR)],
    8: [("date=2023-01-01 time=01:00:00", NEW_YEAR), ("date=2023-01-01   time=01:00:00", NEW_YEAR)],
    9: [("Jan 01 01:00:00", NEW_YEAR.replace(year=1970)), ("Jan 1 01:00:00", NEW_YEAR.replace(year=1970)), ("Dec 31 23:59:59", dt.datetime(1970, 12, 31, 23, 59, 59)), ("Aug 14 00:02:05 host unit[1]: done", dt.datetime(1970, 8, 14, 0, 2, 5))],
}
BAD = {0: ["2023-01-01T01:00:00", "2023-01-01 01:00:00.0Z"], 1: ["2023-01-01 01:00:00"], 4: ["Jun 2, 2025 23:47:23"], 5: ["7/20/2025 2:23:45 PM"], 6: ["167253480000"], 7: ["1672534800"], 8: ["date=2023-01-01 time=01:00"], 9: ["Jan 01 2023 00:01:00"]}


def _extract(spark, k, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    x = timestamps.extracted(F.col("s"), builtin_formats()[k])
    return [(r.m, r.ts) for r in df.select("i", x["matched"].alias("m"), x["ts"].alias("ts")).orderBy("i").collect()]


@pytest.mark.parametrize("k", range(10))
def test_good(spark, k):
    assert _extract(spark, k, [t for t, _ in GOOD[k]]) == [(True, ts) for _, ts in GOOD[k]]


@pytest.mark.parametrize("k", sorted(BAD))
def test_bad(spark, k):
    assert _extract(spark, k, BAD[k]) == [(False, None)] * len(BAD[k])


def test_matched_but_not_parsed(spark):
    assert _extract(spark, 2, ["2023-13-01 01:00:00", None]) == [(True, None), (False, None)]
    assert _extract(spark, 9, ["Feb 29 01:00:00"]) == [(True, None)]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("***", {"Asterisks"}),
        ("**", set()),
        ("*masked*", set()),
        ("aXXXXb", {"XXXX"}),
        ("XXX", set()),
        ("<sensitiveDataRemoved>", {"Sensitive Data Removed"}),
        ("is REDACTED now", {"REDACTED"}),
        ("UNREDACTED", set()),
        ("REMOVED FOR SECURITY", {"REMOVED"}),
        ("removed", set()),
        ("DATA MASKED", {"MASKED"}),
        ("[[SENSITIVE]]", {"Custom Square Bracketed Token"}),
        ("Data: BASE64_REDACTED", {"Base64 Placeholder"}),
        ("MYBASE64_REDACTED", set()),
        ("*** REDACTED", {"Asterisks", "REDACTED"}),
        (None, set()),
    ],
)
def test_redaction_rules(spark, text, names):
    df = spark.createDataFrame([(text,)], "s string")
    got = df.select(*[hits([F.col("s")], ((n, p),)).alias(n) for n, p in REDACTION_RULES]).first().asDict()
    assert {n for n, v in got.items() if v} == names


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [
        (r"\*{3,}", "***"),
        (r"\bREMOVED( FOR SECURITY)?\b", "REMOVED"),
        (r"a(?:bc)?def", "def"),
        (r"(ab){2}c", "ababc"),
        (r"a{2,}b", "aa"),
        (r"(a|b)cd", "cd"),
        (r"x[yz]+word\d", "word"),
        # nothing is sure, or Java may read it differently
        (r"one|two", ""),
        (r"(?i)word", ""),
        (r"(word)?", ""),
        (r"word\v", ""),
        (r"\Qa.b\E", ""),
        (r"\b{g}word", ""),
        (r"[a[bc]word]", ""),
        (r"(", ""),
        ("", ""),
    ],
)
def test_needed_literal(pattern, literal):
    assert needed(pattern) == literal


def test_rules_find_what_their_expressions_alone_find(spark):
    rules = (*REDACTION_RULES, ("either", "gone|hidden"), ("any case", "(?i)secret"), ("repeated", r"(ab){2,}c?"))
    parts = ["***", "**", "XXXX", "XXX", "REDACTED", "_REDACTED", "BASE64_REDACTED", "MASKED", "DATA MASKED", "SENSITIVE", "gone", "hidden", "Secret", "abab", "ab", "<sensitiveDataRemoved>", " ", "é", ""]
    df = spark.createDataFrame([(a + b, b) for a in parts for b in parts] + [(None, "***"), (None, None)], "s string, t string")
    plain = F.array_compact(F.array(*[F.when(F.coalesce(F.col("s").rlike(p), F.lit(False)) | F.coalesce(F.col("t").rlike(p), F.lit(False)), F.lit(n)) for n, p in rules]))
    got = df.select(array_hits(F.array("s", "t"), rules).alias("names"), hits([F.col("s"), F.col("t")], rules).alias("n"), plain.alias("want")).collect()
    assert all(r.names == r.want and r.n == len(r.want) for r in got) and any(len(r.want) == 2 for r in got)


def test_json_leaves():
    value = jsonpaths.parse('{"user":{"id":42,"profile":{"name":"Alice","ok":true}},"a":[1.5,null],"z":{}}')
    assert list(jsonpaths.walk(value)) == [("/a/0", "1.5", "number"), ("/a/1", "null", "other"), ("/user/id", "42", "number"), ("/user/profile/name", "Alice", "text"), ("/user/profile/ok", "true", "other"), ("/z", None, "empty")]
    assert jsonpaths.arrow_path("a->b") == "/a/b"


def test_json_is_strict(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":1} x',), ('{"a":NaN}',), ("",), (None,)], "s string")
    assert [r.e is None for r in df.select(jsonpaths.parsed(F.col("s"))["error"].alias("e")).collect()] == [True, False, False, False, False]
