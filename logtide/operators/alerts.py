"""Graded alerts from a profile's figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ALERT_THRESHOLDS

LEVELS = ("High", "Medium", "Low")
KINDS = ("SusEventCount", "DupeEvents", "RedactionEvents", "SusTimeGap", "JsonError", "MultipartOverlap")


def above(value: Column, kind: str) -> Column:
    out = F.lit(None).cast("string")
    for level, limit in reversed(list(zip(LEVELS, ALERT_THRESHOLDS[kind], strict=True))):
        out = F.when(value > limit, F.lit(level)).otherwise(out)
    return out


def round_number(value: Column, kind: str) -> Column:
    """Suspiciously round: the value is a multiple of a threshold."""
    out = F.lit(None).cast("string")
    for level, unit in reversed(list(zip(LEVELS, ALERT_THRESHOLDS[kind], strict=True))):
        out = F.when((value > 0) & (value % unit == 0), F.lit(level)).otherwise(out)
    return out


def gap_score(gap_ms: Column, mean: Column, std: Column) -> Column:
    """Whole deviations above the mean: 0 below it and for a gap that is the mean, without end where nothing deviates."""
    above_mean = gap_ms.cast("double") - mean
    endless = F.lit(2**62)
    whole = F.floor(F.least(F.try_divide(above_mean, std), F.lit(1e15))).cast("bigint")
    return F.when(gap_ms.isNull(), F.lit(None).cast("bigint")).when(std == 0, F.when(above_mean > 0, endless).otherwise(F.lit(0).cast("bigint"))).otherwise(F.greatest(whole, F.lit(0)))


def with_alerts(stats: DataFrame, n_ts: str = "n_ts", dupes: str = "n_dupes", redactions: str = "n_redactions", gap_ms: str = "ltg_ms", mean: str = "gap_mean_ms", std: str = "gap_std_ms", json_errors: str | None = None) -> DataFrame:
    """stats with ``alerts``: an array of (level, kind, message)."""
    number = lambda c: F.format_number(F.col(c), 0)
    score = gap_score(F.col(gap_ms), F.col(mean), F.col(std))
    rules = [
        ("SusEventCount", round_number(F.col(n_ts), "SusEventCount"), F.concat(number(n_ts), F.lit(" records are a suspiciously round number"))),
        ("DupeEvents", above(F.col(dupes), "DupeEvents"), F.concat(number(dupes), F.lit(" duplicate records"))),
        ("RedactionEvents", above(F.col(redactions), "RedactionEvents"), F.concat(number(redactions), F.lit(" possible redactions"))),
        ("SusTimeGap", above(score, "SusTimeGap"), F.concat(F.lit("the largest gap is "), F.when(score >= 2**62, F.lit("endlessly many")).otherwise(score.cast("string")), F.lit(" standard deviations above the mean"))),
    ]
    if json_errors:
        rules.append(("JsonError", F.when(F.col(json_errors), F.lit("High")), F.lit("lines that are not JSON")))
    made = [F.when(level.isNotNull(), F.struct(level.alias("level"), F.lit(kind).alias("kind"), message.alias("message"))) for kind, level, message in rules]
    return stats.withColumn("alerts", F.array_compact(F.array(*made)))


def alert_rows(stats: DataFrame, *keep: str) -> DataFrame:
    return stats.select(*keep, F.explode("alerts").alias("a")).select(*keep, "a.level", "a.kind", "a.message")


def alert_rollup(rows: DataFrame) -> DataFrame:
    """How many of each level and kind, the gravest level first."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    return rows.groupBy("level", "kind").agg(F.count("*").alias("n_alerts")).orderBy(rank, "kind")
