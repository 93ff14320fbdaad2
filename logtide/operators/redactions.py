"""Likely redactions in records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import REDACTION_RULES
from ..functions.patterns import needed


def rule_hit(field: Column, pattern: str) -> Column:
    """Whether the field matches. Texts without the literal that every match holds, nearly all
    of them, cost a search for bytes; only the rest go through the expression."""
    literal = needed(pattern)
    hit = field.rlike(pattern)
    return F.coalesce(F.contains(field, F.lit(literal)) & hit if literal else hit, F.lit(False))


def hits(fields: Sequence[Column], rules=REDACTION_RULES) -> Column:
    """How many rules the record's fields match; several matches of one rule count once."""
    out = F.lit(0)
    for _, pattern in rules:
        one = F.lit(False)
        for f in fields:
            one = one | rule_hit(f, pattern)
        out = out + one.cast("int")
    return out


def array_hits(fields: Column, rules=REDACTION_RULES) -> Column:
    """The same for an array of fields: names of the rules that match any of them."""
    def any_field(pattern: str) -> Column:
        return F.exists(fields, lambda f: rule_hit(f, pattern))

    return F.array_compact(F.array(*[F.when(any_field(pattern), F.lit(name)) for name, pattern in rules]))


def redaction_counts(records: DataFrame, group: Sequence[str], fields: Sequence[str], rules=REDACTION_RULES) -> DataFrame:
    return records.groupBy(*group).agg(F.count("*").alias("n_records"), F.sum(hits([F.col(f) for f in fields], rules)).cast("bigint").alias("n_redactions"))


def redaction_listing(records: DataFrame, keep: Sequence[str], fields: Sequence[str], rules=REDACTION_RULES) -> DataFrame:
    """One row per record and rule that matches it."""
    names = F.array_compact(F.array(*[F.when(hits([F.col(f) for f in fields], ((n, p),)) > 0, F.lit(n)) for n, p in rules]))
    return records.select(*keep, F.explode(names).alias("rule_name"))
