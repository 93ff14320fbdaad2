"""Records that repeat inside a group.

Records are equal when their SHA-256 digests are: fields are hashed where they lie, so what
is shuffled is 32 bytes for a record, however long its texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _field_digest(df: DataFrame, name: str) -> Column:
    field, kind = F.col(f"`{name}`"), df.schema[name].dataType
    nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType))
    return F.coalesce(F.sha2(F.to_json(field) if nested else field.cast("string"), 256), F.lit("-"))


def record_digest(df: DataFrame, fields: Sequence[str]) -> Column:
    """SHA-256 over the digests of the fields, in 32 bytes; null is a value of its own."""
    return F.unhex(F.sha2(F.concat_ws("|", *[_field_digest(df, c) for c in fields]), 256))


def duplicate_counts(records: DataFrame, group: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """group, n_records, n_dupes (records less distinct records). Equal records are counted
    where they lie before anything is shuffled, so copies cost nothing."""
    distinct = records.select(*group, record_digest(records, fields).alias("_digest")).groupBy(*group, "_digest").agg(F.count("*").alias("_n"))
    return distinct.groupBy(*group).agg(F.sum("_n").alias("n_records"), (F.sum("_n") - F.count("*")).alias("n_dupes"))


def duplicate_listing(records: DataFrame, group: Sequence[str], fields: Sequence[str], order: str = "idx") -> DataFrame:
    """The second and later occurrences, in the records' order: all but the first of equal records.

    The first occurrence is an aggregate, so a record that repeats without end is never sorted."""
    hashed = records.withColumn("_digest", record_digest(records, fields))
    keys = [*group, "_digest"]
    first = hashed.groupBy(*keys).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = first.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_first")
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return hashed.join(first, cond).where(F.col(order) > F.col("_first")).select(*records.columns)


def record_hash(df: DataFrame, fields: Sequence[str]) -> Column:
    """The first 64 bits of a record's digest for display, in hexadecimal."""
    return F.lower(F.substring(F.hex(record_digest(df, fields)), 1, 16))
