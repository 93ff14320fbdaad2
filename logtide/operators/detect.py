"""What a file's records look like: the header, the time's column and format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HEADER_RECORDS, TimestampFormat
from ..functions import jsonpaths, timestamps
from ..session import stored

#: Lines of a text file that are searched for a format before all of its lines are.
TEXT_HEAD = 100


def csv_headers(records: DataFrame) -> DataFrame:
    """file_path, first_data_row, headers.

    Of the first records the last one's number of fields is the expected one; the header
    follows the last record that has fewer, or is the first record."""
    head = records.where(F.col("idx") < HEADER_RECORDS).groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("idx", "fields"))).alias("r"))
    expected = F.size(F.element_at("r", -1)["fields"])
    short = F.filter("r", lambda x: F.size(x["fields"]) < expected)
    at = F.when(F.size(short) > 0, F.element_at(short, -1)["idx"] + 1).otherwise(F.lit(0)).cast("int")
    return head.select("file_path", (at + 1).alias("first_data_row"), F.element_at("r", at + 1)["fields"].alias("headers"))


def _first_hit(leaves, formats: Sequence[TimestampFormat], path: str, value: str):
    """The first leaf that holds any format, and the first format it holds."""
    hits = F.transform(leaves, lambda x: F.struct(x[path].alias("column"), timestamps.first_format(x[value], formats).alias("format")))
    return F.try_element_at(F.filter(hits, lambda h: h["format"].isNotNull()), F.lit(1))


def csv_binding(records: DataFrame, headers: DataFrame, formats: Sequence[TimestampFormat], field: str | None = None) -> DataFrame:
    """file_path, column, column_index, format (its number): from the first data record, columns before formats."""
    first = records.join(headers, "file_path").where("idx = first_data_row")
    cells = F.transform(F.sequence(F.lit(1), F.size("fields")), lambda i: F.struct((i - 1).cast("string").alias("at"), F.trim(F.coalesce(F.try_element_at("headers", i), F.concat(F.lit("_c"), (i - 1).cast("string")))).alias("name"), F.element_at("fields", i).alias("value")))
    cells = F.when(F.size("fields") > 0, cells)
    if field is not None:
        cells = F.filter(cells, lambda c: c["name"] == field.strip())
    out = first.withColumns({"cells": cells}).withColumn("hit", F.when(F.size("cells") > 0, _first_hit(F.col("cells"), formats, "at", "value")))
    index = F.col("hit.column").cast("int")
    return out.where("hit is not null").select("file_path", F.coalesce(F.try_element_at("headers", index + 1), F.concat(F.lit("_c"), index.cast("string"))).alias("column"), index.alias("column_index"), F.col("hit.format").alias("format"))


def json_binding(records: DataFrame, formats: Sequence[TimestampFormat], field: str | None = None) -> DataFrame:
    """The same from line 0 of JSON lines (with their ``leaves``); the column is a pointer. Without a first line, or a broken one: none."""
    first = records.where("idx = 0")
    leaves = F.filter("leaves", lambda x: x["kind"] != "empty")
    if field is not None:
        pointer = jsonpaths.arrow_path(field)
        leaves = F.filter(leaves, lambda x: (x["path"] == pointer) & (x["kind"] == "text"))
    out = first.withColumn("hit", F.when(F.size(leaves) > 0, _first_hit(leaves, formats, "path", "value")))
    return out.where("hit is not null").select("file_path", F.col("hit.column").alias("column"), F.lit(0).alias("column_index"), F.col("hit.format").alias("format"))


def text_binding(records: DataFrame, formats: Sequence[TimestampFormat], head: int = TEXT_HEAD) -> DataFrame:
    """From the first line that holds any format. All lines are searched only of files whose first ``head`` hold none."""
    early = stored(_first_line(records.where(F.col("idx") < head), formats))
    late = _first_line(records.where(F.col("idx") >= head).join(early, "file_path", "left_anti"), formats)
    return early.unionByName(late).select("file_path", F.lit("Record").alias("column"), F.lit(0).alias("column_index"), "format")


def _first_line(records: DataFrame, formats: Sequence[TimestampFormat]) -> DataFrame:
    """file_path, format of the first of these lines that holds any. The search stays in the aggregate: a filter would move in front of joins."""
    hit = records.withColumn("format", timestamps.first_format(F.col("line"), formats))
    first = F.min(F.when(F.col("format").isNotNull(), F.struct("idx", "format")))
    return hit.groupBy("file_path").agg(first.alias("_hit")).where("_hit is not null").select("file_path", F.col("_hit.format").alias("format"))


def with_times(records: DataFrame, value, formats: Sequence[TimestampFormat], bindings: DataFrame) -> DataFrame:
    """records (with their file's ``format``) and matched, ts: the value read in that format. Only formats that
    ``bindings``, one row a file, holds are made into code."""
    out = F.struct(F.lit(False).alias("matched"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    used = sorted(r.format for r in bindings.select("format").distinct().collect())  # one row for each format at most
    for k in used:
        fmt = formats[k]
        out = F.when(F.col("format") == k, timestamps.extracted(value, fmt)).otherwise(out)
    return records.withColumn("_x", out).withColumns({"matched": F.col("_x.matched"), "ts": F.col("_x.ts")}).drop("_x")
