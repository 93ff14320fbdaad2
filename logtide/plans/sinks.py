"""What a run leaves behind: the report, logs, and the hits in detail. All by Spark's writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durations import file_stem
from ..operators import alerts, duplicates, redactions
from ..session import stored
from . import analyze


def error_lines(run: analyze.Run) -> DataFrame:
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    named = run.errors.join(run.files.select("file_path", "file_name"), "file_path")
    return named.select(F.concat(F.lit("["), stamp, F.lit("] ["), F.upper("level"), F.lit("] ["), "file_name", F.lit("]"), "reason").alias("value"))


def alert_lines(run: analyze.Run, merged: DataFrame | None = None) -> DataFrame:
    """A line for each alert of each file, or of the merged log, which has no path but its name, and of its parts' overlaps."""
    rows = alerts.alert_rows(run.stats, "file_path") if merged is None else analyze.merged_alerts(run, merged)
    return rows.select(F.format_string("File Path:%s | Level: %s | Type %s | Message: %s", "file_path", "level", "kind", "message").alias("value"))


def duplicate_details(run: analyze.Run) -> DataFrame:
    """file_path, idx, note (the record's hash), fields of every repeated record."""
    rows = run.records.select("file_path", "idx", "fields")
    rows = rows.withColumn("note", duplicates.record_hash(rows, ["fields"]))
    return duplicates.duplicate_listing(rows, ["file_path"], ["fields"])


def redaction_details(run: analyze.Run) -> DataFrame:
    """file_path, idx, note (the rule's name), fields of every record and rule that matches it."""
    return run.records.select("file_path", "idx", "fields", F.explode(redactions.array_hits(F.col("fields"))).alias("note"))


def csv_line(fields):
    """Fields as one CSV line: those with a comma, quote or line break in quotes."""
    return F.concat_ws(",", F.transform(fields, lambda x: F.when(x.rlike('[",\\r\\n]') | (x == ""), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)))


def detail_lines(run: analyze.Run, rows: DataFrame, note: str) -> DataFrame:
    """log, part, idx, value: CSV lines of hits behind a header of their log's own columns. A log's
    name is its file's stem; where files share a stem, the path's hash is added."""
    named = run.files.select("file_path", file_stem(F.col("file_name")).alias("stem"))
    named = named.join(named.groupBy("stem").agg(F.count("*").alias("n")), "stem").select("file_path", F.when(F.col("n") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), F.substring(F.sha2("file_path", 256), 1, 8))).alias("log"))
    hits = rows.select("file_path", "idx", csv_line(F.concat(F.array(F.col("idx").cast("string"), F.col("note")), F.coalesce("fields", F.array().cast("array<string>")))).alias("value"))
    own = F.coalesce("headers", F.when(F.col("log_type") == "csv", F.array().cast("array<string>")).otherwise(F.array(F.lit("Record"))))
    heads = run.files.join(run.headers.select("file_path", "headers"), "file_path", "left").join(rows.select("file_path").distinct(), "file_path")
    heads = heads.select("file_path", F.lit(-1).cast("long").alias("idx"), csv_line(F.concat(F.array(F.lit("Index of Hit"), F.lit(note)), own)).alias("value"))
    return hits.unionByName(heads).join(named, "file_path").select("log", "idx", "value")


def write_details(lines: DataFrame, folder: str) -> None:
    """A folder for each log below ``folder``; its files, read by name, are one CSV file with one header.

    Hits are dealt by ranges of (log, index), so a log with most of all hits has several files. Spark's
    commit moves files only when all are whole: a failed task leaves none."""
    lines.repartitionByRange("log", "idx").sortWithinPartitions("log", "idx").select("log", "value").write.mode("append").partitionBy("log").option("compression", "none").text(folder)


def write_all(run: analyze.Run, folder: str) -> None:
    """Adds this run's outputs below ``folder``; of parts of one log, the merged one's figures and alerts."""
    merged = stored(analyze.merged(run)) if run.settings.multipart else None
    analyze.report(run, merged).write.mode("append").option("header", True).csv(f"{folder}/statistics")
    error_lines(run).write.mode("append").text(f"{folder}/errors")
    alert_lines(run, merged).write.mode("append").text(f"{folder}/alerts")
    if not run.settings.quick:
        write_details(detail_lines(run, stored(duplicate_details(run)), "Hash of Record"), f"{folder}/Duplicates")
        write_details(detail_lines(run, stored(redaction_details(run)), "Rule Name"), f"{folder}/Redactions")
