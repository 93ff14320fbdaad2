"""Queries over files: a table's records written as logs of one kind, then profiled as any folder is.

A log holds the events of LOG_RECORDS consecutive numbers, so files stay small however large
the table is. The files go to the shared scratch folder, and the report's figures come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..session import scratch_dir
from . import analyze
from .tables import events

LOG_RECORDS = 2_500
_STAMP = "yyyy-MM-dd HH:mm:ss"


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("log", F.floor(F.col("event_id") / LOG_RECORDS).cast("long"))


def _written(df: DataFrame, kind: str, *columns) -> str:
    """The folder with one file for each log, its records in the events' order."""
    path = scratch_dir(df.sparkSession)
    rows = df.repartition("log").sortWithinPartitions("log", "event_id").select("log", *columns)
    writer = rows.write.partitionBy("log")
    if kind == "csv":
        writer.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.text(path)
    return path


def _profiled(spark: SparkSession, path: str, **settings) -> DataFrame:
    stats = analyze.analyze(spark, Settings(path, **settings)).stats
    log = F.regexp_extract("file_path", r"log=(\d+)", 1).cast("long")
    return stats.select(log.alias("log"), "log_type", "column", "first_data_row", F.col("format").cast("long").alias("format"), "n_records", "n_ts", "min_ts", "max_ts", "violation", "n_gaps", "ltg_us", F.round("gap_mean_ms", 3).alias("gap_mean_ms"), F.round(F.sqrt("gap_var_ms"), 3).alias("gap_std_ms"), "n_dupes", "n_redactions", F.col("n_errors").cast("long").alias("n_errors"))


def csv_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as CSV with quotes, commas and line breaks inside fields, the time in the third column."""
    note = F.concat("event_type", F.lit(', "'), F.col("user_id").cast("string"), F.lit('"\n***'))
    path = _written(_logs(spark, sf_dir), "csv", F.col("user_id").alias("user"), note.alias("note"), F.date_format("ts", _STAMP).alias("seen"))
    return _profiled(spark, path)


def json_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines with the time one level down, named as at->time."""
    at = F.struct(F.date_format("ts", _STAMP).alias("time"), F.col("event_type").alias("kind"))
    path = _written(_logs(spark, sf_dir), "json", at.alias("at"), F.col("user_id").alias("user"))
    return _profiled(spark, path, timestamp_field="at->time")


def text_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text lines with the time somewhere inside; every eleventh line has none."""
    stamp = F.when(F.col("event_id") % 11 == 7, F.lit("soon")).otherwise(F.date_format("ts", _STAMP))
    path = _written(_logs(spark, sf_dir), "text", F.concat("event_type", F.lit(" at "), stamp, F.lit(" by "), F.col("user_id").cast("string")).alias("value"))
    return _profiled(spark, path)


QUERIES = {f.__name__: f for f in (csv_logs, json_logs, text_logs)}
