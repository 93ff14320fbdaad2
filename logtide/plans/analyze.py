"""A whole run over files: statistics, errors and alerts for each, or for all as one log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import durations, jsonpaths
from ..operators import alerts, detect, duplicates, multipart, profile, redactions
from ..session import stored
from ..sources import records as R

#: What a file of a kind contributes, whatever its kind.
_COMMON = ["file_path", "idx", "fields", "matched", "ts", "bad_json", "log_type", "fatal"]
ERROR_SCHEMA = "file_path string, idx long, level string, reason string"


@dataclass
class Run:
    """files: one row per file; records: all records with times; stats: the profile and counts;
    errors: one row each; settings."""

    files: DataFrame
    records: DataFrame
    bindings: DataFrame
    headers: DataFrame
    stats: DataFrame
    errors: DataFrame
    settings: Settings


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def load(spark: SparkSession, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """files, headers, bindings and records of everything below the input."""
    files = R.list_files(spark, s.input).where("log_type is not null")
    kinds = {r.log_type for r in files.select("log_type").distinct().collect()}  # three at most
    headers = _empty(spark, "file_path string, first_data_row int, headers array<string>")
    bindings = _empty(spark, "file_path string, column string, column_index int, format int")
    out = _empty(spark, "file_path string, idx long, fields array<string>, matched boolean, ts timestamp_ntz, bad_json string, log_type string, fatal string")
    if "csv" in kinds:
        raw = R.csv_records(spark, s.input, "csv")
        h = stored(detect.csv_headers(raw))
        b = stored(detect.csv_binding(raw, h, s.formats, s.timestamp_field))
        data = raw.join(h, "file_path").where("idx >= first_data_row").withColumn("idx", F.col("idx") - F.col("first_data_row"))
        timed = detect.with_times(data.join(b, "file_path", "left"), F.try_element_at("fields", F.col("column_index") + 1), s.formats, b)
        headers, bindings = headers.unionByName(h), bindings.unionByName(b)
        narrow = F.when(F.size("fields") <= F.col("column_index"), F.lit("has no field where the timestamp is"))
        out = out.unionByName(timed.withColumns({"bad_json": F.lit(None).cast("string"), "log_type": F.lit("csv"), "fatal": narrow}).select(*_COMMON))
    if "json" in kinds:
        read = R.json_records(spark, s.input, "json").withColumn("_json", jsonpaths.parsed(F.col("line")))
        raw = stored(read.select("*", F.col("_json.leaves").alias("leaves"), F.col("_json.error").alias("bad_json")).drop("_json"))
        b = stored(detect.json_binding(raw, s.formats, s.timestamp_field))
        joined = raw.join(b, "file_path", "left")
        timed = detect.with_times(joined.withColumn("value", jsonpaths.leaf(F.col("leaves"), F.col("column"))), F.col("value"), s.formats, b)
        bindings = bindings.unionByName(b)
        fatal = F.when(jsonpaths.kind_at(F.col("leaves"), F.col("column")).isin("other", "container"), F.lit("has a timestamp field that is neither text nor a number"))
        if s.timestamp_field is not None:
            named = jsonpaths.kind_at(F.col("leaves"), F.lit(jsonpaths.arrow_path(s.timestamp_field)))
            fatal = F.when((F.col("idx") == 0) & (named != "text"), F.lit("has no text in the named timestamp field")).otherwise(fatal)
        out = out.unionByName(timed.withColumns({"log_type": F.lit("json"), "fatal": fatal}).select(*_COMMON))
    if "text" in kinds:
        raw = stored(R.text_records(spark, s.input, "text"))
        b = stored(detect.text_binding(raw, s.formats))
        timed = detect.with_times(raw.join(b, "file_path", "left"), F.col("line"), s.formats, b)
        bindings = bindings.unionByName(b)
        out = out.unionByName(timed.withColumns({"bad_json": F.lit(None).cast("string"), "log_type": F.lit("text"), "fatal": F.lit(None).cast("string")}).select(*_COMMON))
    return stored(files), stored(headers), stored(bindings), stored(out)


def analyze(spark: SparkSession, s: Settings) -> Run:
    files, headers, bindings, records = load(spark, s)
    bound = records.join(bindings.select("file_path", "format"), "file_path", "left")
    broken = stored(_broken(bound))
    fine = records.join(broken, "file_path", "left_anti")
    p = stored(profile.time_profile(fine, ["file_path"], "idx", "ts", s.block))
    stats = files.join(p, "file_path", "left").join(broken, "file_path", "left").join(bindings, "file_path", "left").join(headers, "file_path", "left")
    counts = {c: F.lit(None).cast("bigint") for c in ("n_dupes", "n_redactions")}
    if s.quick:
        stats = stats.withColumns(counts | {"sha256": F.lit(None).cast("string")})
    else:
        d = duplicates.duplicate_counts(fine, ["file_path"], ["fields"]).select("file_path", "n_dupes")
        r = fine.groupBy("file_path").agg(F.sum(F.size(redactions.array_hits(F.col("fields")))).cast("bigint").alias("n_redactions"))
        stats = stats.join(d, "file_path", "left").join(r, "file_path", "left").join(R.file_hashes(spark, s.input), "file_path", "left")
    zero = F.when(F.col("broken_at").isNull(), 0)
    stats = stats.withColumns({"n_records": F.coalesce("n_records", F.lit(0)), "n_ts": F.when(F.col("format").isNotNull(), F.coalesce("n_ts", F.lit(0))).otherwise(0)})
    if not s.quick:
        stats = stats.withColumns({c: F.coalesce(c, zero) for c in counts})
    stats = stored(stats)
    errors = stored(_errors(bound, stats, broken))
    bad = errors.where(F.col("reason").startswith("Unable to parse JSON")).select("file_path").distinct().withColumn("json_errors", F.lit(True))
    per_file = errors.groupBy("file_path").agg(F.count("*").alias("n_errors"), F.min_by("reason", "idx").alias("one_error"))
    stats = stats.join(bad, "file_path", "left").join(per_file, "file_path", "left").withColumns({"ltg_ms": F.expr("ltg_us div 1000"), "gap_std_ms": F.sqrt("gap_var_ms"), "json_errors": F.coalesce("json_errors", F.lit(False)), "n_errors": F.coalesce("n_errors", F.lit(0))})
    stats = stored(alerts.with_alerts(stats, json_errors="json_errors"))
    return Run(files, records, bindings, headers, stats, errors, s)


def _broken(bound: DataFrame) -> DataFrame:
    """file_path, broken_at, why: the first record that ends a file's analysis."""
    why = F.coalesce("fatal", F.when(F.col("matched") & F.col("ts").isNull(), F.lit("has a timestamp that matches the format but can't be parsed")))
    ended = bound.withColumn("why", why).where("why is not null").select("file_path", "idx", "why")
    # a CSV file's direction must show before any record without a time
    csv = bound.where("log_type = 'csv' and format is not null").select("file_path", "idx", "ts")
    begun = csv.where("ts is not null").groupBy("file_path").agg(F.min_by("ts", "idx").alias("begin"))
    seen = csv.join(begun, "file_path").groupBy("file_path").agg(F.min(F.when(F.col("ts").isNull(), F.col("idx"))).alias("idx"), F.min(F.when(F.col("ts") != F.col("begin"), F.col("idx"))).alias("turn"))
    blind = seen.where("idx is not null and (turn is null or idx < turn)").select("file_path", "idx", F.lit("has no timestamp, and the direction of time isn't known yet").alias("why"))
    return ended.unionByName(blind).groupBy("file_path").agg(F.min("idx").alias("broken_at"), F.min_by("why", "idx").alias("why"))


def _errors(records: DataFrame, stats: DataFrame, broken: DataFrame) -> DataFrame:
    """file_path, idx, level, reason."""
    row = lambda idx, level, reason: (idx.cast("bigint").alias("idx"), F.lit(level).alias("level"), reason.alias("reason"))
    limits = stats.select("file_path", "violation", F.col("format").alias("_bound"), "broken_at")
    out = records.where("bad_json is not null").select("file_path", *row(F.col("idx"), "Critical", F.format_string("Unable to parse JSON at line %d because of %s", "idx", "bad_json")))
    nulls = records.where("ts is null and bad_json is null and not matched").join(limits, "file_path").where("_bound is not null and broken_at is null and (violation is null or idx < violation)")
    out = out.unionByName(nulls.select("file_path", *row(F.col("idx"), "Medium", F.format_string("No timestamp found in record %d", "idx"))))
    out = out.unionByName(stats.where("violation is not null").select("file_path", *row(F.col("violation"), "Medium", F.format_string("Record %d is out of order; time analysis stopped", "violation"))))
    out = out.unionByName(broken.select("file_path", *row(F.col("broken_at"), "Critical", F.format_string("Record %d %s", "broken_at", "why"))))
    return out.unionByName(stats.where("format is null and broken_at is null").select("file_path", *row(F.lit(None), "Medium", F.lit("No supported timestamp was found in the file"))))


_PART = ("file_path", "file_name", "n_records", "n_ts", "min_ts", "max_ts", "gap_mean_ms", "gap_var_ms", "ltg_us", "ltg_begin", "ltg_end", "n_dupes", "n_redactions")


def merged(run: Run) -> DataFrame:
    """All files as parts of one log; alerts are made anew, from the errors of all files too."""
    m = multipart.merged(run.stats.select(*_PART), "file_name", "file_path").withColumns({"ltg_ms": F.expr("ltg_us div 1000"), "gap_std_ms": F.sqrt("gap_var_ms")})
    of_all = run.stats.agg(F.coalesce(F.max("json_errors"), F.lit(False)).alias("json_errors"), F.sum("n_errors").alias("n_errors"), F.max("one_error").alias("one_error"))
    return alerts.with_alerts(m.crossJoin(F.broadcast(of_all)), json_errors="json_errors")  # one row each


def merged_alerts(run: Run, log: DataFrame) -> DataFrame:
    """file_path, level, kind, message: the merged log's alerts, under its name, and one for each part that
    begins before an earlier one has ended, under the part's own path."""
    over = multipart.overlaps(run.stats.select(*_PART), "file_path")
    stem = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    rows = over.select(F.col("part").alias("file_path"), F.lit("Medium").alias("level"), F.lit("MultipartOverlap").alias("kind"), F.concat(stem("holder"), F.lit(" overlaps "), stem("part")).alias("message"))
    return rows.unionByName(alerts.alert_rows(log, "name").withColumnRenamed("name", "file_path"))


#: What a file has and a merged log doesn't.
_OF_FILES = {"file_name": "string", "file_path": "string", "sha256": "string", "size": "bigint", "first_data_row": "int", "column": "string", "format": "int"}


def report(run: Run, stats: DataFrame | None = None) -> DataFrame:
    """The 22 columns of the statistics report, one row per file, or for the rows of ``stats``, such as the merged log's."""
    stats = run.stats if stats is None else stats.withColumn("file_name", F.col("name"))
    stats = stats.withColumns({c: F.lit(None).cast(t) for c, t in _OF_FILES.items() if c not in stats.columns})
    c, t = F.col, durations
    span = t.micros_between(c("min_ts"), c("max_ts"))
    names = F.transform(F.array(*[F.lit(f.name) for f in run.settings.formats]), lambda x: x)
    error = F.when(c("n_errors") == 0, "").when(c("n_errors") == 1, c("one_error")).otherwise(F.format_string("There were %d errors during processing. Check the error log.", c("n_errors")))
    has = c("ltg_us").isNotNull()
    return stats.select(
        c("file_name").alias("Filename"),
        c("file_path").alias("File Path"),
        c("sha256").alias("SHA256 Hash"),
        c("size").cast("string").alias("Size"),
        c("first_data_row").cast("string").alias("First Data Row Used"),
        c("column").alias("Header Used"),
        F.try_element_at(names, c("format") + 1).alias("Timestamp Format"),
        t.thousands(c("n_records")).alias("Total Number of Records"),
        t.thousands(c("n_ts")).alias("Number of Records Processed for Timestamp Analysis"),
        t.seconds_text(c("min_ts")).alias("Min Timestamp"),
        t.seconds_text(c("max_ts")).alias("Max Timestamp"),
        t.hours(span).alias("Duration of Entire Log File (Hours)"),
        t.human(span).alias("Pretty Duration of Entire Log File"),
        F.concat(t.seconds_text(c("ltg_begin")), F.lit(" to "), t.seconds_text(c("ltg_end"))).alias("Largest Time Gap (LTG)"),
        t.hours(c("ltg_us")).alias("Duration of LTG (Hours)"),
        t.human(c("ltg_us")).alias("Pretty Duration of LTG"),
        F.when(has, c("gap_mean_ms").cast("string")).alias("Mean Milliseconds of Time Gaps"),
        F.when(has, c("gap_std_ms").cast("string")).alias("Standard Deviation of Time Gaps in Milliseconds"),
        F.when(has, t.z_score(c("ltg_ms"), c("gap_mean_ms"), c("gap_std_ms")).cast("string")).alias("LTG Number of Standard Deviations Above the Mean"),
        t.thousands(c("n_dupes")).alias("Duplicate Record Count"),
        t.thousands(c("n_redactions")).alias("Possible Redactions Count"),
        error.alias("Error"),
    )


def summary(run: Run) -> DataFrame:
    return run.stats.agg(F.coalesce(F.sum("n_ts"), F.lit(0)).alias("timed_records"), F.count_if(F.col("min_ts").isNotNull()).alias("analysed"), F.count_if(F.col("min_ts").isNull()).alias("not_analysed"))
