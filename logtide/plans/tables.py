"""Queries over tables: each applies the operators to a whole table of the data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import builtin_formats
from ..functions import durations, jsonpaths, timestamps
from ..operators import alerts, duplicates, multipart, profile, redactions
from ..session import scratch_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


def _profile(df: DataFrame, key: str) -> DataFrame:
    return df.select(
        key,
        "n_records",
        "n_ts",
        "min_ts",
        "max_ts",
        "n_gaps",
        F.col("ltg_us"),
        "ltg_begin",
        "ltg_end",
        F.round("gap_mean_ms", 3).alias("gap_mean_ms"),
        F.round(F.sqrt("gap_var_ms"), 3).alias("gap_std_ms"),
        F.round(durations.z_score(F.expr("ltg_us div 1000"), F.col("gap_mean_ms"), F.sqrt("gap_var_ms")), 3).alias("ltg_z"),
    )


def but_key(df: DataFrame, *keys: str) -> list[str]:
    """The fields of a record: all but its number."""
    return [c for c in df.columns if c not in keys]


def time_profile_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(profile.time_profile(events(spark, sf_dir), ["event_type"], "event_id"), "event_type")


def time_profile_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(profile.time_profile(events(spark, sf_dir), ["user_id"], "event_id"), "user_id")


def file_sortedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction and first violation of two whole tables and of the orders of each priority."""
    o = profile.time_profile(orders(spark, sf_dir).withColumn("log", F.concat(F.lit("orders/"), "o_orderpriority")), ["log"], "o_orderkey", "o_orderdate")
    e = profile.time_profile(events(spark, sf_dir).withColumn("log", F.lit("events")), ["log"], "event_id")
    return o.unionByName(e).select("log", "direction", F.col("violation").isNull().alias("is_sorted"), "violation")


def out_of_order_nulling(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.time_profile(orders(spark, sf_dir), ["o_orderpriority"], "o_orderkey", "o_orderdate")
    return p.select("o_orderpriority", "n_records", "n_ts", "min_ts", "max_ts", "ltg_us", "violation", F.when(F.col("violation").isNotNull(), F.concat(F.lit("out of order at record "), F.col("violation").cast("string"))).alias("error"))


def largest_gap_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five users with the largest gaps: a report of five rows."""
    p = profile.time_profile(events(spark, sf_dir), ["user_id"], "event_id")
    return profile.top_gaps(p, "user_id").select("user_id", "min_ts", "max_ts", "ltg_us")


def largest_gap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.time_profile(events(spark, sf_dir), ["event_type"], "event_id")
    return p.select("event_type", F.concat(durations.seconds_text(F.col("ltg_begin")), F.lit(" to "), durations.seconds_text(F.col("ltg_end"))).alias("ltg"), durations.hours(F.col("ltg_us")).alias("ltg_hours"))


def dup_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_counts(read(spark, sf_dir, "documents"), ["source"], ["text"])


def dup_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_listing(read(spark, sf_dir, "documents").select("source", "doc_id", "text"), ["source"], ["text"], "doc_id").select("source", "doc_id")


def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a table whose fields, all but the key, repeat."""
    c = read(spark, sf_dir, "customer")
    return duplicates.duplicate_counts(c, ["c_mktsegment"], but_key(c, "c_custkey", "c_mktsegment"))


def record_hash_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash that detail files show, of every document that repeats an earlier one."""
    d = read(spark, sf_dir, "documents")
    d = d.select("source", "doc_id", "text", "lang", duplicates.record_hash(d, ["text", "lang"]).alias("record_hash"))
    return duplicates.duplicate_listing(d, ["source"], ["text", "lang"], "doc_id").select("source", "doc_id", "record_hash")


def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redactions.redaction_counts(read(spark, sf_dir, "documents"), ["source"], ["text"])


def redaction_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redactions.redaction_listing(read(spark, sf_dir, "documents"), ["doc_id"], ["text"])


def redaction_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each rule in documents, pages and conversations."""
    tables = (("documents", "text"), ("pages", "html"), ("conversations", "text"))
    found = [redactions.redaction_listing(read(spark, sf_dir, t), [], [c]).withColumn("log", F.lit(t)) for t, c in tables]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("log", "rule_name").agg(F.count("*").alias("n_hits"))


def redaction_rules_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on texts that hold its word: events' types written between marks."""
    words = ["***", "XXXX", "<sensitiveDataRemoved>", "is REDACTED here", "REMOVED FOR SECURITY", "DATA MASKED", "[[SENSITIVE]]", "BASE64_REDACTED", "UNREDACTED", "**"]
    e = read(spark, sf_dir, "events").withColumn("text", F.concat("event_type", F.lit(" "), F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % len(words) + 1).cast("int"))))
    return redactions.redaction_listing(e, ["event_id"], ["text"]).groupBy("rule_name").agg(F.count("*").alias("n_hits"), F.min("event_id").alias("first_hit"))


def _with_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, with the records that repeat in all fields but the number, and redactions."""
    e = events(spark, sf_dir)
    p = profile.time_profile(e, ["event_type"], "event_id")
    d = duplicates.duplicate_counts(e, ["event_type"], but_key(e, "event_id", "event_type")).select("event_type", "n_dupes")
    r = redactions.redaction_counts(e, ["event_type"], ["props"]).select("event_type", "n_redactions")
    stats = p.join(d, "event_type").join(r, "event_type").withColumns({"ltg_ms": F.expr("ltg_us div 1000"), "gap_std_ms": F.sqrt("gap_var_ms")})
    return alerts.with_alerts(stats)


def alerts_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_rows(_with_alerts(spark, sf_dir), "event_type").select("event_type", "level", "kind")


def alert_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_rollup(alerts.alert_rows(_with_alerts(spark, sf_dir), "event_type"))


def _parts(spark: SparkSession, sf_dir: str, part) -> DataFrame:
    e = events(spark, sf_dir).withColumn("part", part)
    p = profile.time_profile(e, ["part"], "event_id")
    d = duplicates.duplicate_counts(e, ["part"], but_key(e, "event_id", "part")).select("part", "n_dupes")
    r = redactions.redaction_counts(e, ["part"], ["props"]).select("part", "n_redactions")
    return p.join(d, "part").join(r, "part")


def multipart_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each day as parts of one log."""
    m = multipart.merged(_parts(spark, sf_dir, F.date_format("ts", "yyyy-MM-dd")), "part")
    return m.select("name", "n_records", "n_ts", "n_dupes", "n_redactions", "min_ts", "max_ts", "n_gaps", F.round("gap_mean_ms", 3).alias("gap_mean_ms"), F.round(F.sqrt("gap_var_ms"), 3).alias("gap_std_ms"), "ltg_us", "ltg_begin", "ltg_end", "n_overlaps")


def multipart_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as parts: who overlaps whom."""
    p = profile.time_profile(events(spark, sf_dir), ["user_id"], "event_id")
    return multipart.overlaps(p, "user_id").select("holder", "part")


def profile_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each type as four batches that arrive one after another: each is summed up alone,
    and the profile comes from the stored summaries."""
    e, folder = events(spark, sf_dir), scratch_dir(spark)
    last = e.agg(F.max("event_id")).first()[0] or 0
    for k in range(4):
        at = F.floor(F.coalesce("event_id", F.lit(0)) * 4 / max(1, last))
        batch = e.where(F.greatest(F.lit(0), F.least(F.lit(3), at)) == k)
        profile.store_summaries(profile.summaries(batch, ["event_type"], "event_id"), folder, k)
    return _profile(profile.stored_profile(spark, folder, ["event_type"]), "event_type")


def part_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as parts: for how long how many are open at once."""
    return multipart.depths(profile.time_profile(events(spark, sf_dir), ["user_id"], "event_id"), "user_id")


def part_shared_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer as parts: how much of each one's span is shared with another."""
    o = orders(spark, sf_dir)
    spans = o.groupBy("o_custkey").agg(F.count("o_orderdate").alias("n_ts"), F.min("o_orderdate").alias("min_ts"), F.max("o_orderdate").alias("max_ts"))
    return multipart.shared_time(spans, "o_custkey")


#: Number of the format -> Spark's pattern that writes a time in it
_WRITTEN = {
    0: "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    1: "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    2: "yyyy-MM-dd HH:mm:ss",
    3: "MMM d, yyyy h:mm:ss a",
    4: "MMM d yyyy H:mm:ss",
    5: "MM/dd/yyyy h:mm:ss a",
    8: "'date='yyyy-MM-dd 'time='HH:mm:ss",
    9: "MMM d HH:mm:ss",
}


def written(ts, k: int):
    """A time as text in format k."""
    if k in (6, 7):
        micros = durations.micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
        return F.floor(micros / (1_000_000 if k == 6 else 1_000)).cast("bigint").cast("string")
    return F.date_format(ts, _WRITTEN[k])


def _ts_extract(k: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        fmt = builtin_formats()[k]
        e = events(spark, sf_dir).select("event_id", F.concat(F.lit("at "), written(F.col("ts"), k), F.lit(" "), "event_type").alias("line"))
        x = timestamps.extracted(F.col("line"), fmt)
        return e.select("event_id", x["matched"].alias("matched"), x["ts"].alias("parsed_ts"))

    query.__doc__ = f"Every event's time written in format {k + 1}, found and parsed."
    return query


def format_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which format each event's line holds, where the lines take turns with the ten formats."""
    formats = builtin_formats()
    line = F.lit(None).cast("string")
    for k in range(len(formats)):
        line = F.when(F.col("event_id") % len(formats) == k, written(F.col("ts"), k)).otherwise(line)
    e = events(spark, sf_dir).select("event_id", "event_type", line.alias("line"))
    names = F.array(*[F.lit(f.name) for f in formats])
    hit = e.withColumn("k", timestamps.first_format(F.col("line"), formats))
    return hit.groupBy(F.element_at(names, F.col("k") + 1).alias("format")).agg(F.count("*").alias("n_records"), F.min("event_id").alias("first_record"))


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.explode(jsonpaths.leaves(F.col("props"))).alias("leaf")).select("event_id", "leaf.path", "leaf.value")


def json_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", jsonpaths.at_pointer(F.col("props"), jsonpaths.arrow_path("k")).alias("value"))


def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.time_profile(events(spark, sf_dir), ["user_id"], "event_id")
    span = durations.micros_between(F.col("min_ts"), F.col("max_ts"))
    return p.select("user_id", durations.hours(span).alias("duration_hours"), durations.human(span).alias("duration_text"), durations.thousands(F.col("n_records")).alias("records_text"))


def stats_report_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics report's columns that a table has too (no file, hash, header), for the events of each type."""
    s = _with_alerts(spark, sf_dir)
    span = durations.micros_between(F.col("min_ts"), F.col("max_ts"))
    number = lambda c: F.format_number(c, 3)
    return s.select(
        "event_type",
        durations.thousands(F.col("n_records")).alias("total_records"),
        durations.thousands(F.col("n_ts")).alias("timed_records"),
        durations.seconds_text(F.col("min_ts")).alias("min_ts"),
        durations.seconds_text(F.col("max_ts")).alias("max_ts"),
        durations.hours(span).alias("duration_hours"),
        F.concat(durations.seconds_text(F.col("ltg_begin")), F.lit(" to "), durations.seconds_text(F.col("ltg_end"))).alias("ltg"),
        durations.hours(F.col("ltg_us")).alias("ltg_hours"),
        durations.human(span).alias("duration_text"),
        durations.human(F.col("ltg_us")).alias("ltg_text"),
        number(F.col("gap_mean_ms")).alias("gap_mean_ms"),
        number(F.col("gap_std_ms")).alias("gap_std_ms"),
        number(durations.z_score(F.col("ltg_ms"), F.col("gap_mean_ms"), F.col("gap_std_ms"))).alias("ltg_z"),
        F.when(F.col("violation").isNotNull(), F.format_string("Record %d is out of order; time analysis stopped", "violation")).otherwise("").alias("error"),
        durations.thousands(F.col("n_dupes")).alias("dupes"),
        durations.thousands(F.col("n_redactions")).alias("redactions"),
    )


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over the users' profiles: records with times, logs with and without a range."""
    p = profile.time_profile(events(spark, sf_dir), ["user_id"], "event_id")
    o = profile.time_profile(orders(spark, sf_dir).withColumnRenamed("o_custkey", "user_id"), ["user_id"], "o_orderkey", "o_orderdate")
    both = p.unionByName(o)
    return both.agg(F.sum("n_ts").alias("timed_records"), F.count_if(F.col("min_ts").isNotNull()).alias("analysed"), F.count_if(F.col("min_ts").isNull()).alias("not_analysed"))


def null_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose time is missing: every seventh event's time is blanked out."""
    e = events(spark, sf_dir).withColumn("ts", F.when(F.col("event_id") % 7 != 3, F.col("ts")))
    return profile.time_profile(e, ["event_type"], "event_id").select("event_type", "n_records", "n_ts", "null_ts", "n_gaps", "ltg_us")


QUERIES = {
    f.__name__: f
    for f in (
        time_profile_by_type,
        time_profile_by_user,
        file_sortedness,
        out_of_order_nulling,
        largest_gap_top5,
        largest_gap_interval,
        dup_counts_by_source,
        dup_listing,
        distinct_rows,
        record_hash_dupes,
        redaction_counts,
        redaction_listing,
        redaction_by_rule,
        redaction_rules_injected,
        alerts_per_group,
        alert_rollup,
        multipart_merge,
        multipart_overlap,
        profile_appended,
        part_depths,
        part_shared_time,
        format_detection,
        json_flatten,
        json_pointer,
        duration_format,
        stats_report_row,
        run_summary,
        null_timestamps,
    )
} | {f"ts_extract_{k + 1}": _ts_extract(k) for k in range(10)}
