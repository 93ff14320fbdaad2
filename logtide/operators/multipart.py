"""Parts of one log merged: pooled moments, gaps and overlaps between the parts.

A part is a row of a profile. There may be many (a part for each user, say): they are
dealt out by ranges of their starts, and only a row for each range goes through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import micros_between
from ..session import stored


def ordered_parts(parts: DataFrame, name: str, position: str | None = None) -> DataFrame:
    """Parts with times, each with the latest end before it (holder, prev_max) in order of the starts.

    The holder of the latest end changes only if a later part ends strictly later."""
    timed = parts.where("n_ts > 0")
    tie = F.col(position or name)
    dealt = stored(timed.withColumn("_tie", tie).repartitionByRange("min_ts", "_tie").withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy("min_ts", "_tie")
    placed = dealt.withColumn("_at", F.row_number().over(inside))
    # ties of the latest end go to the first part: a later range or place has a smaller number here
    end = F.struct(F.col("max_ts").alias("to"), (-F.col("_range")).alias("r"), (-F.col("_at")).alias("k"), F.col(name).cast("string").alias("holder"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    ranges = placed.groupBy("_range").agg(F.count("*").alias("n"), F.max(end).alias("end"))
    carried = ranges.select("_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"), F.max("end").over(earlier).alias("_carried"))
    own = F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    out = placed.withColumn("_own", own).join(F.broadcast(carried), "_range").withColumn("_latest", F.greatest("_own", "_carried"))  # as many rows as tasks
    out = out.withColumns({"_rank": F.col("_offset") + F.col("_at"), "prev_max": F.col("_latest.to"), "holder": F.col("_latest.holder")})
    return out.drop("_latest", "_own", "_carried", "_offset", "_at", "_range", "_tie")


def overlaps(parts: DataFrame, name: str, position: str | None = None) -> DataFrame:
    """Parts that begin before an earlier one has ended: (holder, part)."""
    return ordered_parts(parts, name, position).where("prev_max > min_ts").select("holder", F.col(name).cast("string").alias("part"), "_rank")


def merged(parts: DataFrame, name: str, position: str | None = None) -> DataFrame:
    """One row: sums, range, pooled population moments, largest gap, overlaps.

    Gaps between parts that don't overlap count as gaps. Needs n_records, n_ts, min_ts,
    max_ts, gap_mean_ms, gap_var_ms, ltg_us, ltg_begin, ltg_end, n_dupes, n_redactions."""
    o = ordered_parts(parts, name, position)
    own = o.select(F.greatest(F.col("n_ts") - 1, F.lit(0)).cast("double").alias("n"), F.coalesce("gap_mean_ms", F.lit(0.0)).alias("m"), F.coalesce("gap_var_ms", F.lit(0.0)).alias("v"), (F.col("_rank") * 2).alias("at"), F.col("ltg_us").alias("gap"), F.col("ltg_begin").alias("begin"), F.col("ltg_end").alias("end"))
    gap = micros_between(F.col("prev_max"), F.col("min_ts"))
    between = o.where("prev_max <= min_ts").select(F.lit(1.0).alias("n"), F.expr("timestampdiff(MICROSECOND, prev_max, min_ts) div 1000").cast("double").alias("m"), F.lit(0.0).alias("v"), (F.col("_rank") * 2 + 1).alias("at"), gap.alias("gap"), F.col("prev_max").alias("begin"), F.col("min_ts").alias("end"))
    both = own.unionByName(between)
    mean = both.agg(F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("_mean"))
    dev = F.col("m") - F.col("_mean")
    moments = both.crossJoin(F.broadcast(mean)).agg(  # the mean is one row
        F.sum("n").cast("bigint").alias("n_gaps"),
        F.max("_mean").alias("gap_mean_ms"),
        F.try_divide(F.sum(F.col("n") * (F.col("v") + dev * dev)), F.sum("n")).alias("gap_var_ms"),
        F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", (-F.col("at")).alias("back"), "begin", "end"))).alias("ltg"),
    )
    sums = parts.agg(
        F.concat(F.sum((F.col("n_ts") > 0).cast("int")).cast("string"), F.lit("_SUCCESSFUL_INPUT_FILES_COMBINED")).alias("name"),
        F.sum("n_records").alias("n_records"),
        F.sum("n_ts").alias("n_ts"),
        F.sum("n_dupes").alias("n_dupes"),
        F.sum("n_redactions").alias("n_redactions"),
        F.min(F.when(F.col("n_ts") > 0, F.col("min_ts"))).alias("min_ts"),
        F.max(F.when(F.col("n_ts") > 0, F.col("max_ts"))).alias("max_ts"),
    )
    n_over = o.agg(F.count_if(F.col("prev_max") > F.col("min_ts")).alias("n_overlaps"))
    one = sums.crossJoin(F.broadcast(moments)).crossJoin(F.broadcast(n_over))  # one row each
    return one.select("name", "n_records", "n_ts", "n_dupes", "n_redactions", "min_ts", "max_ts", "n_gaps", "gap_mean_ms", "gap_var_ms", F.col("ltg.gap").alias("ltg_us"), F.col("ltg.begin").alias("ltg_begin"), F.col("ltg.end").alias("ltg_end"), "n_overlaps")


def _event_times(parts: DataFrame, name: str) -> DataFrame:
    """The begins and ends of the parts, dealt out by ranges of their times: _range, t, step (1, -1), name."""
    edge = lambda c, step: F.struct(F.col(c).alias("t"), F.lit(step).alias("step"))
    rows = parts.where("n_ts > 0").select(F.col(name).alias("name"), F.explode(F.array(edge("min_ts", 1), edge("max_ts", -1))).alias("e")).select("name", "e.t", "e.step")
    return stored(rows.repartitionByRange("t").withColumn("_range", F.spark_partition_id()))


def _swept(events: DataFrame) -> DataFrame:
    """One row a time: _range, t, depth (parts open from t on), lasts (microseconds until the next time; null for the last).

    Sums run inside each range; what carries over is a row for each range."""
    at = events.groupBy("_range", "t").agg(F.sum("step").alias("step"))
    order = Window.orderBy("_range")  # over a row for each range
    ranges = at.groupBy("_range").agg(F.sum("step").alias("step"), F.min("t").alias("first"))
    carried = ranges.select("_range", F.coalesce(F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_open"), F.lead("first").over(order).alias("_next"))
    inside = Window.partitionBy("_range").orderBy("t")
    own = at.withColumns({"_depth": F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_then": F.lead("t").over(inside)})
    out = own.join(F.broadcast(carried), "_range")  # as many rows as tasks
    return out.select("_range", "t", (F.col("_open") + F.col("_depth")).alias("depth"), micros_between(F.col("t"), F.coalesce("_then", "_next")).alias("lasts"))


def depths(parts: DataFrame, name: str) -> DataFrame:
    """depth, micros: for how long so many parts are open at once, from the first begin to the last end."""
    return _swept(_event_times(parts, name)).where("lasts > 0").groupBy("depth").agg(F.sum("lasts").alias("micros"))


def shared_time(parts: DataFrame, name: str) -> DataFrame:
    """name, span_us, shared_us: a part's length, and for how much of it another part is open as well.

    The time with two or more parts open runs along as a sum; a part's share is what it grows by
    from the part's begin to its end, so no pair of parts is ever made."""
    events = _event_times(parts, name)
    both = F.when(F.col("depth") >= 2, F.coalesce("lasts", F.lit(0))).otherwise(0)
    swept = stored(_swept(events).withColumn("_both", both))
    order = Window.orderBy("_range")
    carried = swept.groupBy("_range").agg(F.sum("_both").alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy("_range").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    sums = swept.withColumn("_own", F.coalesce(F.sum("_both").over(inside), F.lit(0))).join(F.broadcast(carried), "_range")  # as many rows as tasks
    grown = events.join(sums.select("_range", "t", (F.col("_own") + F.col("_carried")).alias("grown")), ["_range", "t"])
    begin, end = (F.max(F.when(F.col("step") == k, F.col("grown"))) for k in (1, -1))
    first, last = (F.max(F.when(F.col("step") == k, F.col("t"))) for k in (1, -1))
    return grown.groupBy("name").agg(micros_between(first, last).alias("span_us"), (end - begin).alias("shared_us")).withColumnRenamed("name", name)
