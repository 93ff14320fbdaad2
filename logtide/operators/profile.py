"""The time profile of ordered records: range, gaps, order.

Records of a group follow each other in ``order``. Spark cuts all records into ranges
of (group, order) with equal numbers of records, by quantiles that it samples, whatever
the groups' sizes and however the order column is spread. Each range is sorted and
walked once; a stretch of one group, BLOCK records at most, becomes one summary: counts,
first, last, least and latest time, moments of the gaps, the first of the largest gaps, the first
rise and the first fall. Summaries of neighbouring stretches merge: what lies between
them is the gap from the last time of one to the first time of the next. So records are
shuffled once, narrow, and everything after that works on summaries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.durations import micros_between
from ..session import importable

#: Records of a summary at most.
BLOCK = 1_000_000
#: The figures of a summary; times have the type of the records' times.
_TIMES = ("min_ts", "max_ts", "first_ts", "last_ts", "ltg_begin", "ltg_end")
_FIGURES = {"_part": "long", "_block": "long", "n_records": "long", "n_ts": "long", "nulls": "long", "first_idx": "long", "lead_nulls": "long", "n_gaps": "long", "mean": "double", "var": "double", "ltg_us": "long", "ltg_idx": "long", "up_idx": "long", "up_nulls": "long", "down_idx": "long", "down_nulls": "long"}


def _first_of(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each key of a sorted list comes first (of keys below ``size``), and which occur."""
    at, has = np.zeros(size, np.int64), np.zeros(size, bool)
    own, first = np.unique(keys, return_index=True)
    at[own], has[own] = first, True
    return at, has


def figures(begin: np.ndarray, idx: np.ndarray, us: np.ndarray, valid: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Figures of the stretches that begin at ``begin``: name -> (values, whether there is one)."""
    m, size = len(begin), np.diff(np.append(begin, len(idx)))
    run = np.repeat(np.arange(m), size)
    nulls = np.concatenate([[0], np.cumsum(~valid)])  # in front of each record
    all_ = np.ones(m, bool)
    timed = np.flatnonzero(valid)
    key, t = run[timed], us[timed]
    n_ts = np.bincount(key, minlength=m)
    first, has = _first_of(key, m)
    last = first + n_ts - 1
    out = {"n_records": (size, all_), "n_ts": (n_ts, all_), "nulls": (nulls[begin + size] - nulls[begin], all_)}
    pick = lambda a, at, ok: a[np.where(ok, at, 0)] if len(a) else np.zeros(m, a.dtype)
    out["first_idx"] = pick(idx[timed], first, has), has
    out["first_ts"], out["last_ts"] = (pick(t, first, has), has), (pick(t, last, has), has)
    row = pick(timed, first, has)
    out["lead_nulls"] = np.where(has, nulls[row] - nulls[begin], 0), all_
    for name, ufunc in (("min_ts", np.minimum), ("max_ts", np.maximum)):
        values = np.zeros(m, np.int64)
        if len(t):
            values[has] = ufunc.reduceat(t, first[has])
        out[name] = values, has
    follows = np.flatnonzero(key[1:] == key[:-1]) + 1
    step, key = t[follows] - t[follows - 1], key[follows]
    gap, at = np.abs(step), timed[follows]
    n = np.bincount(key, minlength=m)
    ms = (gap // 1000).astype(np.float64)
    some = n > 0
    mean = np.bincount(key, ms, m) / np.maximum(n, 1)
    var = np.bincount(key, (ms - mean[key]) ** 2, m) / np.maximum(n, 1)
    out |= {"n_gaps": (n, all_), "mean": (mean, some), "var": (var, some)}
    most = np.zeros(m, np.int64)
    if len(gap):
        most[some] = np.maximum.reduceat(gap, _first_of(key, m)[0][some])
    largest = np.flatnonzero(gap == most[key])
    k, _ = _first_of(key[largest], m)
    place = pick(largest, k, some)
    out["ltg_us"], out["ltg_idx"] = (most, some), (pick(idx[at], place, some), some)
    a, b = pick(t[follows - 1], place, some), pick(t[follows], place, some)
    out["ltg_begin"], out["ltg_end"] = (np.minimum(a, b), some), (np.maximum(a, b), some)
    for name, chosen in (("up", np.flatnonzero(step > 0)), ("down", np.flatnonzero(step < 0))):
        k, ok = _first_of(key[chosen], m)
        row = pick(at[chosen], k, ok)
        out[f"{name}_idx"] = idx[row] if len(idx) else row, ok
        out[f"{name}_nulls"] = nulls[row] - nulls[begin], ok
    return out


def summaries(records: DataFrame, group: Sequence[str], order: str = "idx", ts: str = "ts", block: int = BLOCK, ranges: int | None = None) -> DataFrame:
    """One row for each stretch of a group: the group, _part and _block (the stretch's place), and its figures.

    Equal orders follow each other by time. ``ranges``: how many (the session's number of shuffle partitions)."""
    importable(records.sparkSession)
    group = list(group)
    keys = [f"_g{k}" for k in range(len(group))]
    narrow = records.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], F.col(order).alias("_at"), F.col(ts).alias("_ts"))
    by = [*keys, "_at"]
    dealt = (narrow.repartitionByRange(ranges, *by) if ranges else narrow.repartitionByRange(*by)).sortWithinPartitions(*by, "_ts").withColumn("_idx", F.col("_at").cast("long")).drop("_at")
    kinds = dict(narrow.dtypes)
    schema = {**{k: kinds[k] for k in keys}, **_FIGURES, **{c: kinds["_ts"] for c in _TIMES}}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def summed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for k in keys:
                codes = t.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            begin, times = np.flatnonzero(new), t.column("_ts").combine_chunks()
            us = times.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            got = figures(begin, t.column("_idx").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False), us, times.is_valid().to_numpy(zero_copy_only=False))
            got |= {"_part": (np.full(len(begin), part), None), "_block": (np.full(len(begin), number), None)}
            cols = [t.column(k).combine_chunks().take(pa.array(begin)) for k in keys]
            for c, kind in list(schema.items())[len(keys) :]:
                values, has = got[c]
                a = pa.array(values.astype(np.float64 if kind == "double" else np.int64), mask=None if has is None else ~has)
                cols.append(a.cast(times.type) if c in _TIMES else a)
            return pa.RecordBatch.from_arrays(cols, names=list(schema))

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= block:
                yield summed()
                number, held, rows = number + 1, [], 0
        if held:
            yield summed()

    out = dealt.mapInArrow(walk, ", ".join(f"`{c}` {t}" for c, t in schema.items()))
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, group, strict=True)], *list(schema)[len(keys) :])


def merged_summaries(states: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per group from its summaries: the columns of time_profile()."""
    group = list(group)
    of_group = Window.partitionBy(*group)
    before = of_group.orderBy("_part", "_block").rowsBetween(Window.unboundedPreceding, -1)
    s = states.withColumns({"_prev": F.last("last_ts", ignorenulls=True).over(before), "_nulls": F.coalesce(F.sum("nulls").over(before), F.lit(0))})
    seam = F.abs(micros_between(F.col("_prev"), F.col("first_ts")))  # null without a time on either side
    s = s.withColumn("_seam", seam).withColumn("_ms", F.expr("_seam div 1000").cast("double"))
    first = lambda seam_if, own: F.when(seam_if, F.struct(F.col("first_idx").alias("idx"), (F.col("_nulls") + F.col("lead_nulls")).alias("nulls"))).when(F.col(f"{own}_idx").isNotNull(), F.struct(F.col(f"{own}_idx").alias("idx"), (F.col("_nulls") + F.col(f"{own}_nulls")).alias("nulls")))
    gap = lambda us, idx, a, b: F.when(F.col(us).isNotNull(), F.struct(F.col(us).alias("gap"), (-F.col(idx)).alias("back"), F.least(a, b).alias("begin"), F.greatest(a, b).alias("end")))
    n = F.col("n_gaps") + F.col("_seam").isNotNull().cast("long")
    s = s.withColumns({"_up": first(F.col("first_ts") > F.col("_prev"), "up"), "_down": first(F.col("first_ts") < F.col("_prev"), "down"), "_ltg": F.greatest(gap("ltg_us", "ltg_idx", "ltg_begin", "ltg_end"), gap("_seam", "first_idx", "_prev", "first_ts")), "_n": n})
    s = s.withColumn("_m", F.try_divide(F.sum(F.col("n_gaps") * F.coalesce("mean", F.lit(0.0)) + F.coalesce("_ms", F.lit(0.0))).over(of_group), F.sum("_n").over(of_group)))
    off = lambda c: F.col(c) - F.col("_m")
    spread = F.coalesce(F.col("n_gaps") * (F.col("var") + off("mean") * off("mean")), F.lit(0.0)) + F.coalesce(off("_ms") * off("_ms"), F.lit(0.0))
    g = s.groupBy(*group).agg(
        F.sum("n_records").alias("n_records"),
        F.sum("n_ts").alias("n_ts"),
        F.sum("nulls").alias("nulls"),
        F.min("min_ts").alias("min_ts"),
        F.max("max_ts").alias("max_ts"),
        F.min_by("first_ts", F.when(F.col("first_ts").isNotNull(), F.struct("_part", "_block"))).alias("first_ts"),
        F.sum("_n").alias("n_gaps"),
        F.max("_m").alias("gap_mean_ms"),
        F.try_divide(F.sum(spread), F.sum("_n")).alias("gap_var_ms"),
        F.max("_ltg").alias("ltg"),
        F.min("_up").alias("up"),
        F.min("_down").alias("down"),
    )
    rising = F.col("up").isNotNull() & (F.col("down").isNull() | (F.col("up.idx") < F.col("down.idx")))
    g = g.withColumns({"direction": F.when(rising, "Ascending").otherwise("Descending"), "_bad": F.when(rising, F.col("down")).otherwise(F.col("up"))})
    fine = F.col("_bad").isNull()
    return g.select(
        *group,
        "n_records",
        F.when(fine, F.col("n_ts")).otherwise(0).cast("bigint").alias("n_ts"),
        *[F.when(fine, F.col(c)).alias(c) for c in ("min_ts", "max_ts")],
        "first_ts",
        F.col("direction"),
        F.col("_bad.idx").cast("bigint").alias("violation"),
        F.when(fine, F.col("n_gaps")).otherwise(0).cast("bigint").alias("n_gaps"),
        F.when(fine, F.col("gap_mean_ms")).alias("gap_mean_ms"),
        F.when(fine, F.col("gap_var_ms")).alias("gap_var_ms"),
        F.when(fine, F.col("ltg.gap")).cast("bigint").alias("ltg_us"),
        F.when(fine, F.col("ltg.begin")).alias("ltg_begin"),
        F.when(fine, F.col("ltg.end")).alias("ltg_end"),
        F.when(fine, F.col("nulls")).otherwise(F.col("_bad.nulls")).cast("bigint").alias("null_ts"),
    )


def store_summaries(states: DataFrame, folder: str, batch: int) -> None:
    """Keeps the summaries of a log's next records as batch number ``batch`` of a folder. Writing a batch again replaces it."""
    states.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch:09d}")


def stored_profile(spark: SparkSession, folder: str, group: Sequence[str]) -> DataFrame:
    """The columns of time_profile() for all batches of a folder, in their numbers' order, from
    their summaries alone: no record is read again. The order column goes on from batch to batch."""
    kept = spark.read.parquet(folder)
    return merged_summaries(kept.withColumn("_part", F.struct("batch", "_part")).drop("batch"), group)


def time_profile(records: DataFrame, group: Sequence[str], order: str = "idx", ts: str = "ts", block: int = BLOCK, ranges: int | None = None) -> DataFrame:
    """One row per group; null is a group of its own.

    n_records, n_ts, min_ts, max_ts, first_ts, direction ('Ascending' or 'Descending'; the
    latter if all times are equal), violation (the first record against the direction; null
    if sorted), n_gaps, gap_mean_ms, gap_var_ms, ltg_us, ltg_begin, ltg_end, null_ts (records
    without a time before the violation). A violation leaves n_ts 0 and range and gaps null."""
    return merged_summaries(summaries(records, group, order, ts, block, ranges), group)


def top_gaps(profile: DataFrame, tie: str, k: int = 5) -> DataFrame:
    """The k groups with the largest gaps."""
    full = profile.where("min_ts is not null and max_ts is not null and ltg_us is not null")
    return full.orderBy(F.desc("ltg_us"), tie).limit(k)
