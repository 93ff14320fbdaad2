"""Profiles, alerts, duplicates and merging on small logs."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logtide.operators import alerts, duplicates, multipart
from logtide.operators.profile import store_summaries, stored_profile, summaries, time_profile, top_gaps

DAY = dt.datetime(2025, 5, 9)


def log(spark, times, name="a"):
    return spark.createDataFrame([(name, i, None if t is None else DAY + dt.timedelta(hours=t)) for i, t in enumerate(times)], "file_path string, idx long, ts timestamp_ntz")


def profile(spark, times, block=4, ranges=3):
    return time_profile(log(spark, times), ["file_path"], block=block, ranges=ranges).first()


def test_gaps(spark):
    p = profile(spark, [12, 13, 15])
    assert (p.n_records, p.n_ts, p.n_gaps, p.violation, p.direction) == (3, 3, 2, None, "Ascending")
    assert (p.ltg_begin, p.ltg_end) == (DAY + dt.timedelta(hours=13), DAY + dt.timedelta(hours=15))
    assert (p.gap_mean_ms, p.gap_var_ms) == (5_400_000.0, 1_800_000.0**2)


def test_first_of_tied_gaps(spark):
    p = profile(spark, [1, 3, 5, 6])
    assert p.ltg_begin == DAY + dt.timedelta(hours=1)


@pytest.mark.parametrize("spread", ["pareto", "log", "one group", "groups"])
def test_ranges_hold_equal_shares(spark, spread):
    """However the order column is spread, no range holds twice the mean, and summaries are as few as ranges and groups."""
    rng, n = np.random.default_rng(5), 40_000
    at = {"pareto": rng.pareto(0.5, n) * 1e3, "log": 10 ** rng.uniform(0, 15, n)}.get(spread, np.arange(n))
    at = np.unique(np.minimum(at, 1e17).astype(np.int64))
    of = np.where(rng.random(len(at)) < 0.34, 0, rng.integers(0, 500, len(at))) if spread == "groups" else np.zeros(len(at), int)
    rows = spark.createDataFrame(pd.DataFrame({"g": of, "idx": at, "ts": pd.Timestamp(DAY) + pd.to_timedelta(np.arange(len(at)), "s")})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    states = summaries(rows, ["g"], ranges=16)
    sizes = [r[0] for r in states.groupBy("_part").agg(F.sum("n_records")).select("sum(n_records)").collect()]
    assert len(sizes) >= 14 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert states.count() <= len(set(of.tolist())) + 16
    p = {r.g: r for r in time_profile(rows, ["g"], ranges=16).collect()}
    seconds = pd.Series(np.arange(len(at))).groupby(of)
    assert {g: (r.n_ts, r.ltg_us, r.violation) for g, r in p.items()} == {g: (len(x), int(x.diff().max() * 1e6) if len(x) > 1 else None, None) for g, x in seconds}


def test_records_are_read_in_one_exchange(spark):
    """Records are dealt once, by ranges; groups and joins afterwards see summaries."""
    plan = time_profile(log(spark, [1, 2]), ["file_path"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "Join" not in plan


def test_parts_in_many_ranges(spark):
    """Ranks, latest ends and their holders as one pass over the sorted parts gives them, with ties in all."""
    rng = random.Random(4)
    parts = [(f"p{k:03}", DAY + dt.timedelta(hours=a), DAY + dt.timedelta(hours=a + rng.randrange(9)), 1) for k, a in enumerate(rng.randrange(60) for _ in range(300))]
    df = spark.createDataFrame(parts, "part string, min_ts timestamp_ntz, max_ts timestamp_ntz, n_ts long")
    got = {r.part: (r._rank, r.prev_max, r.holder) for r in multipart.ordered_parts(df, "part").collect()}
    want, latest, holder = {}, None, None
    for k, (part, begin, end, _) in enumerate(sorted(parts, key=lambda p: (p[1], p[0])), 1):
        want[part] = (k, latest, holder)
        if latest is None or end > latest:
            latest, holder = end, part
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_stored_batches_are_the_whole(spark, tmp_path, seed):
    """Many stored batches and one more give what a full run gives, gaps and falls between batches included; a batch written twice counts once."""
    rng = random.Random(seed)
    times = [rng.randrange(500) if rng.random() > 0.2 else None for _ in range(120)]
    times = sorted(t for t in times if t is not None) if seed == 1 else times
    whole = log(spark, times).unionByName(log(spark, times[:7][::-1], "b"))
    for k, at in enumerate(range(0, len(times), 12)):
        batch = whole.where(f"idx >= {at} AND idx < {at + 12}")
        for _ in range(1 + (k == 3)):
            store_summaries(summaries(batch, ["file_path"], block=5, ranges=2), str(tmp_path / "kept"), k)
    got = stored_profile(spark, str(tmp_path / "kept"), ["file_path"]).toPandas().sort_values("file_path", ignore_index=True)
    want = time_profile(whole, ["file_path"]).toPandas().sort_values("file_path", ignore_index=True)
    pd.testing.assert_frame_equal(got, want)


def test_swept_parts(spark):
    """Depths and shared time by brute force, minute by minute, with ties, empty and equal parts, over many ranges."""
    rng = random.Random(6)
    spans = [(f"p{k:03}", a, a + rng.randrange(6)) for k, a in enumerate(rng.randrange(200) for _ in range(120))]
    at = lambda m: DAY + dt.timedelta(minutes=m)
    df = spark.createDataFrame([(n, at(a), at(b), 1) for n, a, b in spans] + [("none", None, None, 0)], "part string, min_ts timestamp_ntz, max_ts timestamp_ntz, n_ts long")
    open_ = [sum(a <= m < b for _, a, b in spans) for m in range(210)]
    first, last = min(a for _, a, _ in spans), max(b for _, _, b in spans)
    minute = 60_000_000
    want = {}
    for m in range(first, last):
        want[open_[m]] = want.get(open_[m], 0) + minute
    assert {r.depth: r.micros for r in multipart.depths(df, "part").collect()} == want
    got = {r.part: (r.span_us, r.shared_us) for r in multipart.shared_time(df, "part").collect()}
    assert got == {n: ((b - a) * minute, sum(open_[m] >= 2 for m in range(a, b)) * minute) for n, a, b in spans}


def test_descending(spark):
    p = profile(spark, [15, 13, 12])
    assert p.direction == "Descending" and p.violation is None
    assert (p.min_ts, p.ltg_begin) == (DAY + dt.timedelta(hours=12), DAY + dt.timedelta(hours=13))


def test_violation_nulls_the_times(spark):
    p = profile(spark, [1, 2, None, 3, 2, 9, None])
    assert (p.violation, p.n_records, p.n_ts, p.min_ts, p.ltg_us, p.null_ts) == (4, 7, 0, None, None, 1)


def test_equal_times_default_to_descending(spark):
    p = profile(spark, [1, 1, 1])
    assert (p.direction, p.violation, p.n_ts, p.ltg_us) == ("Descending", None, 3, 0)
    assert profile(spark, [1, 1, 2, 1]).violation == 3


def test_single_and_none(spark):
    assert (lambda p: (p.n_ts, p.min_ts, p.max_ts, p.ltg_us))(profile(spark, [5])) == (1, DAY + dt.timedelta(hours=5), DAY + dt.timedelta(hours=5), None)
    assert (lambda p: (p.n_ts, p.min_ts, p.null_ts))(profile(spark, [None, None])) == (0, None, 2)
    assert time_profile(log(spark, []), ["file_path"]).collect() == []


def test_null_group_is_a_group(spark):
    df = log(spark, [1, 2]).withColumn("file_path", F.lit(None).cast("string"))
    assert time_profile(df, ["file_path"]).first().n_ts == 2


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 6)), min_size=1, max_size=14), st.integers(1, 6), st.booleans())
def test_against_one_pass(spark, times, ranges, ordered):
    """The summaries merge to the figures of a plain walk."""
    if ordered:
        times = sorted((t for t in times if t is not None))
        times = times or [0]
    p = profile(spark, times, 1, ranges)
    seen = [(i, t) for i, t in enumerate(times) if t is not None]
    change = next((b[1] - a[1] for a, b in zip(seen, seen[1:]) if b[1] != a[1]), -1)
    bad = next((b[0] for a, b in zip(seen, seen[1:]) if (b[1] - a[1]) * change < 0), None)
    assert (p.n_records, p.violation) == (len(times), bad)
    assert p.null_ts == sum(t is None for t in times[:bad])
    if bad is None:
        gaps = [abs(b[1] - a[1]) * 3_600_000 for a, b in zip(seen, seen[1:])]
        assert (p.n_ts, p.n_gaps) == (len(seen), len(gaps))
        if gaps:
            mean = sum(gaps) / len(gaps)
            assert p.gap_mean_ms == pytest.approx(mean)
            assert p.gap_var_ms == pytest.approx(sum((g - mean) ** 2 for g in gaps) / len(gaps), abs=1e-3)
            assert p.ltg_us == max(gaps) * 1000


def test_top_gaps(spark):
    df = log(spark, [0, 1], "a").union(log(spark, [0, 5], "b")).union(log(spark, [0, 5], "c")).union(log(spark, [3], "d"))
    assert [r.file_path for r in top_gaps(time_profile(df, ["file_path"]), "file_path", 2).collect()] == ["b", "c"]


def test_duplicates(spark):
    df = spark.createDataFrame([("f", 0, "x"), ("f", 1, "x"), ("f", 2, None), ("f", 3, None), ("g", 0, "x"), ("f", 4, "x")], "file string, idx long, v string")
    assert {(r.file, r.n_records, r.n_dupes) for r in duplicates.duplicate_counts(df, ["file"], ["v"]).collect()} == {("f", 5, 3), ("g", 1, 0)}
    assert sorted((r.file, r.idx) for r in duplicates.duplicate_listing(df, ["file"], ["v"]).collect()) == [("f", 1), ("f", 3), ("f", 4)]


def stats(spark, n_ts, dupes, red, gap, mean, std):
    return spark.createDataFrame([(n_ts, dupes, red, gap, mean, std)], "n_ts long, n_dupes long, n_redactions long, ltg_ms long, gap_mean_ms double, gap_std_ms double")


def kinds(df):
    return {(a.kind, a.level) for a in alerts.with_alerts(df).first().alerts}


def test_alert_levels(spark):
    assert kinds(stats(spark, 1000, 20, 2, 60_000, 10.0, 4.0)) == {("SusEventCount", "Medium"), ("DupeEvents", "Medium"), ("RedactionEvents", "Low"), ("SusTimeGap", "High")}
    assert kinds(stats(spark, 0, 0, 0, 0, 1e9, 1.0)) == set()
    assert kinds(stats(spark, 10_000, None, None, None, None, None)) == {("SusEventCount", "High")}
    assert kinds(stats(spark, 7, 0, 0, 5, 5.0, 0.0)) == set()
    assert kinds(stats(spark, 7, 0, 0, 6, 5.0, 0.0)) == {("SusTimeGap", "High")}


def test_merged_moments(spark):
    """Random parts that all overlap: the merged moments are those of all gaps together."""
    rng = np.random.default_rng(9)
    gaps = [rng.integers(1, 5_000, k).astype(float) for k in (1, 4, 30, 7)]
    rows = [(f"p{k}", DAY, DAY + dt.timedelta(days=1), len(g), len(g) + 1, float(g.mean()), float(g.var()), int(g.max()) * 1000) for k, g in enumerate(gaps)]
    parts = spark.createDataFrame(rows, "part string, min_ts timestamp_ntz, max_ts timestamp_ntz, n_records long, n_ts long, gap_mean_ms double, gap_var_ms double, ltg_us long")
    parts = parts.withColumns({"n_dupes": F.lit(0), "n_redactions": F.lit(0), "ltg_begin": F.col("min_ts"), "ltg_end": F.col("max_ts")})
    m, every = multipart.merged(parts, "part").first(), np.concatenate(gaps)
    assert (m.n_gaps, m.gap_mean_ms, m.gap_var_ms, m.n_overlaps) == (len(every), pytest.approx(every.mean()), pytest.approx(every.var()), 3)


def test_merge_equals_profile_of_the_whole(spark):
    random.seed(3)
    times = sorted(random.sample(range(500), 60))
    one = profile(spark, times)
    cut = [times[:20], times[20:21], times[21:]]
    parts = None
    for k, t in enumerate(cut):
        p = time_profile(log(spark, t, f"p{k}"), ["file_path"]).withColumns({"n_dupes": F.lit(1).cast("long"), "n_redactions": F.lit(0).cast("long")})
        parts = p if parts is None else parts.unionByName(p)
    m = multipart.merged(parts, "file_path").first()
    assert (m.n_ts, m.n_gaps, m.ltg_us, m.n_dupes, m.n_overlaps, m.name) == (60, one.n_gaps, one.ltg_us, 3, 0, "3_SUCCESSFUL_INPUT_FILES_COMBINED")
    assert (m.gap_mean_ms, m.gap_var_ms) == pytest.approx((one.gap_mean_ms, one.gap_var_ms))


def test_overlaps(spark):
    parts = spark.createDataFrame([("t1", 2, 0, 10), ("t2", 2, 5, 8), ("t3", 2, 9, 12), ("t4", 2, 12, 13), ("t5", 0, None, None)], "name string, n_ts long, a int, b int").select("name", "n_ts", *[(F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col(c))).cast("timestamp_ntz").alias(n) for c, n in (("a", "min_ts"), ("b", "max_ts"))])
    assert [(r.holder, r.part) for r in multipart.overlaps(parts, "name").orderBy("_rank").collect()] == [("t1", "t2"), ("t1", "t3")]
