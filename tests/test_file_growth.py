"""Steps over files that decide how a run grows with them: each does its work once, and results stay."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logtide.config import builtin_formats
from logtide.functions import jsonpaths
from logtide.operators import detect
from logtide.sources import records as R


def test_listing_gives_a_task_many_folders(spark, tmp_path):
    """left alone, Spark lists each of so many folders in a task of its own, for each reader."""
    for k in range(60):
        (tmp_path / f"log={k}").mkdir()
        (tmp_path / f"log={k}" / "a.csv").write_text("x,y\n1,2\n")
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    sc.setJobGroup("listing", "")
    assert R.list_files(spark, str(tmp_path)).count() == 60
    assert R.csv_records(spark, str(tmp_path), "csv").count() == 120
    sc.setJobGroup("", "")
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 4 * sc.defaultParallelism < 60
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def test_csv_is_parsed_once(spark, tmp_path):
    """readers of records find them stored, whole ones and those across splits, instead of parsing once for each kind."""
    (tmp_path / "a.csv").write_text('x,y\n1,"2\n3"\n')
    records = R.csv_records(spark, str(tmp_path), "csv")
    assert "MapInArrow" not in records._jdf.queryExecution().executedPlan().toString()
    assert [(r.idx, r.fields) for r in records.orderBy("idx").collect()] == [(0, ["x", "y"]), (1, ["1", "2\n3"])]


@pytest.mark.parametrize("size", ["40b", "1k"])
def test_csv_in_files_of_one_and_of_several_splits(spark, tmp_path, size):
    """splits of a file that is whole begin outside of quotes; others are told, side by side."""
    texts = {"one.csv": "x\n", "long.csv": "".join(f'{k},"a\n""{k}"",\n"\n\n' for k in range(12)), "open +%.csv": 'a,"b\nc,d\n' * 3}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, size)
    try:
        got = R.csv_records(spark, str(tmp_path), "csv").collect()
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
    for name, text in texts.items():
        fields, lines, held = R._records_with_returns(text.split("\n")[:-1])
        if held:
            fields, lines = [*fields, R.fields_of("\n".join(held))], [*lines, "\n".join(held)]
        mine = sorted((r.idx, r.fields, r.line) for r in got if r.file_path.endswith("/" + name))
        assert mine == list(zip(range(len(lines)), fields, lines, strict=True))


def test_csv_records_by_the_library_and_by_hand():
    """fields, texts and what stays open, for random lines."""
    rng = random.Random(7)
    for _ in range(20_000):
        lines = ["".join(rng.choices('",a\r \x00\u2028é', [5, 4, 4, rng.choice([0, 0, 1]), 1, 0.2, 0.2, 0.5], k=rng.randrange(7))) + rng.choice(["", "", "\r"]) for _ in range(rng.randrange(6))]
        assert R._records(lines) == R._records_with_returns(lines)


@pytest.mark.parametrize("kind", ["json", "text"])
def test_paths_are_spelled_once_a_split(spark, tmp_path, kind):
    """lines carry their file's URI; decoding it for each of them took most of the reading."""
    (tmp_path / ("a +%.jsonl" if kind == "json" else "a +%.log")).write_text("1\n\n2\r\n")
    records = R.READERS[kind](spark, str(tmp_path), kind)
    plan = records._jdf.queryExecution().analyzed().toString()
    assert plan.count("url_decode") == 1 and plan.index("url_decode") < plan.index("Aggregate")
    assert {r.file_path for r in records.collect()} == {r.file_path for r in R.list_files(spark, str(tmp_path)).collect()}


@pytest.mark.parametrize("name,kind", [("a.csv", "csv"), ("a.b.jsonl", "json"), ("a.json", "json"), ("a.CSV", "text"), ("a", None), ("a.", None), (".csv", None), ("..csv", "csv"), ("x.d/a", None), ("a.csv.gz", "text"), ("é.csv", "csv")])
def test_kinds_of_names(spark, name, kind):
    assert spark.createDataFrame([(f"file:/t.json/{name}",)], "p string").select(R.log_type(F.col("p"))).first()[0] == kind


def test_text_format_beyond_the_first_lines(spark):
    """only files without a time in their first lines are searched whole; the first line that holds one decides."""
    at = {"early": {1: "2024-01-02 03:04:05", 5: "1704164645"}, "late": {4: "1704164645", 5: "2024-01-02 03:04:05"}, "never": {}}
    rows = [(f, k, found.get(k, "soon")) for f, found in at.items() for k in range(7)]
    records = spark.createDataFrame(rows, "file_path string, idx long, line string")
    for head in (1, 3, 4, 5, 100):
        b = detect.text_binding(records, builtin_formats(), head)
        assert {r.file_path: r.format for r in b.collect()} == {"early": 2, "late": 6}


def test_times_are_read_in_formats_that_occur(spark):
    """F1 to F3: formats no file has aren't in the code of every record."""
    records = spark.createDataFrame([("a", "2024-01-02 03:04:05", 2), ("b", "1704164645", None)], "file_path string, line string, format int")
    timed = detect.with_times(records, F.col("line"), builtin_formats(), records.where("format is not null"))
    assert [(r.matched, str(r.ts)) for r in timed.orderBy("file_path").collect()] == [(True, "2024-01-02 03:04:05"), (False, "None")]
    assert "Epoch" not in str(timed.schema) and timed._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") + timed._jdf.queryExecution().optimizedPlan().toString().count("rlike") <= 2


def test_json_leaves_of_a_batch():
    """a batch's leaves are made in columns, lines without any and broken ones between."""
    lines = ['{"a": {"b": 1, "c": []}}', None, "3", "{", '"\\ud800"', "{}", '{"x": "y"}']
    got = jsonpaths._parsed(pa.array(lines)).to_pylist()
    for line, one in zip(lines, got, strict=True):
        leaves, error = jsonpaths.taken_apart(line)
        assert one["error"] == error and (one["leaves"] is None) == (leaves is None)
        assert [tuple(x.values()) for x in one["leaves"] or ()] == (leaves or [])
    assert jsonpaths._parsed(pa.array([], pa.string())).to_pylist() == []
