"""Whole runs over small files of every kind."""

import csv
import datetime as dt
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from logtide.__main__ import main
from logtide.config import Settings, user_formats
from logtide.functions import jsonpaths
from logtide.functions.timestamps import spark_pattern
from logtide.plans import analyze, sinks
from logtide.sources import records as R

BASIC = "id,name,date\n1,alpha,2024-02-28 22:15:00\n2,beta,2024-02-29 06:45:30\n3,core,2024-03-04 22:15:00\n"


def run(spark, tmp_path, files, **settings):
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return analyze.analyze(spark, Settings(str(tmp_path), block=4, **settings))


def one(spark, tmp_path, name, text, **settings):
    r = run(spark, tmp_path, {name: text}, **settings)
    return r.stats.first(), r


def test_csv(spark, tmp_path):
    s, r = one(spark, tmp_path, "a.csv", BASIC)
    assert (s.n_records, s.n_ts, s.column, s.first_data_row, s.n_errors) == (3, 3, "date", 1, 0)
    assert (s.min_ts, s.max_ts) == (dt.datetime(2024, 2, 28, 22, 15), dt.datetime(2024, 3, 4, 22, 15))
    assert s.sha256 == hashlib.sha256(BASIC.encode()).hexdigest()
    row = analyze.report(r).first()
    assert row["Duration of Entire Log File (Hours)"] == "120:00:00" and row["Error"] == "" and len(row) == 22


def test_csv_junk_above_the_header(spark, tmp_path):
    s, _ = one(spark, tmp_path, "a.csv", "garbage\n" + BASIC)
    assert (s.first_data_row, s.n_records, s.n_errors, s.min_ts) == (2, 3, 0, dt.datetime(2024, 2, 28, 22, 15))


def test_csv_duplicates_and_redactions(spark, tmp_path):
    s, r = one(spark, tmp_path, "a.csv", BASIC.replace("3,core", "2,beta,2024-02-29 06:45:30\n3,c******e"))
    assert (s.n_dupes, s.n_redactions, s.n_errors) == (1, 1, 0)
    assert [x.idx for x in sinks.duplicate_details(r).collect()] == [2]
    assert [(x.idx, x.note) for x in sinks.redaction_details(r).collect()] == [(3, "Asterisks")]


def test_quick_leaves_nulls(spark, tmp_path):
    s, _ = one(spark, tmp_path, "a.csv", BASIC, quick=True)
    assert (s.n_dupes, s.n_redactions, s.sha256, s.n_ts) == (None, None, None, 3)


def test_csv_times_that_do_not_match(spark, tmp_path):
    s, r = one(spark, tmp_path, "a.csv", BASIC.replace("3,core", "2,beta,soon\n2,bet,later\n3,core"))
    assert (s.n_errors, s.n_ts, s.max_ts) == (2, 3, dt.datetime(2024, 3, 4, 22, 15))


def test_csv_time_that_can_not_be_parsed_ends_the_file(spark, tmp_path):
    s, r = one(spark, tmp_path, "a.csv", BASIC + "4,dust,2025-13-01 00:00:00\n")
    assert (s.n_records, s.n_ts, s.n_dupes, s.min_ts, s.n_errors) == (0, 0, None, None, 1)
    assert r.errors.first().level == "Critical"


FATAL = {
    "blind.csv": BASIC.replace("2,beta,2024-02-29 06:45:30", "2,beta,soon"),
    "still.csv": "id,name,date\n1,a,2024-02-28 22:15:00\n2,b,2024-02-28 22:15:00\n3,c,never\n",
    "narrow.csv": BASIC + "4,x\n",
    "bool.json": '{"t":"2024-02-28 22:15:00"}\n{"t":"2024-02-28 22:16:00"}\n{"t":true}\n',
    "list.json": '{"t":"2024-02-28 22:15:00"}\n{"t":[]}\n',
    "number.json": '{"t":"2024-02-28 22:15:00"}\n{"t":17}\n{"x":1}\n',
}


def test_what_ends_a_file(spark, tmp_path):
    """A time missing before the direction is known, a missing column, a field that can't hold a time; a number may."""
    r = run(spark, tmp_path, FATAL)
    got = {x.file_name: (x.n_records, x.n_ts, x.broken_at, x.n_errors) for x in r.stats.collect()}
    assert got == {"blind.csv": (0, 0, 1, 1), "still.csv": (0, 0, 2, 1), "narrow.csv": (0, 0, 3, 1), "bool.json": (0, 0, 2, 1), "list.json": (0, 0, 1, 1), "number.json": (3, 1, None, 2)}
    assert {x.level for x in r.errors.where("file_path NOT LIKE '%number%'").collect()} == {"Critical"}


def test_detail_files_read_back(spark, tmp_path):
    """Each log's details are one CSV with its own header, and the fields come back as they were."""
    (tmp_path / "in").mkdir()
    odd = 'id,"na,me",date\n1,"a ""b"", *** c\nd",2024-02-28 22:15:00\n1,"a ""b"", *** c\nd",2024-02-28 22:15:00\n2,,2024-02-29 22:15:00\n2,,2024-02-29 22:15:00\n'
    r = run(spark, tmp_path / "in", {"a.csv": odd, "b.log": "x 2024-02-28 22:15:00\nx 2024-02-28 22:15:00\n", "c.csv": BASIC})
    sinks.write_all(r, str(tmp_path / "out"))

    def read(kind, log):
        text = "".join(f.read_text() for f in sorted((tmp_path / "out" / kind / f"log={log}").glob("part-*")))
        return list(csv.reader(io.StringIO(text, newline="")))

    cell = 'a "b", *** c\nd'
    dupes = read("Duplicates", "a")
    assert dupes[0] == ["Index of Hit", "Hash of Record", "id", "na,me", "date"]
    assert [(x[0], x[2:]) for x in dupes[1:]] == [("1", ["1", cell, "2024-02-28 22:15:00"]), ("3", ["2", "", "2024-02-29 22:15:00"])]
    assert read("Redactions", "a")[1:] == [[k, "Asterisks", "1", cell, "2024-02-28 22:15:00"] for k in ("0", "1")]
    assert read("Duplicates", "b")[0] == ["Index of Hit", "Hash of Record", "Record"] and not (tmp_path / "out/Duplicates/log=c").exists()


def test_csv_out_of_order(spark, tmp_path):
    body = "".join(f"{i},a,2025-05-0{d} 10:00:00\n" for i, d in enumerate([1, 2, 3, 4, 2, 5]))
    s, r = one(spark, tmp_path, "a.csv", "id,name,date\n" + body)
    assert (s.violation, s.n_records, s.n_ts, s.min_ts) == (4, 6, 0, None)
    assert "4" in r.errors.first().reason


def test_csv_without_times(spark, tmp_path):
    s, r = one(spark, tmp_path, "a.csv", "id,name,x\n1,a,b\n1,a,b\n2,a,c\n")
    assert (s.format, s.n_errors, s.n_dupes, s.n_ts) == (None, 1, 1, 0)


def test_csv_quoted_line_break_and_named_field(spark, tmp_path):
    text = 'id,note,a,b\n1,"two\nlines, ""quoted""",2025-01-01 00:00:00,2024-01-01 00:00:00\n2,x,2025-01-02 00:00:00,2024-01-03 00:00:00\n'
    s, r = one(spark, tmp_path, "a.csv", text, timestamp_field="b")
    assert (s.n_records, s.column, s.max_ts) == (2, "b", dt.datetime(2024, 1, 3))
    assert r.records.where("idx = 0").first().fields[1] == 'two\nlines, "quoted"'


def test_csv_blank_lines_are_no_records(spark, tmp_path):
    s, _ = one(spark, tmp_path, "a.csv", BASIC.replace("2,beta", "\n2,beta") + "\n\n")
    assert (s.n_records, s.n_errors) == (3, 0)


def test_csv_wider_row(spark, tmp_path):
    s, _ = one(spark, tmp_path, "a.csv", "id,name\n1,b,2025-01-01 00:00:00\n2,c,2025-01-02 00:00:00\n")
    assert (s.first_data_row, s.n_records, s.n_ts, s.column) == (2, 1, 1, "2025-01-01 00:00:00")


def test_json(spark, tmp_path):
    lines = ['{"user":{"time":"2020-01-01 00:00:00"},"timestamp":"2025-01-01 00:00:00"}', "", '{"timestamp":"2025-01-02 00:00:00"}']
    s, _ = one(spark, tmp_path, "a.json", "\n".join(lines) + "\n\n")
    assert (s.column, s.n_records, s.n_ts, s.n_errors) == ("/timestamp", 2, 2, 0)


def test_json_named_path_and_bad_line(spark, tmp_path):
    lines = ['{"user":{"time":"1672534800"},"timestamp":"2025-01-01 00:00:00"}', "{oops", '{"user":{"time":1672534900}}']
    s, r = one(spark, tmp_path, "a.jsonl", "\n".join(lines), timestamp_field="user->time")
    assert (s.column, s.n_records, s.n_ts) == ("/user/time", 3, 2)
    assert [(a.kind, a.level) for a in s.alerts] == [("JsonError", "High")]
    assert [x.idx for x in r.errors.collect()] == [1]


ODD_JSON = ["[" * 200_000, "[" * 128 + "]" * 128, '{"a":"\\ud800"}', '{"\\udc00":1}', '{"a":1e400}', '{"a":-1e999}', '{"a":NaN}', '{"a":1} x', "[1" + "0" * 5_000 + "]", '{"a"']


def test_json_lines_that_are_odd_are_errors(spark, tmp_path):
    """Deep nesting, halves of surrogate pairs, numbers without end: each is an error of its line, and no more."""
    good = [f'{{"t":"2025-01-0{k} 00:00:00","deep":{"[" * 100 + "1" + "]" * 100}}}' for k in (1, 2)]
    s, r = one(spark, tmp_path, "a.json", "\n".join([good[0], *ODD_JSON, good[1]]))
    assert (s.n_records, s.n_ts, s.n_errors, s.column) == (len(ODD_JSON) + 2, 2, len(ODD_JSON), "/t")
    assert {(x.idx, x.level) for x in r.errors.collect()} == {(k + 1, "Critical") for k in range(len(ODD_JSON))}
    lines = spark.createDataFrame([(x,) for x in [*ODD_JSON, None, '{"b":{"a":[1,{"c":"\\ud83d\\ude00"}],"b":1e2}}']], "line string")
    got = [x.leaves for x in lines.select(jsonpaths.leaves(F.col("line")).alias("leaves")).collect()]
    assert got[:-1] == [None] * (len(ODD_JSON) + 1) and [tuple(x) for x in got[-1]] == [("/b/a/0", "1", "number"), ("/b/a/1/c", "😀", "text"), ("/b/b", "100.0", "number")]


def test_json_named_number_ends_the_file(spark, tmp_path):
    s, r = one(spark, tmp_path, "a.jsonl", '{"user":{"time":1672534800}}\n{"user":{"time":"1672534900"}}', timestamp_field="user->time")
    assert (s.n_records, s.n_ts, s.broken_at, s.n_errors) == (0, 0, 0, 1) and r.errors.first().level == "Critical"


def test_json_first_line_bad(spark, tmp_path):
    s, _ = one(spark, tmp_path, "a.json", '{oops\n{"t":"2025-01-01 00:00:00"}\n')
    assert (s.n_records, s.n_ts, s.min_ts, s.format) == (2, 0, None, None)


def test_text(spark, tmp_path):
    s, _ = one(spark, tmp_path, "a.log", "junk\r\nmore\r\nx 2025-05-09 10:00:00\r\ny 2025-05-09 11:00:00\r\nz 2025-05-09 12:00:00\r\n")
    assert (s.n_records, s.n_ts, s.n_errors, s.n_dupes) == (5, 3, 2, 0)


def test_kinds_of_files(spark, tmp_path):
    for n in ("a.csv", "b.CSV", "c.json", "d.jsonl", "e.log", "noext", "f.tar.csv"):
        (tmp_path / n).write_text("x\n")
    got = {r.file_name: r.log_type for r in R.list_files(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": "csv", "b.CSV": "text", "c.json": "json", "d.jsonl": "json", "e.log": "text", "noext": None, "f.tar.csv": "csv"}


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(5000)))
    (tmp_path / "b.log").write_text("".join(f"line {i}\n" for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = R.numbered_lines(spark, [str(tmp_path)])
        assert lines.where(F.col("line") != F.concat(F.lit("line "), "idx")).count() == 0
        assert lines.count() == 5300
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def csv_text(rng, n):
    """Records with quotes, doubled quotes, line breaks, commas, quotes inside plain fields, empty lines."""
    cell = lambda: "".join(rng.choice(["a", "b", ",", "\n", '"', "\r\n", " ", "é"]) for _ in range(rng.randrange(9)))
    lines = []
    for _ in range(n):
        cells = [('"' + cell().replace('"', '""') + '"') if rng.random() < 0.5 else rng.choice(["", "x", 'in"side', "é "]) for _ in range(rng.randrange(1, 5))]
        lines.append(",".join(cells) + rng.choice(["\n", "\r\n", "\n\n"]))
    return "".join(lines)


@pytest.mark.parametrize("size", [40, 700, 1_000_000])
def test_quoted_csv_over_splits(spark, tmp_path, size):
    """Files larger than a split, with line breaks in quotes, are what Python's csv reads; a record may span splits."""
    rng = random.Random(size)
    texts = {"a.csv": csv_text(rng, 300), "b.csv": "plain,x\n" * 50, "c.csv": 'open,"never\nclosed,"" at all\n' * 3, "d.csv": 'h,i\n1,"' + "long\n" * 900 + '"\n2,x\n', "e.csv": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = {}
        for r in R.csv_records(spark, [str(tmp_path)]).collect():
            got.setdefault(r.file_path.rsplit("/", 1)[1], {})[r.idx] = r.fields
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text in texts.items():
        want = [x for x in csv.reader(io.StringIO(text, newline="")) if x]
        if name == "c.csv":
            want[-1][-1] = want[-1][-1].removesuffix("\n")
        assert [got.get(name, {})[k] for k in sorted(got.get(name, {}))] == want and sorted(got.get(name, {})) == list(range(len(want))), name


def test_long_csv_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,date\n" + "x" * 300_000 + ",2024-02-28 22:15:00\n")
    assert [len(r.fields[0]) for r in R.csv_records(spark, str(tmp_path / "a.csv")).orderBy("idx").collect()] == [2, 300_000]


LATER = "id,name,date\n7,delta,2024-03-02 09:00:00\n8,echo,2024-03-03 10:00:00\n9,fox,2024-04-02 11:30:00\n"


def test_multipart(spark, tmp_path):
    r = run(spark, tmp_path, {"a.csv": BASIC, "b.csv": BASIC.replace("2024-0", "2028-0"), "c.csv": LATER})
    m = analyze.merged(r).first()
    assert (m.n_ts, m.n_overlaps, m.name) == (9, 1, "3_SUCCESSFUL_INPUT_FILES_COMBINED")
    over = [a for a in analyze.merged_alerts(r, analyze.merged(r)).collect() if a.kind == "MultipartOverlap"]
    assert [(a.level, a.message, a.file_path.rsplit("/", 1)[1]) for a in over] == [("Medium", "a.csv overlaps c.csv", "c.csv")]


def test_merged_log_keeps_json_errors(spark, tmp_path):
    good = '{"time": "2025-05-09 10:00:00"}\n{"time": "2025-05-09 11:00:00"}\n'
    r = run(spark, tmp_path, {"a.json": good, "b.json": good.replace("05-09", "05-10") + "{oops\n"})
    m = analyze.merged(r).first()
    assert ("JsonError", "High") in {(a.kind, a.level) for a in m.alerts}


def test_merged_log_is_what_is_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    r = run(spark, tmp_path / "in", {"a.csv": BASIC, "c.csv": LATER}, multipart=True)
    sinks.write_all(r, str(tmp_path / "out"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "out/statistics")).collect()
    assert [(x["Filename"], x["Total Number of Records"], x["SHA256 Hash"]) for x in rows] == [("2_SUCCESSFUL_INPUT_FILES_COMBINED", "6", None)]
    assert any("MultipartOverlap" in x.value and "overlaps" in x.value for x in spark.read.text(str(tmp_path / "out/alerts")).collect())


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(BASIC + "3,core,2024-03-04 22:15:00\n")
    assert main(["-i", str(tmp_path / "in"), "-o", str(tmp_path / "out")]) == 0
    assert {p.name for p in (tmp_path / "out").iterdir()} >= {"statistics", "errors", "alerts", "Duplicates", "Redactions"}
    assert main(["-p"]) == 0 and "Epoch" in capsys.readouterr().out


def test_user_formats(spark, tmp_path):
    (tmp_path / "f.yml").write_text('- pretty_format: "Mon D, YYYY"\n  regex: "[A-Za-z]{3} \\\\d{1,2}, \\\\d{4} \\\\d{2}:\\\\d{2}"\n  strftime_format: "%b %e, %Y %H:%M"\n')
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("Jan 5, 2025 10:30\nJan 6, 2025 10:30\n")
    s = analyze.analyze(spark, Settings(str(tmp_path / "in"), formats=user_formats(str(tmp_path / "f.yml")))).stats.first()
    assert (s.n_ts, s.min_ts) == (2, dt.datetime(2025, 1, 5, 10, 30))


def test_patterns():
    assert spark_pattern("date=%Y-%m-%d") == "'d''a''t''e'=yyyy-MM-dd".replace("''", "")
    with pytest.raises(ValueError):
        spark_pattern("%Q")


def test_stored_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from logtide.session import stored

    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stored(SimpleNamespace(sparkSession=spark))


def test_hashes_of_files_of_any_size(spark, tmp_path):
    rnd = random.Random(8)
    mark = b"\xef\xbb\xbf"
    files = {"breaks": b"\n\n\n\n", "mark": mark + b"ab\ncd", "mark_and_break": mark + b"ab\ncd\n", "inner_mark": b"a\n" + mark, "mark_alone": mark, "returns": b"a\r\nb\r\n\r\n", "bytes": rnd.randbytes(300_000), "lines": b"".join(b"line %d\n" % i for i in range(20_000))}
    for name, content in files.items():
        (tmp_path / f"{name}.log").write_bytes(content)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "70000")
    try:
        for whole in (R.WHOLE, 0):  # each file as one value; nearly all line by line, over splits
            got = {r.file_path.rsplit("/", 1)[1][:-4]: r.sha256 for r in R.file_hashes(spark, str(tmp_path), whole).collect()}
            assert got == {name: hashlib.sha256(content).hexdigest() for name, content in files.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_names_of_files_stay_as_they_are(spark, tmp_path):
    names = ["a b.csv", "a%20b.csv", "a+b.csv", "ü#1.csv", "c d.json", "e=%.txt"]
    r = run(spark, tmp_path, {n: '{"date": "2024-01-01 00:00:00"}\n' if n.endswith("json") else BASIC for n in names})
    got = {x.file_path.rsplit("/", 1)[1]: x.n_ts for x in r.stats.collect()}
    assert got == {n: 1 if n.endswith("json") else 3 for n in names}


def test_scans_read_only_files_of_their_kind(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"{k}.csv").write_text(BASIC)
    (tmp_path / "one.jsonl").write_text("{}\n")
    (tmp_path / "none").write_text("no kind\n")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a file in each task
    try:
        tasks = {kind: R._lines(spark, str(tmp_path), kind).rdd.getNumPartitions() for kind in (*R.READERS, None)}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert tasks == {"csv": 12, "json": 1, "text": 0, None: 14}
