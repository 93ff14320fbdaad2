"""Files as records: (file_path, idx, fields, line).

``idx`` is the record's number in its file, from 0: physical lines for JSON and text,
parsed records behind nothing skipped for CSV. Files are read in splits; a record's
number is its row in the split plus the rows of the splits before it, so a huge file
needs no sort and no task of its own, quoted line breaks or not.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import pairwise
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import importable, stored

#: Splits up to which their offsets are broadcast; beyond that they are joined by a shuffle.
BROADCAST_SPLITS = 200_000
#: Bytes of a file up to which it is hashed as one value.
WHOLE = 64 << 20
#: UTF-8's byte order mark
MARK = b"\xef\xbb\xbf"
SCHEMA = "file_path string, idx long, fields array<string>, line string"


def log_type(path: Column) -> Column:
    """csv, json, text by extension (case matters); null without an extension."""
    name = F.substring_index(path, "/", -1)
    ext = F.substring_index(name, ".", -1)
    return F.when((ext == "") | (F.length(name) <= F.length(ext) + 1), F.lit(None)).when(ext == "csv", "csv").when(ext.isin("json", "jsonl"), "json").otherwise("text").cast("string")


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """While a reader lists what it reads: a task takes many folders. Left alone, each folder is a task."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _binary(spark: SparkSession, path: str) -> DataFrame:
    with _listing(spark):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _text(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    with _listing(spark):
        return spark.read.option("recursiveFileLookup", "true").text(paths, lineSep="\n")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """file_path, file_name, size, log_type of all files below a folder, or of one file; contents aren't read."""
    return _binary(spark, path).select(F.col("path").alias("file_path"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), F.col("length").alias("size"), log_type(F.col("path")).alias("log_type"))


def file_hashes(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """file_path, sha256: of each file's bytes, in lower-case hexadecimal.

    Files of up to ``whole`` bytes are hashed where they are read. The bytes of larger ones pass
    through their hash line by line, in order, so that no row holds a file: the lines are
    sorted by their place (which spills), a file in one task, as each of its blocks is
    hashed behind the one before. Files without a byte are no files to Spark's readers and have no row."""
    importable(spark)
    whole = max(whole, len(MARK))  # a mark alone is a file without a line
    files = _binary(spark, path)
    small = files.where(F.col("length") <= whole).select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("sha256"))
    lines = _text(spark, path).where(F.col("_metadata.file_size") > whole)
    rows = lines.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"), F.col("value").cast("binary").alias("line"))
    in_order = rows.repartition("file_path").sortWithinPartitions("file_path", "_split", "_row").select("file_path", "size", "line")
    return small.unionByName(in_order.mapInArrow(_hashed, "file_path string, sha256 string").withColumn("file_path", _path("file_path")))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each file whose lines pass by. Line breaks stand between them; whether one ends the file,
    and whether a byte order mark, which the reader takes away, begins it, shows in the size."""
    now, size, seen, plain, marked = None, 0, 0, None, None

    def row():
        left = size - seen
        h = marked if left >= len(MARK) else plain
        if left % len(MARK):
            h.update(b"\n")
        return pa.RecordBatch.from_pylist([{"file_path": now, "sha256": h.hexdigest()}])

    for b in batches:
        for path, n, line in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if path != now:
                if now is not None:
                    yield row()
                now, size, seen, plain, marked = path, n, 0, hashlib.sha256(), hashlib.sha256(MARK)
            else:
                line = b"\n" + line
            seen += len(line)
            plain.update(line)
            marked.update(line)
    if now is not None:
        yield row()


def _paths(files: Sequence[str] | str) -> list[str]:
    return [files] if isinstance(files, str) else list(files)


def _path(uri: str) -> Column:
    """A file, spelled as list_files spells it, from its URI. For rows of splits or files: a line is too many."""
    return F.regexp_replace(F.url_decode(F.replace(F.col(uri), F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")


def _lines(spark: SparkSession, files: Sequence[str] | str, kind: str | None) -> DataFrame:
    """The lines of these files or of all below a folder; of one kind, if it is given. The kind is asked of the
    file's name, so Spark drops the other files when it plans the scan, and no list of files is held here."""
    raw = _text(spark, _paths(files))
    return raw if kind is None else raw.where(log_type(F.col("_metadata.file_path")) == kind)


def numbered_lines(spark: SparkSession, files: Sequence[str] | str, kind: str | None = None) -> DataFrame:
    """file_path, idx, line of every line; a trailing carriage return goes."""
    raw = _lines(spark, files, kind)
    line = F.when(F.endswith("value", F.lit("\r")), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
    rows = raw.select(F.col("_metadata.file_path").alias("_uri"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"), line.alias("line"))
    splits = rows.groupBy("_uri", "_split").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy("_uri").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_uri", "_split", _path("_uri").alias("file_path"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    few = raw.rdd.getNumPartitions() <= BROADCAST_SPLITS
    joined = rows.join(F.broadcast(offsets) if few else offsets, ["_uri", "_split"])
    return joined.select("file_path", (F.col("_row") - F.col("_first") + F.col("_offset")).alias("idx"), "line")


def text_records(spark: SparkSession, files: Sequence[str] | str, kind: str | None = None) -> DataFrame:
    """Every line is a record, blank ones included."""
    return numbered_lines(spark, files, kind).select("file_path", "idx", F.array("line").alias("fields"), "line")


def json_records(spark: SparkSession, files: Sequence[str] | str, kind: str | None = None) -> DataFrame:
    """Every line that isn't blank is a record; it keeps the number of its line."""
    return text_records(spark, files, kind).where(F.trim("line") != "")


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open behind a line that begins outside or inside of one."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
        elif line[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        inside, at = False, line.find(",", at) + 1  # what follows a closing quote belongs to its field
        if not at:
            return False


def fields_of(record: str) -> list[str]:
    """The fields of one record. A quote opens a field only at its start; two inside are one."""
    if '"' not in record:
        return record.split(",")
    out, at, n = [], 0, len(record)
    while True:
        text = ""
        if record[at : at + 1] == '"':
            at += 1
            while True:
                end = record.find('"', at)
                if end < 0:  # never closed
                    return [*out, text + record[at:]]
                text += record[at:end]
                at = end + 1
                if record[at : at + 1] != '"':
                    break
                text, at = text + '"', at + 1
        end = record.find(",", at)
        if end < 0:
            return [*out, text + record[at:n]]
        out.append(text + record[at:end])
        at = end + 1


def _texts(column: pa.Array) -> list[str]:
    """Texts of a column; bytes that aren't UTF-8 are replaced."""
    try:
        return column.to_numpy(zero_copy_only=False).tolist()
    except (UnicodeDecodeError, pa.ArrowException):
        return [x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _splits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], bool]]:
    """(the row of a split's columns in front of ``line``, _uri and _split first, some of its lines in their order, whether its first are among them)."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        *heads, lines = b.columns
        files, splits = heads[0].dictionary_encode().indices.to_numpy(), heads[1].to_numpy()
        ends = np.flatnonzero((files[1:] != files[:-1]) | (splits[1:] != splits[:-1])) + 1
        texts = _texts(lines)
        for at, to in pairwise([0, *ends.tolist(), b.num_rows]):
            head = tuple(c[at].as_py() for c in heads)
            yield head, texts[at:to], head != last
            last = head


def _quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: where it ends and how many records begin in it, if it begins outside or inside of quotes."""
    now, state, count = None, [False, True], [0, 0]

    def row():
        return pa.RecordBatch.from_pylist([{"_uri": now[0], "_split": now[1], "end_out": state[0], "end_in": state[1], "n_out": count[0], "n_in": count[1]}])

    for head, lines, new in _splits_of(batches):
        if new:
            if now is not None:
                yield row()
            now, state, count = head, [False, True], [0, 0]
        for line in lines:
            plain = '"' not in line
            for k in (0, 1):
                if not state[k] and line not in ("", "\r"):
                    count[k] += 1
                if not plain:
                    state[k] = open_after(line, state[k])
    if now is not None:
        yield row()


_PARSED = pa.schema([("file_path", pa.string()), ("idx", pa.int64()), ("fields", pa.list_(pa.string())), ("line", pa.string()), ("_split", pa.int64())])


def _ended(text: str) -> str:
    """A record's text without its carriage return."""
    return text[:-1] if text.endswith("\r") else text


def _records(lines: list[str]) -> tuple[list[list[str]], list[str], list[str]]:
    """Fields and texts of the records in lines that begin outside of quotes, and the lines of a last one that is still open."""
    text = "\n".join([*lines, ""])
    returns = text.count("\r")
    if returns != text.count("\r\n"):  # the csv module ends records at these, too
        return _records_with_returns(lines)
    fields, texts, at, begun = [], [], 0, 0
    reader = csv.reader(io.StringIO(text, newline="\n"))
    for row in reader:
        to = reader.line_num
        if row:  # an empty line has none
            fields.append(row)
            texts.append(lines[at] if to == at + 1 else "\n".join(lines[at:to]))
            begun = at
        at = to
    inside = False
    for line in lines[begun:]:
        inside = open_after(line, inside)
    if inside:
        fields.pop()
        texts.pop()
    return fields, [_ended(t) for t in texts] if returns else texts, lines[begun:] if inside else []


def _records_with_returns(lines: list[str]) -> tuple[list[list[str]], list[str], list[str]]:
    """The same where carriage returns stand within lines."""
    texts, held, inside = [], [], False
    for line in lines:
        if inside or line not in ("", "\r"):
            held.append(line)
            inside = open_after(line, inside)
            if not inside:
                texts.append(_ended("\n".join(held)))
                held = []
    return [fields_of(t) for t in texts], texts, held


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records whole in their split with fields; those that begin or end in another one as pieces, with their split and without fields."""
    csv.field_size_limit(sys.maxsize)
    now, path, inside, number, held = None, None, False, 0, []
    carried = False  # whether the open record has begun in an earlier split

    def made(first: int, fields: list, texts: list[str], split: int | None = None) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path, pa.string()), n), pa.array(np.arange(first, first + n)), pa.array(fields, pa.list_(pa.string())), pa.array(texts, pa.string()), pa.array([split] * n, pa.int64())], schema=_PARSED)

    for head, lines, new in _splits_of(batches):
        if new:
            if held:
                yield made(number - 1, [None], ["\n".join(held)], now[1])
            now, inside, number, held = head, head[2], head[3], []
            uri = unquote(head[0])
            path, carried = "file:/" + uri.removeprefix("file:///") if uri.startswith("file:///") else uri, inside
        at = 0
        while inside and at < len(lines):
            held.append(lines[at])
            inside = open_after(lines[at], True)
            at += 1
        if inside:
            continue
        if held:
            text = "\n".join(held)
            yield made(number - 1, [None], [text], now[1]) if carried else made(number - 1, [fields_of(_ended(text))], [_ended(text)])
        fields, texts, held = _records(lines[at:])
        if texts:
            yield made(number, fields, texts)
        inside, carried, number = bool(held), False, number + len(texts) + bool(held)
    if held:
        yield made(number - 1, [None], ["\n".join(held)], now[1])


def _uncut(spark: SparkSession) -> int:
    """Bytes up to which Spark surely doesn't cut a file into splits; 0 if the settings don't tell."""
    sizes = [re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(f"spark.sql.files.{key}").strip().lower()) for key in ("maxPartitionBytes", "openCostInBytes")]
    return min(int(m[1]) << 10 * " kmgtp".index(m[2] or " ") for m in sizes) if all(sizes) else 0


def csv_records(spark: SparkSession, files: Sequence[str] | str, kind: str | None = None) -> DataFrame:
    """Ragged records; empty lines are none.

    A line break may stand in quotes, so where a split begins depends on all before it. Each
    split of a file that has several first tells, for a begin outside and one inside of quotes, how it ends and
    how many records begin in it; these functions are composed along each file, one row a split. A file in one split
    begins outside. Then every split is parsed where it lies, once, and stored; only records that cross
    its ends are put together."""
    importable(spark)
    raw = _lines(spark, files, kind)
    place = [F.col("_metadata.file_path").alias("_uri"), F.col("_metadata.file_block_start").alias("_split")]
    rows = raw.select(*place, F.col("value").alias("line"))
    cut = raw.where(F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).select(*place, F.col("value").alias("line"))
    told = cut.mapInArrow(_quotes, "_uri string, _split long, end_out boolean, end_in boolean, n_out long, n_in long")
    earlier = Window.partitionBy("_uri").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_uri").orderBy("_split").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a split leaves the state as it is, turns it round, or sets it
    turned = told.withColumn("_turns", F.sum((F.col("end_out") & ~F.col("end_in")).cast("int")).over(upto))
    known = F.last(F.when(F.col("end_out") == F.col("end_in"), F.struct(F.col("end_out").cast("int").alias("state"), F.col("_turns").alias("turns"))), ignorenulls=True).over(earlier)
    turns = F.coalesce(F.lag("_turns").over(Window.partitionBy("_uri").orderBy("_split")), F.lit(0))
    begun = turned.withColumns({"_known": known, "_before": turns}).withColumn("_inside", (F.coalesce(F.col("_known.state"), F.lit(0)) + F.col("_before") - F.coalesce(F.col("_known.turns"), F.lit(0))) % 2 == 1)
    numbered = begun.select("_uri", "_split", "_inside", F.coalesce(F.sum(F.when(F.col("_inside"), F.col("n_in")).otherwise(F.col("n_out"))).over(earlier), F.lit(0)).alias("_number"))
    if raw.where(F.col("_metadata.file_size") > _uncut(spark)).isEmpty():  # smaller ones aren't read for this
        joined = rows.withColumns({"_inside": F.lit(None).cast("boolean"), "_number": F.lit(None).cast("long")})
    elif raw.rdd.getNumPartitions() <= BROADCAST_SPLITS:
        joined = rows.join(F.broadcast(numbered), ["_uri", "_split"], "left")
    else:
        joined = rows.withColumn("_row", F.monotonically_increasing_id()).join(numbered, ["_uri", "_split"], "left").sortWithinPartitions("_uri", "_split", "_row")
    told_or_first = (F.coalesce("_inside", F.lit(False)).alias("_inside"), F.coalesce("_number", F.lit(0)).alias("_number"))
    parsed = stored(joined.select("_uri", "_split", *told_or_first, "line").mapInArrow(_parse, f"{SCHEMA}, _split long"))
    whole = parsed.where("_split IS NULL").select("file_path", "idx", "fields", "line")
    pieces = parsed.where("_split IS NOT NULL").groupBy("file_path", "idx").agg(F.sort_array(F.collect_list(F.struct("_split", "line"))).alias("p"))
    text = F.regexp_replace(F.concat_ws("\n", F.col("p.line")), "\r$", "")
    crossing = pieces.select("file_path", "idx", F.pandas_udf(lambda x: x.map(fields_of), "array<string>")(text).alias("fields"), text.alias("line"))
    return whole.unionByName(stored(crossing))


READERS = {"csv": csv_records, "json": json_records, "text": text_records}
