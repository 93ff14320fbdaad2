"""Shared plumbing of the training-data operators.

Everything here is small: reading a table of the data folder, running an Arrow
function over partitions, walking key groups of a sorted partition, and cutting
lineage with a table in the folder that the session names.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; bounds the memory of a Python worker.
BLOCK_BYTES = 1_000_000
#: Rows of an Arrow batch.
BATCH_ROWS = 2_000
#: Words that a worker's cache holds, numbers held for them.
CACHE_ENTRIES, CACHE_NUMBERS = 400_000, 6_000_000
SLOT_BITS = 20
#: Bytes of words that are hashed at once.
SLICE = 1 << 20
#: Keys longer than this are never held (in bytes).
LONGEST_KEY = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all machines must share; where that
    is unset, a temporary one in a local session, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(scratch_dir, "fallback", None) or tempfile.mkdtemp(prefix="scratch-")
        scratch_dir.fallback = base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_scopes: list[list[DataFrame]] = []


def stored(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: the lineage is cut,
    and a lost executor costs no more than the tasks it ran."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables that stored() wrote and nothing reads any more."""
    for df in frames:
        for scope in _scopes:
            scope[:] = [x for x in scope if x is not df]
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tidied():
    """Deletes on leaving what was stored inside, but for the tables given to the function it yields."""
    scope: list[DataFrame] = []
    _scopes.append(scope)
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _scopes.remove(scope)
        dropped(*[x for x in scope if not any(x is k for k in kept)])
        if _scopes:
            _scopes[-1].extend(x for x in scope if any(x is k for k in kept))


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow, with batches of BATCH_ROWS rows at most: texts may be long, and a batch is held in the executor and the worker.

    Workers serve many tasks and stages; each gives its free memory back when a task ends."""
    spark = df.sparkSession
    importable(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def task(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Returns freed memory to the machine, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES):
    """Slices batches so that a slice holds about ``most`` bytes of text, or one row.

    Yields (slice, texts as bytes; None stays None)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
            part = batch.slice(at, to - at)
            yield part, col.slice(at, to - at).cast(pa.binary()).to_pylist()
            at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def out_batch(schema: dict[str, pa.DataType], **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema[n]) for n, c in cols.items()], names=list(cols))


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str], most: int = 200_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Walks a partition sorted by ``keys``: yields tables that hold whole key groups,
    with the row numbers at which groups begin. What is held at once is ``most`` rows
    and the group that is still open."""
    held: list[pa.RecordBatch] = []
    n = 0

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            if pa.types.is_binary(c.type) or pa.types.is_string(c.type):
                a = np.array(c.to_pylist(), dtype=object)
            else:
                a = c.to_numpy(zero_copy_only=False)
            new[1:] |= a[1:] != a[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= most:
            t = pa.Table.from_batches(held)
            s = starts(t)
            if len(s) > 1:
                yield t.slice(0, int(s[-1])), s[:-1]
                rest = t.slice(int(s[-1])).combine_chunks()
                held = rest.to_batches()
                n = rest.num_rows
                most_now = n
                if most_now >= most:  # one group is larger than a block: wait for its end
                    n = 0
            else:
                held = t.combine_chunks().to_batches()
                n = 0
    if held:
        t = pa.Table.from_batches(held)
        if t.num_rows:
            yield t, starts(t)


class WordCache(dict):
    """word -> number, through ``make`` on a miss. When it is full it becomes the old
    generation, from which words come back as they are met again; the rest is forgotten
    at the next change. So frequent words stay, and at most 2 x ``most`` are held, none of
    them longer than LONGEST_KEY: they take a bounded number of bytes."""

    def __init__(self, make: Callable[[bytes], int], most: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.most = make, most
        self.old: dict = {}

    def __missing__(self, word: bytes):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= LONGEST_KEY:
            self[word] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


# --- words of a block, by their hashes -----------------------------------------

_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_of_byte = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_of_place = mix64(np.arange(1, 65_537, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def spans_of(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers begin .. begin + length - 1 of every span, one span after another."""
    at = np.repeat(begin - (np.cumsum(length) - length), length)
    at += np.arange(len(at))
    return at


class Words:
    """The words (runs of other bytes than the six ASCII blanks) of a block of texts.

    ``n``: words of each text; ``hash``: 64 bits of each word, a sum over its bytes of random
    numbers times odd numbers for their places, mixed with its length."""

    def __init__(self, texts: Sequence[bytes], cut: Callable | None = None):
        """``cut``: (bytes before, bytes) -> where a word is cut in front of a byte."""
        self.page = b"\n".join(texts)
        raw = np.frombuffer(self.page, np.uint8)
        inside = np.concatenate([[False], ~_blank[raw], [False]])
        begins = inside[1:-1] & ~inside[:-2]
        if cut is not None and len(raw):
            begins[1:] |= inside[1:-2] & inside[2:-1] & cut(raw[:-1], raw[1:])
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(inside[:-1] & np.concatenate([begins | ~inside[1:-1], [True]]))
        begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.n = np.diff(np.searchsorted(self.start, begin))
        self.hash = np.empty(len(self.start), np.uint64)
        length = self.end - self.start
        total = np.cumsum(length)
        at = 0
        while at < len(length):  # a slice of about SLICE bytes at a time
            done = total[at] - length[at]
            to = max(at + 1, int(np.searchsorted(total, done + SLICE, side="right")))
            self.hash[at:to] = self._hashes(raw, self.start[at:to], length[at:to])
            at = to

    @staticmethod
    def _hashes(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        first = np.cumsum(length) - length
        place = spans_of(np.zeros(len(length), np.int64), length)
        by_place = _of_place[place & 0xFFFF]
        if length.max() > 0x10000:
            by_place = by_place + (mix64(place.astype(np.uint64) >> np.uint64(16)) << np.uint64(1))
        sums = np.add.reduceat(_of_byte[raw[np.repeat(start, length) + place]] * by_place, first)
        return np.maximum(mix64(sums + length.astype(np.uint64) * _MULTIPLIERS[2]), np.uint64(1))  # 0 means an empty slot

    def __getitem__(self, k: int) -> bytes:
        return self.page[self.start[k] : self.end[k]]

    def ends(self) -> np.ndarray:
        """Number of words up to the end of each text, with a 0 before."""
        return np.concatenate([[0], np.cumsum(self.n)])


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive words, before mixing."""
    s = np.full(max(0, len(h) - width + 1), width, np.uint64)
    for j in range(width):
        s += h[j : j + len(s)] * _MULTIPLIERS[j]
    return s


class Known:
    """What is known of words: a vector of numbers for each, found by the word's hash.

    The words themselves aren't held. ``make`` takes a list of new words and gives a vector for
    each. When more than ``most`` words or ``room`` numbers are held, those met last stay, half of either."""

    def __init__(self, make: Callable[[list[bytes]], list[Sequence]], dtype, most: int = CACHE_ENTRIES, room: int = CACHE_NUMBERS):
        self.make, self.dtype, self.most, self.room, self.turn = make, dtype, most, room, 0
        self.begin, self.length, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)
        self.met = np.zeros(0, np.int64)  # by row, as the three above
        self.key, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by key
        self._empty_slots()

    def _empty_slots(self) -> None:
        """The first look: one word for each slot, by the hash's upper bits."""
        self.slot_key, self.slot_row = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)

    def rows(self, words: Words) -> np.ndarray:
        """The row of each word, good for spread() until the next call."""
        self._trim()
        self.turn += 1
        slot = (words.hash >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.slot_row[slot].astype(np.int64)
        rest = np.flatnonzero(self.slot_key[slot] != words.hash)
        if len(rest):
            u, first, inverse = np.unique(words.hash[rest], return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.key, u), max(0, len(self.key) - 1))
            new = np.flatnonzero(self.key[at] != u) if len(self.key) else np.arange(len(u))
            if len(new):
                self._learn(u[new], [words[k] for k in rest[first[new]].tolist()])
                at = np.searchsorted(self.key, u)
            own = self.row[at]
            out[rest] = own[inverse]
            slot = (u >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            self.slot_key[slot] = u
            self.slot_row[slot] = own  # of several words in one slot the last one stays, here as above
        self.met[out] = self.turn
        return out

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        got = self.make(words)
        size = np.fromiter(map(len, got), np.int64, len(got))
        rows, place = len(self.begin) + np.arange(len(got)), np.searchsorted(self.key, keys)
        self.begin = np.concatenate([self.begin, len(self.values) + np.cumsum(size) - size])
        self.length, self.met = np.concatenate([self.length, size]), np.concatenate([self.met, np.zeros(len(got), np.int64)])
        self.values = np.concatenate([self.values, np.fromiter(chain.from_iterable(got), self.dtype, int(size.sum()))])
        self.key, self.row = np.insert(self.key, place, keys), np.insert(self.row, place, rows)

    def spread(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of these rows one after another, and the length of each."""
        length = self.length[rows]
        return self.values[spans_of(self.begin[rows], length)], length

    def _trim(self) -> None:
        if len(self.key) <= self.most and len(self.values) <= self.room:
            return
        order = np.argsort(-self.met[self.row], kind="stable")  # last met first
        fits = (np.arange(len(order)) < self.most // 2) & (np.cumsum(self.length[self.row[order]]) <= self.room // 2)
        stay = np.sort(order[fits])
        rows = self.row[stay]
        self.values, self.length = self.spread(rows)
        self.begin, self.met = np.cumsum(self.length) - self.length, self.met[rows]
        self.key, self.row = self.key[stay], np.arange(len(stay))
        self._empty_slots()


_held: list = []


def held(key, make: Callable):
    """The one cache that this Python worker keeps. Another operator's cache takes its
    place, so a worker's memory doesn't grow with the stages it has served."""
    if not _held or _held[0] != key:
        _held.clear()
        _held.extend((key, make()))
    return _held[1]


def looked_up(cache: WordCache, texts: list[list[bytes]], dtype=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """The cached numbers of all words of all texts, and the number of words of each text."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.fromiter(map(cache.__getitem__, chain.from_iterable(texts)), dtype, int(n.sum()))
    return flat, n


def crc_fold(column: str, mod: int):
    """crc32 of the number as text, by the fold's modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)
