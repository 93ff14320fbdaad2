"""Mixture-controlled packing of documents into training sequences.

Every source is a queue, in the order in which its documents were stored. Deficit
round-robin serves the queues: in each round, which is one sequence of ``max_len``
ids (or ``window_tokens`` ids, if they are given), queue q may take its quantum, its
target share of the round; the fraction of an id that it couldn't take is its deficit
and carries into the next round. When the stream has reached place p, q has given

    C_q(p) = min(N_q, floor(t * share_q + phase_q)), with t such that all C_q add up to p

ids, wherever they are stored (ids that are due at one t go by the queues' order). So
rounds have exactly their length, also after queues have run dry, and every sequence
holds the proportions to about an id. With ``least`` above 1 the queues are served in blocks of so
many ids, cut from each queue's own stream, and all of the above counts blocks: documents are cut
at the ends of blocks only, so each piece has ``least`` ids or ends with its document, block or sequence, and
a queue's share holds over any run of sequences to about a block, as its deficit is carried. What a
queue has behind its last whole block, fewer than ``least`` ids, comes at the end of the stream. And no task has to wait for another: with the ids
of each queue before a document (a prefix sum over the tasks, one row for each
task and queue), every task knows the rounds its own documents fall into and
their place in the one long stream of all rounds. Deficits thus carry over sequences and
over partitions alike. The ids behind the last full sequence are cut at powers of two, so
nothing is padded.

Targets default to the queues' shares of all ids, so that all run dry in the same
round; with other targets a queue that is dry leaves its turn to the rest, in their
proportions.
Every source is a queue of its own, however many there are: names are numbered by a
join, and tasks are sent two numbers a queue. The work for the places grows with rounds
times queues.

Defined results: a null text is its end id alone; a null source shares the queue
of the empty one; each row is packed, repeated or not; a null id stays null; an
empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .encoding import worker_encoder

MAX_LEN = 4_096
WINDOW_TOKENS = MAX_LEN  # a round is a sequence
#: Ids that a queue gives at least, if its documents last.
LEAST = 256
#: Share of a queue that has no target while others have one.
LEAST_SHARE = 2.0**-26
GOLDEN = (5**0.5 - 1) / 2
#: Entries of a table of rounds x queues that a task holds at once.
MATRIX = 1_000_000
#: Rows of (task, queue) offsets up to which they are broadcast; a join shuffles them beyond.
BROADCAST_ROWS = 200_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, queue string"
_types = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "window": pa.int64(), "queue": pa.string()}


class Schedule:
    """The deficit round-robin, as a function of the round."""

    def __init__(self, names: list[str], totals: list[int], targets: dict[str, float] | None = None, window_tokens: int = WINDOW_TOKENS, max_len: int = MAX_LEN, least: int = 1):
        if window_tokens % least or max_len % least:
            raise ValueError("a round and a sequence are whole numbers of blocks")
        all_ids = np.array(totals, np.int64)
        self.least, self.total = least, all_ids // least  # of blocks
        rest = all_ids % least
        self.blocks = int(self.total.sum())
        self.rest_at = self.blocks * least + np.cumsum(rest) - rest  # where in the stream a queue's rest stands
        weight = np.array([targets.get(n, 0.0) if targets else t for n, t in zip(names, totals, strict=True)], float)
        if not weight.sum():
            weight = np.ones(len(names))
        self.share = np.where(weight > 0, weight / max(weight.sum(), 1e-300), LEAST_SHARE)
        # Phases spread over [0, 1) among queues of about one share, so that small ones aren't due all at once.
        self.phase = np.empty(len(names))
        self.phase[np.argsort(self.share, kind="stable")] = (np.arange(len(names)) + 0.5) * GOLDEN % 1
        self.end = float(((self.total + 1) / self.share).max(initial=0.0)) * (1 + 1e-9) + 1  # all are dry by then
        self.ids = int(all_ids.sum())
        full, rest = divmod(self.ids, max_len)
        self.full, self.max_len, self.window = full, max_len, window_tokens // least
        powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.tail = full * max_len + np.concatenate([[0], np.cumsum(powers)]).astype(np.int64)
        whole = self.blocks // self.window
        last = self.tail if window_tokens == max_len and least == 1 else np.unique([whole * self.window, self.blocks])
        self.rounds, self.last = whole, last

    def bound(self, k: np.ndarray) -> np.ndarray:
        """Where in the stream round k begins."""
        return np.where(k <= self.rounds, k * self.window, self.last[np.clip(k - self.rounds, 0, len(self.last) - 1)])

    def round_at(self, place: np.ndarray) -> np.ndarray:
        """The round that holds this place of the stream."""
        place = np.clip(place, 0, self.blocks - 1)
        return np.where(place < self.last[0], place // self.window, self.rounds + np.searchsorted(self.last, place, side="right") - 1)

    def by_time(self, t: np.ndarray) -> np.ndarray:
        """Blocks that each queue has given at the times t (a row each)."""
        return np.minimum(self.total, np.floor(t[:, None] * self.share + self.phase)).astype(np.int64)

    def sum_by_time(self, t: np.ndarray) -> np.ndarray:
        step = max(1, MATRIX // max(1, len(self.total)))
        return np.concatenate([self.by_time(t[a : a + step]).sum(axis=1) for a in range(0, len(t), step)] or [np.zeros(0, np.int64)])

    def given(self, place: np.ndarray) -> np.ndarray:
        """C_q: blocks that each queue has given when the stream has reached these places (a row each)."""
        wide, total = len(self.total), self.share.sum()
        low = np.maximum((place - wide - 1) / total * (1 - 1e-9), 0.0)
        high = np.minimum((place + wide + 1) / total * (1 + 1e-9), self.end)
        low_sum, high_sum = self.by_time(low).sum(axis=1), self.by_time(high).sum(axis=1)
        short = high_sum < place  # some queues are dry
        high[short], high_sum[short] = self.end, self.blocks
        left = np.arange(len(place))
        while len(left := left[(low_sum[left] < place[left]) & (high_sum[left] > place[left])]):
            mid = (low[left] + high[left]) / 2
            apart = (mid > low[left]) & (mid < high[left])
            left, mid = left[apart], mid[apart]
            at = self.by_time(mid).sum(axis=1)
            below = at <= place[left]
            low[left[below]], low_sum[left[below]] = mid[below], at[below]
            high[left[~below]], high_sum[left[~below]] = mid[~below], at[~below]
        out = self.by_time(low)
        more = self.by_time(high) - out  # ids of one time go by the queues' order
        return out + np.clip((place - low_sum)[:, None] - (np.cumsum(more, axis=1) - more), 0, more)

    def rounds_of(self, q: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last round that blocks x to x + n - 1 of queue q can fall into."""
        first, last = (x + 1 - self.phase[q]) / self.share[q] * (1 - 1e-12), (x + n - self.phase[q]) / self.share[q] * (1 + 1e-12)
        return self.round_at(self.sum_by_time(first)), self.round_at(self.sum_by_time(last))

    def turns(self, k: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queue q's turn in round k: its blocks' begin and end, and the place in the stream."""
        begin, end, place = (np.empty(len(k), np.int64) for _ in range(3))
        order = np.argsort(k, kind="stable")
        rounds, starts = np.unique(k[order], return_index=True)
        starts = np.append(starts, len(k))
        step = max(1, MATRIX // max(1, len(self.total)))
        for a in range(0, len(rounds), step):
            some = rounds[a : a + step]
            rows = order[starts[a] : starts[a + len(some)]]
            edges = np.unique(np.concatenate([some, some + 1]))
            given = self.given(self.bound(edges))
            i = np.searchsorted(edges, some)
            now, then = given[i], given[np.searchsorted(edges, some + 1)]
            before = np.cumsum(then - now, axis=1) - (then - now)
            r, at = np.searchsorted(some, k[rows]), q[rows]
            begin[rows], end[rows], place[rows] = now[r, at], then[r, at], self.bound(some)[r] + before[r, at]
        return begin, end, place

    def sequence(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, begin and end of the sequence that holds place g of the stream."""
        n = g // self.max_len
        begin, end = n * self.max_len, (n + 1) * self.max_len
        if (t := g >= self.full * self.max_len).any():
            k = np.searchsorted(self.tail, g[t], side="right") - 1
            n[t], begin[t], end[t] = self.full + k, self.tail[k], self.tail[k + 1]
        return n, begin, end


def _split(start: np.ndarray, length: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers repeated by ``count``, and the number of each copy within its row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def turns_of(s: Schedule, q: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, round, begin, end and place in the stream of what n blocks from block x of queue q give to each round."""
    first, last = s.rounds_of(q, x, n)
    row, at = _split(x, n, np.minimum(last - first + 1, n))
    k = first[row] + at
    if (one := (last - first >= n)[row]).any():  # more rounds than blocks: the rounds of each block
        low, high = s.rounds_of(q[row[one]], x[row[one]] + at[one], np.ones(int(one.sum()), np.int64))
        of, more = _split(low, low, high - low + 1)
        row, k = np.unique(np.stack([np.concatenate([row[~one], row[one][of]]), np.concatenate([k[~one], low[of] + more])], axis=1), axis=0).T
    turn, turn_end, place = s.turns(k, q[row])
    begin, end = np.maximum(x[row], turn), np.minimum((x + n)[row], turn_end)
    g = place + begin - turn
    return tuple(a[end > begin] for a in (row, k, begin, end, g))


def pieces(s: Schedule, q: np.ndarray, x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Cuts documents (n ids from place x of queue q) at the ends of rounds and of sequences."""
    whole = s.total[q] * s.least  # ids of the queue's whole blocks
    in_blocks, in_rest = np.flatnonzero(x < whole), np.flatnonzero(x + n > whole)
    parts = []
    if len(in_blocks):
        x1 = x[in_blocks]
        block, end = x1 // s.least, -(-np.minimum(x1 + n[in_blocks], whole[in_blocks]) // s.least)
        row, k, begin, end, g = turns_of(s, q[in_blocks], block, end - block)
        row = in_blocks[row]
        low, high = np.maximum(begin * s.least, x[row]), np.minimum(end * s.least, (x + n)[row])
        parts.append((row, k, low, high, g * s.least + low - begin * s.least))
    if len(in_rest):
        low = np.maximum(x, whole)[in_rest]
        parts.append((in_rest, np.full(len(in_rest), s.rounds + len(s.last)), low, (x + n)[in_rest], s.rest_at[q[in_rest]] + low - whole[in_rest]))
    row, k, begin, end, g = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64) for _ in range(5))
    out = []
    while len(row):  # each pass cuts off what still fits into the sequence at hand
        number, low, high = s.sequence(g)
        take = np.minimum(end - begin, high - g)
        out.append((row, k, begin, take, number, g - low))
        more = begin + take < end
        row, k, begin, end, g = (a[more] for a in (row, k, begin + take, end, g + take))
    cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [[]] * 6)]
    order = np.lexsort((cols[2], cols[0]))
    return dict(zip(("row", "window", "begin", "length", "sequence_id", "offset"), (c[order] for c in cols), strict=True))


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str, text: str, source: str) -> DataFrame:
    """The documents' ids, written once, with the ids of the same queue and task before each."""
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))

    def encode(batches):
        encoder, part, seen = worker_encoder(tokenizer_path), TaskContext.get().partitionId(), {}
        types = {"doc_id": pa.int64(), "queue": pa.string(), "part": pa.int32(), "before": pa.int64(), "n": pa.int64(), "ids": pa.binary()}
        for piece, texts in C.blocks(batches, "text"):
            ids, n = encoder.encode(texts)
            ends = np.cumsum(n).tolist()
            queues, before = C.column(piece, "queue").to_pylist(), []
            for queue, m in zip(queues, n.tolist(), strict=True):
                before.append(seen.get(queue, 0))
                seen[queue] = before[-1] + m
            yield C.out_batch(types, doc_id=C.column(piece, "doc_id"), queue=queues, part=[part] * len(n), before=before, n=n, ids=[ids[e - m : e].tobytes() for e, m in zip(ends, n.tolist(), strict=True)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), name.alias("queue"))
    return C.stored(C.map_arrow(rows, encode, "doc_id long, queue string, part int, before long, n long, ids binary"))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", source: str = "source", targets: dict[str, float] | None = None, max_len: int = MAX_LEN, window_tokens: int = WINDOW_TOKENS, least: int = 1) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    spark = docs.sparkSession
    ids = tokenized(docs, tokenizer_path, id_col, text, source)
    sums = C.stored(ids.groupBy("queue", "part").agg(F.sum("n").alias("n")))
    totals = sums.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").toArrow()  # a row for each source
    numbers = spark.createDataFrame(pa.table({"queue": totals.column("queue"), "q": pa.array(range(totals.num_rows), pa.int64())}))
    if totals.num_rows <= BROADCAST_ROWS:
        numbers = F.broadcast(numbers)
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("queue", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")).join(numbers, "queue")
    if sums.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    schedule = Schedule(totals.column("queue").to_pylist(), totals.column("n").to_pylist(), targets, window_tokens, max_len, least)
    shared = spark.sparkContext.broadcast(schedule)

    def cut(batches):
        s = shared.value
        for batch, raw in C.blocks(batches, "ids", C.BLOCK_BYTES):
            queues = C.column(batch, "queue").to_pylist()
            q = C.column(batch, "q").to_numpy()
            n = C.column(batch, "n").to_numpy()
            x = C.column(batch, "base").to_numpy() + C.column(batch, "before").to_numpy()
            p = pieces(s, q, x, n)
            start = p["begin"] - x[p["row"]]
            wide = [np.frombuffer(r, np.uint16).astype("<u4").tobytes() for r in raw]
            crc = [zlib.crc32(wide[r][4 * a : 4 * (a + m)]) for r, a, m in zip(p["row"].tolist(), start.tolist(), p["length"].tolist(), strict=True)]
            yield C.out_batch(_types, doc_id=C.column(batch, "doc_id").take(pa.array(p["row"])), start=start, length=p["length"], ids_crc32=crc, doc_tokens=n[p["row"]], sequence_id=p["sequence_id"], offset=p["offset"], window=p["window"], queue=[queues[r] for r in p["row"].tolist()])

    return C.map_arrow(ids.join(base, ["queue", "part"]).select("doc_id", "queue", "q", "base", "before", "n", "ids"), cut, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), least=LEAST)
