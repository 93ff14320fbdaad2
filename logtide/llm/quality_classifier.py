"""A quality classifier: ordinal cumulative-link regression on graded ratings.

The grades are 0 < 1 < ... < K - 1. One table of weights, shared by all grades, is
indexed by the hash of a token's features (its word, its shape, its beginning); a
document's position z is the mean, over its tokens, of their weights. Ordered
thresholds t_1 < ... < t_{K-1} turn it into probabilities,

    P(grade >= k) = sigmoid(z - t_k),

whose sum is the expected grade; P(grade >= select) is the tail probability that
documents are chosen by. Weights and thresholds (the first one and the logs of the
steps between them) are fitted together by Adam to the likelihood of the ratings,
on ``SAMPLE`` rated rows at most, chosen by the hash of their id.

The labels' two columns give the rating of op1: 0 for low quality, 1 for good but
toxic text, 2 for good text.

Defined results: null and empty texts have z = 0; each row is scored on its own,
repeated or not; rows without a rating teach nothing; with fewer than two grades
every text has the highest grade and is kept; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SAMPLE, SLOTS = 6_000, 1 << 18
SELECT, KEEP_AT = 1, 0.5
_runs = re.compile(r"[A-ZÀ-ÖØ-Þ]+|[^\W\d_]+|\d+|_+|[^\w]+")


def _slot(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode()) & (SLOTS - 1)


def shape(token: str) -> str:
    """Runs of capitals, letters, digits and marks; marks stay as they are."""
    out = []
    for r in _runs.findall(token)[:8]:
        if r.isalpha():
            out.append("X" if len(r) == 1 and r.isupper() else "XX" if r.isupper() else "x")
        elif r.isdigit():
            out.append("9")
        else:
            out.append(r[:4])
    return "".join(out)


def features(chunk: bytes) -> list[int]:
    token = chunk.decode()
    word = token.lower().strip(".,;:!?()[]\"'*#$%&|<>-_")
    return [_slot("w", word), _slot("h", shape(token)), _slot("p", word[:4]), _slot("n", str(min(len(token), 20)))]


@dataclass
class Ordinal:
    weight: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K - 1"""
        return _sigmoid(z[:, None] - self.thresholds[None, :])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_ordinal(doc: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, epochs: int = 150, rate: float = 0.5, l2: float = 1e-3) -> Ordinal:
    """doc, slot, value: the entries of a sparse matrix; grade: of each document."""
    n = len(grade)
    weight = np.zeros(SLOTS)
    share = np.array([(grade >= k).mean() for k in range(1, grades)]).clip(1e-3, 1 - 1e-3)
    t = -np.log(share / (1 - share))
    free = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-2))])  # first threshold, logs of the steps
    m, v = [np.zeros(SLOTS), np.zeros(grades - 1)], [np.zeros(SLOTS), np.zeros(grades - 1)]
    for epoch in range(1, epochs + 1):
        steps = np.exp(free[1:])
        t = free[0] + np.concatenate([[0], np.cumsum(steps)])
        z = np.bincount(doc, weight[slot] * value, n)
        tail = np.concatenate([np.ones((n, 1)), _sigmoid(z[:, None] - t), np.zeros((n, 1))], axis=1)
        high, low = tail[np.arange(n), grade], tail[np.arange(n), grade + 1]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high), low * (1 - low)  # slopes; 0 at both ends of the scale
        g_z = (d_high - d_low) / p
        g_t = np.array([((d_low / p)[grade == k - 1]).sum() - ((d_high / p)[grade == k]).sum() for k in range(1, grades)])
        g_free = np.concatenate([[g_t.sum()], [g_t[k:].sum() * steps[k - 1] for k in range(1, grades - 1)]])
        g = [np.bincount(slot, value * g_z[doc], SLOTS) / n - l2 * weight / SLOTS, g_free / n]
        for k, target in enumerate((weight, free)):
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            target += (rate if k == 0 else 0.05) * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.99**epoch)) + 1e-8)
    return Ordinal(weight, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]))


def known_features() -> C.Known:
    return C.held("features", lambda: C.Known(lambda tokens: list(map(features, tokens)), np.int32))


def fit_quality(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text: str = "text", rating: str = "rating", sample: int = SAMPLE) -> Ordinal | None:
    """``ratings``: id and rating (a whole number from 0)."""
    rows = ratings.select(F.col(id_col).alias("_id"), F.col(rating).cast("int").alias("_grade")).where(F.col("_id").isNotNull() & (F.col("_grade") >= 0))
    picked = F.broadcast(rows.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(sample))  # ``sample`` pairs of numbers at most
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).join(picked, "_id").select("_id", "_grade", "text")

    def count(batches):
        for part, raw in C.blocks(batches, "text"):
            words, known = C.Words([t or b"" for t in raw]), known_features()
            flat, per = known.spread(known.rows(words))
            at, n = np.concatenate([[0], np.cumsum(per)])[words.ends()], words.n
            got = [np.unique(flat[a:b], return_counts=True) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
            yield C.out_batch({"id": pa.int64(), "grade": pa.int32(), "n": pa.int64(), "slots": pa.binary(), "counts": pa.binary()}, id=C.column(part, "_id").cast(pa.int64()), grade=C.column(part, "_grade"), n=n, slots=[s.astype("<i4").tobytes() for s, _ in got], counts=[c.astype("<i4").tobytes() for _, c in got])

    counted = C.map_arrow(texts, count, "id long, grade int, n long, slots binary, counts binary")
    got = counted.orderBy(F.xxhash64("id", "slots", "counts"), "id", "grade", "n").limit(sample).toPandas().sort_values(["id", "grade", "n"])  # an id may repeat
    if not len(got) or got["grade"].nunique() < 2:
        return None
    slots = [np.frombuffer(s, "<i4") for s in got["slots"]]
    size = np.array([len(s) for s in slots])
    value = np.concatenate([np.frombuffer(c, "<i4") for c in got["counts"]]) / np.repeat(np.maximum(got["n"].to_numpy(), 1), size)
    grade = got["grade"].to_numpy().astype(np.int64)
    return fit_ordinal(np.repeat(np.arange(len(size)), size), np.concatenate(slots), value, grade, int(grade.max()) + 1)


def known_positions(key: str, model: Ordinal) -> C.Known:
    """What a token adds to its document's position."""
    return C.held(("positions", key), lambda: C.Known(lambda tokens: [(float(model.weight[features(t)].sum()),) for t in tokens], np.float64))


SCHEMA = "doc_id long, z double, expected_grade double, tail double, predicted_grade int, kept boolean"


def grade_texts(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text: str = "text", select: int = SELECT, keep_at: float = KEEP_AT) -> DataFrame:
    """Position, expected grade, P(grade >= select) and the verdict for every row."""
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)
    types = {"doc_id": pa.int64(), "z": pa.float64(), "expected_grade": pa.float64(), "tail": pa.float64(), "predicted_grade": pa.int32(), "kept": pa.bool_()}

    def run(batches):
        m = shared.value or Ordinal(np.zeros(SLOTS), np.array([-35.0]))
        for part, raw in C.blocks(batches, "text"):
            words, known = C.Words([t or b"" for t in raw]), known_positions(key, m)
            total, at = np.concatenate([[0.0], np.cumsum(known.spread(known.rows(words))[0])]), words.ends()
            z = (total[at[1:]] - total[at[:-1]]) / np.maximum(words.n, 1)
            tails = m.tails(z)
            chosen = tails[:, min(select, tails.shape[1]) - 1]
            yield C.out_batch(types, doc_id=C.column(part, "doc_id"), z=z, expected_grade=tails.sum(axis=1), tail=chosen, predicted_grade=(tails >= 0.5).sum(axis=1), kept=chosen >= keep_at)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return C.map_arrow(rows, run, SCHEMA)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    rating = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    return grade_texts(docs, fit_quality(docs, labels.select("doc_id", rating.alias("rating"))))
