"""Quality rules: fixed limits on document statistics, then gradient-boosted trees.

One pass over the whole texts gives the statistics; the trees are fitted to the
graded rows' statistics (``SAMPLE`` rows at most, chosen by the hash of their id)
and flattened into five numpy arrays, so that a block of documents walks all
trees one level at a time. Features in ``MONOTONE`` may only lower (-1) or raise
(+1) the verdict: splits against the sign are refused and the bounds are handed
down, so that the whole ensemble keeps it.

Defined results: a null or empty text has no words and fails the base rules;
words are separated by the six ASCII blanks only; each row is judged on its own,
repeated or not; without graded rows of both grades, or with fewer than
``LEAST_GRADED``, there is no model and all documents that pass the base rules are
kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 20_000
#: Graded rows without which no trees are grown.
LEAST_GRADED = 20
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
FEATURES = ("log_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "punct_ratio", "distinct_ratio", "end_ratio", "longest_word")
MONOTONE = {"symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "upper_ratio": -1}
KEEP_AT = 0.5
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_upper = bytes(range(65, 91))
_digits = b"0123456789"
_punct = bytes(b for b in range(33, 127) if not chr(b).isalnum())


# --- statistics ---------------------------------------------------------------


def repeated_words(h: np.ndarray, width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more; h: the words' hashes."""
    n = len(h) - width + 1
    if n < 2:
        return 0
    w = C.mix64(C.windows(h, width))
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def statistics(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of the contract and the features of the trees, a row for each text."""
    texts = [t or b"" for t in texts]
    words = C.Words(texts)
    counts, features, ends, size = [], [], words.ends().tolist(), words.end - words.start
    for text, a, b in zip(texts, ends, ends[1:], strict=False):
        h, n = words.hash[a:b], b - a
        bare = text.translate(None, BLANKS)
        chars = len(bare) if bare.isascii() else len(bare.decode())
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
        dup = len(lines) - len(set(lines))
        repeat = repeated_words(h)
        n_bytes, per_word = max(1, len(bare)), max(1, n)
        share = lambda drop: (len(bare) - len(bare.translate(None, drop))) / n_bytes  # noqa: B023, E731
        stops = sum(x.rstrip(BLANKS)[-1:] in (b".", b"!", b"?") for x in lines)
        counts.append((n, chars, symbols, dup, repeat))
        features.append((np.log1p(n), chars / per_word, symbols / n_bytes, dup / max(1, len(lines)), repeat / per_word, share(_upper), share(_digits), share(_punct), len(np.unique(h)) / per_word, stops / max(1, len(lines)), size[a:b].max(initial=0)))
    return np.array(counts, np.int64).reshape(-1, 5), np.array(features, float).reshape(-1, len(FEATURES))


# --- trees --------------------------------------------------------------------


@dataclass
class Trees:
    """All nodes of all trees, one after another; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Newton boosting of the logistic loss on binned features."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    raw = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(k), right.append(k), value.append(v)
        return k

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = y - prob, prob * (1 - prob)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            v = float(np.clip(gs / (hs + l2), low, high))
            k = leaf(v * rate)
            if level == depth or hs < 2 * least:
                return k
            best = (1e-6, -1, 0, 0.0, 0.0)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                vl, vr = np.clip(gl / (hl + l2), low, high), np.clip((gs - gl) / (hs - hl + l2), low, high)
                gain = (vl * gl - 0.5 * (hl + l2) * vl**2) + (vr * (gs - gl) - 0.5 * (hs - hl + l2) * vr**2) - (v * gs - 0.5 * (hs + l2) * v**2)
                ok = (hl >= least) & (hs - hl >= least) & (monotone[f] * (vr - vl) >= 0)
                gain = np.where(ok, gain, 0)
                if gain.max() > best[0]:
                    b = int(gain.argmax())
                    best = (gain[b], f, b, float(vl[b]), float(vr[b]))
            _, f, b, vl, vr = best
            if f < 0:
                return k
            mid = (vl + vr) / 2
            l_low, l_high, r_low, r_high = (low, mid, mid, high) if monotone[f] > 0 else (mid, high, low, mid) if monotone[f] < 0 else (low, high, low, high)
            go = binned[rows, f] <= b
            feature[k], threshold[k] = f, float(cuts[f][b])
            left[k], right[k] = grow(rows[go], level + 1, l_low, l_high), grow(rows[~go], level + 1, r_low, r_high)
            return k

        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        part = Trees(*map(np.array, (feature, threshold, left, right, value)), np.array(roots[-1:]), depth, 0.0)
        s = np.clip(part.score(x), 1e-12, 1 - 1e-12)
        raw += np.log(s / (1 - s))
    return Trees(*map(np.array, (feature, threshold, left, right, value)), np.array(roots), depth, base)


# --- operator -----------------------------------------------------------------


def graded_sample(labels: DataFrame, id_col: str, grade, sample: int) -> DataFrame:
    """(id, grade) of ``sample`` graded rows at most, chosen by the hash of their id."""
    rows = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), grade.cast("double").alias("_grade")).where(F.col("_grade").isNotNull())
    return rows.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(sample)


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Trees | None:
    picked = F.broadcast(graded_sample(labels, id_col, F.col("quality"), sample))  # ``sample`` pairs of numbers at most
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).join(picked, "_id").select("_id", "_grade", F.xxhash64("text").alias("_hash"), "text")

    def measure(batches):
        for part, texts in C.blocks(batches, "text"):
            yield C.out_batch({"id": pa.int64(), "grade": pa.float64(), "hash": pa.int64(), "x": pa.list_(pa.float64())}, id=C.column(part, "_id").cast(pa.int64()), grade=C.column(part, "_grade"), hash=C.column(part, "_hash"), x=list(statistics(texts)[1]))

    measured = C.map_arrow(rows, measure, "id long, grade double, hash long, x array<double>")
    got = measured.orderBy(F.xxhash64("id", "hash"), "id", "grade", "hash").limit(sample).toPandas()  # an id may repeat
    y = (got["grade"].to_numpy() >= 0.5).astype(float)
    if len(y) < LEAST_GRADED or y.min() == y.max():
        return None
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort([y, *x.T])  # the rows' order doesn't matter
    return fit_trees(x[order], y[order], np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def judge(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    types = {"doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "score": pa.float64()}

    def run(batches):
        for part, texts in C.blocks(batches, "text"):
            counts, x = statistics(texts)
            model = shared.value
            score = model.score(x) if model else np.ones(len(x))
            n, repeat = counts[:, 0], counts[:, 4]
            failed = (n < 10) | (100 * repeat > 20 * n)
            yield C.out_batch(types, doc_id=C.column(part, "doc_id"), n_words=n, word_chars=counts[:, 1], n_symbols=counts[:, 2], n_dup_lines=counts[:, 3], n_repeat_words=repeat, base_failed=failed, kept=~failed & (score >= keep_at), score=score)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return C.map_arrow(rows, run, f"doc_id long, {STATS}, base_failed boolean, kept boolean, score double")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return judge(docs, fit_rules(docs, C.table(spark, sf_dir, "labels")))
