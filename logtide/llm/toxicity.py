"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, tokens don't; so the tokens of toxic documents that the
learning fold ties to that label (``token_labels``: by word or stem, on distinct
texts) are the labelled tokens. The field has two states. A token's features are
hashed into one table of weights: its word, its stems, its endings and the words on
either side; there are weights for the transitions as well. It is trained to the
likelihood of the labelled tokens by Adam with exact forward-backward gradients over
whole documents, ``TOXIC`` + ``CLEAN`` labelled ones at most, of any length, chosen by
the hash of their id until either kind has ``SAMPLE_BYTES`` bytes.

For a document, forward-backward over its whole token sequence gives every token's
probability of the toxic state. The highest of them and the number of those above
one half give the document's score through a logistic curve fitted to the same
sample; runs of such tokens are the spans.

Defined results: null and empty texts have no tokens and the score of a text without
toxic tokens; each row is scored on its own, repeated or not; a null id is neither
held out nor learned from; without labels of both kinds every score is 0; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TOXIC, CLEAN = 800, 1_600
SLOTS = 1 << 18
FOLDS, HELD_OUT, CUT = 3, 1, 0.7
#: Bytes of text of either kind that the learning sample takes (and the document that reaches them, whole).
SAMPLE_BYTES = 8 << 20
#: Maps that are put together in a block; tokens whose messages are computed at once.
WIDTH, PIECE = 64, 1 << 18
_core = re.compile(rb"[!-/:-@\[-`{-~]*(.*?)[!-/:-@\[-`{-~]*", re.S)


def core(chunk: bytes) -> bytes:
    """The token without the marks around it, lower-cased."""
    return _core.fullmatch(chunk)[1].decode().lower().encode()


def _slot(kind: str, value: bytes) -> int:
    return zlib.crc32(value, zlib.crc32(kind.encode())) & (SLOTS - 1)


def stems(word: bytes) -> list[bytes]:
    w = word.decode()
    return [w[:k].encode() for k in (4, 5, 6) if len(w) > k]


def own_slots(word: bytes) -> list[int]:
    w = word.decode()
    return [_slot("w", word), *[_slot(f"p{len(s)}", s) for s in stems(word)], _slot("s", w[-3:].encode())]


# --- the field ----------------------------------------------------------------


@dataclass
class Field:
    weight: np.ndarray  # toxic against benign, by slot
    step: np.ndarray  # transitions [from, to]
    start: np.ndarray
    curve: np.ndarray  # of the document's score: constant, highest probability, log of the count

    def word(self, w: bytes) -> tuple[float, float, float]:
        """What a word adds to its own token, to the next one and to the one before."""
        return float(self.weight[own_slots(w)].sum()), float(self.weight[_slot("b", w)]), float(self.weight[_slot("a", w)])

    def score(self, highest: np.ndarray, count: np.ndarray) -> np.ndarray:
        return _sigmoid(self.curve[0] + self.curve[1] * highest + self.curve[2] * np.log1p(count))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def applied(maps: np.ndarray, r: float) -> np.ndarray:
    """The value after each of the maps r -> (a + b r) / (c + d r), one after another; ``maps`` holds a, b, c and d as rows.

    The maps of a block are put together side by side with those of all other blocks, and the
    blocks follow one another in the same way: about WIDTH steps for each power of WIDTH."""
    n = maps.shape[1]
    if n <= WIDTH:
        out = np.empty(n)
        for k, (a, b, c, d) in enumerate(maps.T.tolist()):
            out[k] = r = (a + b * r) / (c + d * r)
        return out
    same = np.repeat([[0.0], [1.0], [1.0], [0.0]], -n % WIDTH, axis=1)  # leaves a value as it is
    steps = np.ascontiguousarray(np.concatenate([maps, same], axis=1).reshape(4, -1, WIDTH).transpose(2, 0, 1))
    whole = steps[0]
    for a, b, c, d in steps[1:]:
        p, q, u, v = whole
        whole = np.stack([a * u + b * p, a * v + b * q, c * u + d * p, c * v + d * q])
        whole /= whole.sum(axis=0)
    now = np.concatenate([[r], applied(whole, r)[:-1]])
    out = np.empty((WIDTH, len(now)))
    for k, (a, b, c, d) in enumerate(steps):
        out[k] = now = (a + b * now) / (c + d * now)
    return out.T.reshape(-1)[:n]


def messages(e: np.ndarray, n: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages as ratios toxic : benign, of whole sequences of any length.

    e: log odds of the tokens of all sequences, one after another; n: tokens of each. A message
    is a map of the one before it; at the ends of a sequence the map is a constant. PIECE tokens at a time."""
    x, t, s = np.exp(np.clip(e, -40, 40)), np.exp(step), np.exp(start)
    heads = np.zeros(len(e) + 1, bool)
    heads[(np.cumsum(n) - n)[n > 0]] = True
    heads[-1] = True  # what follows the last token
    fwd, bwd = np.empty(len(e)), np.empty(len(e))
    r = 1.0
    for i in range(0, len(e), PIECE):
        own, first = x[i : i + PIECE], heads[:-1][i : i + PIECE]
        maps = np.stack([own * np.where(first, s[1], t[0, 1]), own * np.where(first, 0.0, t[1, 1]), np.where(first, s[0], t[0, 0]), np.where(first, 0.0, t[1, 0])])
        fwd[i : i + PIECE] = applied(maps, r)
        r = fwd[min(i + PIECE, len(e)) - 1]
    r = 1.0
    for i in range(len(e), 0, -PIECE):
        j = max(0, i - PIECE)
        after, last = np.concatenate([x[j + 1 : i + 1], np.ones(int(i == len(e)))]), heads[j + 1 : i + 1]
        maps = np.stack([np.where(last, 1.0, t[1, 0]), np.where(last, 0.0, t[1, 1] * after), np.where(last, 1.0, t[0, 0]), np.where(last, 0.0, t[0, 1] * after)])
        bwd[j:i] = applied(maps[:, ::-1], r)[::-1]
        r = bwd[j]
    return fwd, bwd


def marginals(fwd: np.ndarray, bwd: np.ndarray) -> np.ndarray:
    odds = fwd * bwd
    return odds / (1 + odds)


def _inner(n: np.ndarray) -> np.ndarray:
    """Tokens that have one before them in their sequence."""
    inner = np.ones(int(n.sum()), bool)
    inner[(np.cumsum(n) - n)[n > 0]] = False
    return np.flatnonzero(inner)


def expected_steps(e, n, step, fwd, bwd) -> np.ndarray:
    """Expected transitions [from, to] over all sequences."""
    at, t = _inner(n), np.exp(step)
    x = np.exp(np.clip(e, -40, 40))[at] * bwd[at]
    joint = np.array([[np.full(len(at), t[0, 0]), t[0, 1] * x], [fwd[at - 1] * t[1, 0], fwd[at - 1] * t[1, 1] * x]])
    return (joint / joint.sum(axis=(0, 1))).sum(axis=2)


# --- learning -----------------------------------------------------------------


def distinct_texts(docs: list[tuple[list[bytes], int]]) -> list[tuple[list[bytes], int]]:
    """Leaves out copies and near copies (a shared minimum of four hashes of word triples)."""
    seen: set = set()
    out = []
    for words, label in docs:
        h = np.array([zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
        keys = [(k, int(C.mix64(h + np.uint64(k << 40)).min())) for k in range(4)]
        if not any(k in seen for k in keys):
            out.append((words, label))
        seen.update(keys)
    return out


def toxic_vocabulary(docs: list[tuple[list[bytes], int]], least: float = 20.0, lift: float = 8.0) -> set[bytes]:
    """Words and stems (of four characters or more, with a '*') that stand in toxic documents far beyond chance.

    The test is a likelihood ratio; a document that has one more than once counts twice."""
    docs_with, count = (Counter(), Counter()), (Counter(), Counter())
    n = [0, 0]
    for words, label in docs:
        own = Counter(w for w in words if w)
        for w, k in list(own.items()):
            for s in stems(w):
                own[s + b"*"] += k
        docs_with[label].update(own.keys())
        count[label].update({f: min(k, 2) for f, k in own.items()})
        n[label] += 1
    found = set()
    for f, k1 in count[1].items():
        k0 = count[0].get(f, 0)
        if docs_with[1][f] < 3 or k1 / n[1] < lift * (k0 + 0.5) / n[0]:
            continue
        p = (k1 + k0) / (n[0] + n[1])
        g = 2 * (k1 * np.log(k1 / (n[1] * p)) + (k0 * np.log(k0 / (n[0] * p)) if k0 else 0.0))
        if g >= least:
            found.add(f)
    return found


def token_labels(words: list[bytes], label: int, vocabulary: set[bytes]) -> list[int]:
    return [int(bool(label) and (w in vocabulary or any(s + b"*" in vocabulary for s in stems(w)))) for w in words]


def train(docs: list[tuple[list[bytes], int]], epochs: int = 40, rate: float = 0.3, l2: float = 1e-4) -> Field | None:
    """docs: (tokens, label) of the learning fold."""
    docs = distinct_texts(docs)
    if len({label for _, label in docs}) < 2:
        return None
    vocabulary = toxic_vocabulary(docs)
    tags = [token_labels(w, label, vocabulary) for w, label in docs]
    n = np.array([len(w) for w, _ in docs], np.int64)
    y = np.array([t for ts in tags for t in ts], float)
    number: dict[bytes, int] = {}
    token = np.array([number.setdefault(w, len(number)) for ws, _ in docs for w in ws], np.int64)
    unique = list(number)
    own = [own_slots(w) for w in unique]
    own_word, own_slot = np.repeat(np.arange(len(own)), [len(o) for o in own]), np.array([s for o in own for s in o], np.int64)
    before, after = np.array([_slot("b", w) for w in unique], np.int64), np.array([_slot("a", w) for w in unique], np.int64)
    inner = _inner(n)
    weight = np.zeros(SLOTS)
    step, start = np.array([[0.0, -3.0], [0.0, -3.0]]), np.array([0.0, -3.0])
    y_steps = np.zeros((2, 2))
    np.add.at(y_steps, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    heads = (np.cumsum(n) - n)[n > 0]
    y_start = np.array([(1 - y[heads]).sum(), y[heads].sum()])
    m, v = [np.zeros(SLOTS), np.zeros((2, 2)), np.zeros(2)], [np.zeros(SLOTS), np.zeros((2, 2)), np.zeros(2)]
    size = len(unique)
    for epoch in range(1, epochs + 1):
        e = np.bincount(own_word, weight[own_slot], size)[token]
        e[inner] += weight[before][token[inner - 1]]
        e[inner - 1] += weight[after][token[inner]]
        fwd, bwd = messages(e, n, step, start)
        p = marginals(fwd, bwd)
        miss = y - p
        g_weight = np.bincount(own_slot, np.bincount(token, miss, size)[own_word], SLOTS)
        g_weight += np.bincount(before, np.bincount(token[inner - 1], miss[inner], size), SLOTS)
        g_weight += np.bincount(after, np.bincount(token[inner], miss[inner - 1], size), SLOTS)
        g = [g_weight - l2 * len(y) * weight * 1e-2, y_steps - expected_steps(e, n, step, fwd, bwd), y_start - np.array([(1 - p[heads]).sum(), p[heads].sum()])]
        for k, target in enumerate((weight, step, start)):  # Adam, in place
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            target += rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.99**epoch)) + 1e-6)
    field = Field(weight, step, start, np.zeros(3))
    e = np.bincount(own_word, weight[own_slot], size)[token]
    e[inner] += weight[before][token[inner - 1]]
    e[inner - 1] += weight[after][token[inner]]
    highest, count = per_document(marginals(*messages(e, n, step, start)), n)
    field.curve = _curve(highest, count, np.array([label for _, label in docs], float))
    return field


def per_document(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest probability and the number of tokens above one half, for each document."""
    highest, count = np.zeros(len(n)), np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        heads = (np.cumsum(n) - n)[full]
        highest[full] = np.maximum.reduceat(p, heads)
        count[full] = np.add.reduceat((p > 0.5).astype(float), heads)
    return highest, count


def _curve(highest: np.ndarray, count: np.ndarray, y: np.ndarray, rounds: int = 50, l2: float = 0.01) -> np.ndarray:
    x = np.stack([np.ones(len(y)), highest, np.log1p(count)], axis=1)
    w = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)  # both kinds weigh the same
    b = np.zeros(3)
    for _ in range(rounds):
        p = _sigmoid(x @ b)
        h = (x * (w * p * (1 - p))[:, None]).T @ x + l2 * np.eye(3)
        b += np.linalg.solve(h, x.T @ (w * (y - p)) - l2 * b)
    return b


def learning_sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, toxic: int = TOXIC, clean: int = CLEAN, most: int = SAMPLE_BYTES) -> list[tuple[list[bytes], int]]:
    """Tokens and labels of the learning fold: ``toxic`` + ``clean`` documents at most, whole, chosen by hashes of their ids and then of both id and text.

    A kind ends with the document that brings it to ``most`` bytes, so the driver holds twice that and two documents.
    Rows that repeat id, label and text count once; first numbers are gathered, then the texts of those chosen."""
    rows = labels.where(C.crc_fold(id_col, FOLDS) != HELD_OUT).select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_label"))
    pick = lambda df, label, n, *by: df.where(F.col("_label") == label).distinct().orderBy(F.xxhash64("_id", *by), "_id", *by).limit(n)
    picked = F.broadcast(pick(rows, 1, toxic).unionByName(pick(rows, 0, clean)))  # toxic + clean pairs of numbers at most
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    texts = texts.withColumns({"_size": F.octet_length("_text").cast("long"), "_hash": F.xxhash64("_text")})
    numbers = C.stored(texts.join(picked, "_id").select("_id", "_label", "_hash", "_size"))
    chosen = []
    for label, n in ((1, toxic), (0, clean)):
        total = 0
        for r in pick(numbers, label, n, "_hash").collect():
            if total < most:
                chosen.append((r["_id"], r["_label"], r["_hash"]))
            total += r["_size"]
    C.dropped(numbers)
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, numbers.select("_id", "_label", "_hash").schema)
    got = texts.join(F.broadcast(wanted), ["_id", "_hash"]).select("_id", "_label", "_hash", "_text").dropDuplicates(["_id", "_label", "_hash"]).collect()
    got.sort(key=lambda r: (r._id, r._label, r._text))
    return [([core(c) for c in r._text.encode().split()], r._label) for r in got]


# --- operator -----------------------------------------------------------------


def known_words(key: str, field: Field) -> C.Known:
    return C.held(("toxicity", key), lambda: C.Known(lambda chunks: [field.word(core(c)) for c in chunks], np.float32))


_word = re.compile(rb"[^ \t\n\r\x0b\x0c]+")
_span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))


def spans(text: bytes, p: np.ndarray) -> list[dict]:
    """Runs of toxic tokens as places in the text's characters, with the highest probability of each."""
    at = [m.span() for m in _word.finditer(text)]
    hit = np.flatnonzero(p > 0.5)
    out = []
    for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
        if len(run):
            begin = len(text[: at[run[0]][0]].decode())
            out.append({"begin": begin, "end": begin + len(text[at[run[0]][0] : at[run[-1]][1]].decode()), "probability": float(p[run].max())})
    return out


def tag(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text: str = "text", cut: float = CUT, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic (tokens), spans; and the columns ``carry``, behind them."""
    drop, others = {"_text"} - {"_text" for c in carry if c == text}, [c for c in carry if c != text]
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        f = shared.value
        for part, texts in C.blocks(batches, "_text"):
            if f is None:
                highest, found = np.zeros(len(texts)), [[] for _ in texts]
                count, score = highest, highest
            else:
                words, known = C.Words([t or b"" for t in texts]), known_words(key, f)
                n, inner = words.n, _inner(words.n)
                own, before, after = known.spread(known.rows(words))[0].reshape(-1, 3).T.astype(float)
                e = own.copy()
                e[inner] += before[inner - 1]
                e[inner - 1] += after[inner]
                p = marginals(*messages(e, n, f.step, f.start))
                highest, count = per_document(p, n)
                score, ends = f.score(highest, count), np.cumsum(n)
                found = [spans(t, p[b - m : b]) if c else [] for t, b, m, c in zip(texts, ends.tolist(), n.tolist(), count.tolist(), strict=True)]
            kept = [c for c in part.schema.names if c not in drop]
            new = [pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32), pa.int32()), pa.array(count.astype(np.int64), pa.int64()), pa.array(found, _span)]
            yield pa.RecordBatch.from_arrays([*[C.column(part, c) for c in kept], *new], names=[*kept, "score", "predicted", "n_toxic", "spans"])

    out = F.coalesce(C.crc_fold(id_col, FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), *[F.col(c).alias(f"_c_{c}") for c in others], F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in drop)
    done = C.map_arrow(rows, run, f"{fields}, score double, predicted int, n_toxic long, spans array<struct<begin:long,end:long,probability:double>>")
    return done.select("doc_id", "held_out", "score", "predicted", "n_toxic", "spans", *[F.col("_text" if c == text else f"_c_{c}").alias(c) for c in carry])


def fit_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> Field | None:
    return train(learning_sample(docs, labels, id_col, text))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return tag(docs, fit_field(docs, C.table(spark, sf_dir, "labels")))
