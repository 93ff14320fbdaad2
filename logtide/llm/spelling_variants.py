"""Spelling variants of a corpus's words, by full neighbourhoods.

The vocabulary is counted first. Then each word emits all its distinct deletions,
replacements and insertions over the letters that the vocabulary uses, and these
candidates are joined to the vocabulary by equality: what meets is one edit apart, and
no distance is ever computed. A word of ten letters has about a thousand candidates and
few neighbours, so a task asks a filter of the vocabulary's hashes before it sends a
candidate to the join: a bitmap of at most 2 ** MAX_BITS bits, built in regions and
broadcast. A vocabulary that is too large for one such bitmap is taken in classes of its
hashes, one bitmap and one pass over the words for each; the join is exact in any case.

Words longer than LONG code points would emit a text for each letter of a text, so they
meet by 128-bit hashes of as many bytes as they have letters: of the word without one letter
(insertions, deletions), and of the word with one place left open (replacements; at most
as many words as letters share such a key). Their pairs, which are few, are compared.

Nulls: a null text has no words; a null id is written as nothing in front of the
colon. Rows that repeat count again. Further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Code points that a word has at least, and times that it occurs at least.
LETTERS, OCCURRENCES = 7, 2
#: A form is so many times as frequent as its variant.
RATIO = 10
#: One in so many (document, word) pairs loses a letter.
EVERY = 31
#: Longer words are compared by hashes (code points).
LONG = 32
#: The filter: bits a word, bits at most, bits of a region.
BITS_A_WORD, MAX_BITS, REGION_BITS = 32, 28, 17
#: Candidates that are made at once in a task.
AT_ONCE = 1 << 19

_rng = np.random.default_rng(11)
_LETTER = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = [int(x) | 1 for x in _rng.integers(1 << 62, 1 << 63, 2, dtype=np.uint64)]
_PROBES = _rng.integers(1, 1 << 63, 3, dtype=np.uint64) | np.uint64(1)
_CLASS = _rng.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1)


def _powers(n: int, which: int = 0) -> np.ndarray:
    out = np.full(n, _BASE[which], np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(LONG + 2)
_INVERSE = np.uint64(pow(_BASE[0], -1, 1 << 64))


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n: the runs of Latin letters, in lower case as far as ASCII goes, a letter
    less where the hash of document and run says so."""
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"[A-Za-zÀ-ÿ]{{{letters},}}"), F.lit(0))).alias("run"))
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("run"))
    hashed = runs.select("id", lowered.alias("run")).select("run", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % EVERY == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.char_length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def _of_lengths(words: list[str], most: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (numbers of the words, their letters as a matrix)."""
    by: dict[int, list[int]] = defaultdict(list)
    for k, w in enumerate(words):
        if most is None or len(w) <= most:
            by[len(w)].append(k)
    return {n: (np.array(ks), np.frombuffer("".join(words[k] for k in ks).encode("latin-1"), np.uint8).reshape(len(ks), n)) for n, ks in by.items()}


def _slots(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (h * _PROBES[probe]) >> np.uint64(64 - bits)


def _class(h: np.ndarray, classes: int) -> np.ndarray:
    return ((h * _CLASS) >> np.uint64(40)) % np.uint64(classes)


def _filter(vocab: DataFrame, bits: int, classes: int, of: int) -> tuple[bytearray, set[int]]:
    """The bitmap of the words of class ``of``, and the letters of all words."""

    def slots(batches):
        seen = np.zeros(256, bool)
        for b in batches:
            parts = [np.zeros(0, np.uint64)]
            for n, (_, codes) in _of_lengths(C.column(b, "word").to_pylist()).items():
                seen[np.unique(codes)] = True
                if n <= LONG + 1:
                    h = (_LETTER[0][codes] * _POWER[:n]).sum(axis=1, dtype=np.uint64)
                    parts += [_slots(h[_class(h, classes) == of], p, bits) for p in range(3)]
            at = np.concatenate(parts).astype(np.int64)
            yield C.out_batch({"region": pa.int32(), "at": pa.int32()}, region=(at >> REGION_BITS).astype(np.int32), at=(at & ((1 << REGION_BITS) - 1)).astype(np.int32))
        letters = np.flatnonzero(seen).astype(np.int32)
        yield C.out_batch({"region": pa.int32(), "at": pa.int32()}, region=np.full(len(letters), -1, np.int32), at=letters)

    def regions(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            region, at = C.column(b, "region").to_numpy(), C.column(b, "at").to_numpy()
            for r in np.unique(region).tolist():
                held.setdefault(r, np.zeros(1 << REGION_BITS, bool))[at[region == r]] = True
        for r, bitmap in held.items():
            yield C.out_batch({"region": pa.int32(), "bits": pa.binary()}, region=[r], bits=[np.packbits(bitmap, bitorder="little").tobytes()])

    dealt = C.map_arrow(vocab.select("word"), slots, "region int, at int").distinct().repartition("region")
    out, letters = bytearray(1 << (bits - 3)), set()
    size = 1 << (REGION_BITS - 3)
    for r in C.map_arrow(dealt, regions, "region int, bits binary").toLocalIterator():  # 2 ** MAX_BITS bits and the letters, at any size
        if r.region < 0:
            letters = set(np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")).tolist())
        else:
            out[r.region * size : (r.region + 1) * size] = r.bits
    return out, letters


def _hits(h: np.ndarray, bitmap: np.ndarray, bits: int, classes: int, of: int) -> np.ndarray:
    """Numbers of the candidates whose hashes the filter knows."""
    at = np.arange(len(h))
    for p in range(3):
        slot = _slots(h[at], p, bits)
        at = at[(bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at[_class(h[at], classes) == of] if classes > 1 else at


def neighbourhood(codes: np.ndarray, letters: np.ndarray, keep) -> list[tuple[int, str]]:
    """(row, candidate) of all distinct deletions, replacements and insertions of words of one
    length, of those that ``keep`` (hashes -> numbers) leaves."""
    m, n = codes.shape
    own = _LETTER[0][codes] * _POWER[:n]
    pre = np.zeros((m, n + 1), np.uint64)
    np.cumsum(own, axis=1, out=pre[:, 1:])
    suf = pre[:, -1:] - pre  # of the letters from a place on
    texts = [codes[r].tobytes().decode("latin-1") for r in range(m)]
    alphabet = [chr(a) for a in letters.tolist()]
    out: list[tuple[int, str]] = []

    first = np.ones((m, n), bool)  # of equal letters in a row, the first one goes
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, at = np.nonzero(first)
    for k in keep((pre[:, :-1] + suf[:, 1:] * _INVERSE)[row, at]).tolist():
        r, i = int(row[k]), int(at[k])
        out.append((r, texts[r][:i] + texts[r][i + 1 :]))

    new = _LETTER[0][letters][None, None, :] * _POWER[: n + 1][None, :, None]
    fresh = codes[:, :, None] != letters[None, None, :]
    where = np.flatnonzero(fresh)
    changed = ((pre[:, :-1] + suf[:, 1:])[:, :, None] + new[:, :n]).ravel()[where]
    for k in where[keep(changed)].tolist():
        r, i, a = k // (n * len(alphabet)), k // len(alphabet) % n, k % len(alphabet)
        out.append((r, texts[r][:i] + alphabet[a] + texts[r][i + 1 :]))

    fresh = np.concatenate([fresh, np.ones((m, 1, len(alphabet)), bool)], axis=1)  # in front of an equal letter is behind it
    where = np.flatnonzero(fresh)
    longer = ((pre + suf * np.uint64(_BASE[0]))[:, :, None] + new).ravel()[where]
    for k in where[keep(longer)].tolist():
        r, i, a = k // ((n + 1) * len(alphabet)), k // len(alphabet) % (n + 1), k % len(alphabet)
        out.append((r, texts[r][:i] + alphabet[a] + texts[r][i:]))
    return out


def _candidates(vocab: DataFrame, bits: int, classes: int, of: int) -> DataFrame:
    """word, candidate: the neighbourhoods of the words up to LONG, where the filter knows the candidate."""
    bitmap, letters = _filter(vocab, bits, classes, of)
    sent = vocab.sparkSession.sparkContext.broadcast((bytes(bitmap), sorted(letters)))

    def emit(batches):
        bitmap, letters = sent.value
        bitmap, letters = np.frombuffer(bitmap, np.uint8), np.array(letters, np.uint8)
        for b in batches:
            words, found = C.column(b, "word").to_pylist(), []
            for n, (ks, codes) in _of_lengths(words, LONG).items():
                step = max(1, AT_ONCE // ((n + 1) * max(1, len(letters))))
                for at in range(0, len(ks), step):
                    part = neighbourhood(codes[at : at + step], letters, lambda h: _hits(h, bitmap, bits, classes, of))
                    found += [(words[ks[at + r]], c) for r, c in part]
            yield C.out_batch({"word": pa.string(), "candidate": pa.string()}, word=[w for w, _ in found], candidate=[c for _, c in found])

    return C.map_arrow(vocab.select("word"), emit, "word string, candidate string")


_KEYS = {"kind": pa.string(), "k1": pa.int64(), "k2": pa.int64(), "w1": pa.int64(), "w2": pa.int64()}


def _long_keys(batches):
    """kind, k1, k2, w1, w2: hashes of whole words (w), of words without a letter (d) and
    with an open place (r), each with the word's own."""
    for b in batches:
        for word in C.column(b, "word").to_pylist():
            codes = np.frombuffer(word.encode("latin-1"), np.uint8)
            n, parts = len(codes), []
            for which in (0, 1):
                own = _LETTER[which][codes] * _powers(n, which)
                pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own)])
                parts.append((own, pre, pre[-1]))
            whole = [C.mix64(p[1][-1:] + np.uint64(n)).view(np.int64)[0] for p in parts]
            yield C.out_batch(_KEYS, kind=["w"], k1=[whole[0]], k2=[whole[1]], w1=[whole[0]], w2=[whole[1]])
            if n <= LONG:
                continue
            for at in range(0, n, 100_000):
                to = min(n, at + 100_000)
                place = np.arange(at, to)
                less = [C.mix64(p[1][at:to] + (p[2] - p[1][at + 1 : to + 1]) * np.uint64(pow(_BASE[w], -1, 1 << 64)) + np.uint64(n - 1)).view(np.int64) for w, p in enumerate(parts)]
                opened = [C.mix64((p[2] - p[0][at:to]) ^ C.mix64(place.astype(np.uint64) + np.uint64(n << 32))).view(np.int64) for p in parts]
                first = codes[at:to] != (codes[at - 1 : to - 1] if at else np.concatenate([~codes[:1], codes[: to - 1]]))
                for kind, (k1, k2), pick in (("d", less, first), ("r", opened, slice(None))):
                    k1, k2 = k1[pick], k2[pick]
                    yield C.out_batch(_KEYS, kind=[kind] * len(k1), k1=k1, k2=k2, w1=np.full(len(k1), whole[0]), w2=np.full(len(k1), whole[1]))


def one_edit(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    x, y = (np.frombuffer(t.encode("latin-1"), np.uint8) for t in (a, b))
    differ = np.flatnonzero(x[:short] != y[:short])
    i = int(differ[0]) if len(differ) else short
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _long_pairs(vocab: DataFrame) -> DataFrame:
    """word, near, near_n: the pairs of which the first word is longer than LONG."""
    longer = vocab.where(F.char_length("word") >= LONG)
    keys = C.stored(C.map_arrow(longer.select("word"), _long_keys, "kind string, k1 long, k2 long, w1 long, w2 long"))
    words = keys.where("kind = 'w'").select("k1", "k2")
    less = keys.where("kind = 'd'")
    shorter = less.join(words, ["k1", "k2"]).select(F.col("w1").alias("a1"), F.col("w2").alias("a2"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    opened = keys.where("kind = 'r'")
    other = opened.select("k1", "k2", F.col("w1").alias("b1"), F.col("w2").alias("b2"))
    same = opened.join(other, ["k1", "k2"]).where("w1 <> b1 OR w2 <> b2").select(F.col("w1").alias("a1"), F.col("w2").alias("a2"), "b1", "b2")
    pairs = shorter.unionByName(shorter.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))).unionByName(same).distinct()

    def named(batches):
        for b in batches:
            got = [r for x in _long_keys(iter([b.slice(k, 1) for k in range(b.num_rows)])) if x.column(0)[0].as_py() == "w" for r in zip(x.column(1).to_pylist(), x.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in got], pa.int64()), pa.array([r[1] for r in got], pa.int64())], names=["word", "n", "k1", "k2"])

    names = C.map_arrow(longer.select("word", "n"), named, "word string, n long, k1 long, k2 long")
    a = names.select(F.col("word"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    b = names.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    met = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).where(F.char_length("word") > LONG).select("word", "near", "near_n")

    def compared(batches):
        for b in batches:
            yield b.filter(pa.array([one_edit(w, v) for w, v in zip(C.column(b, "word").to_pylist(), C.column(b, "near").to_pylist(), strict=True)], pa.bool_()))

    return C.map_arrow(met, compared, "word string, near string, near_n long")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """word, near, near_n: each ordered pair of words one edit apart."""
    size = max(1, vocab.count())
    bits = min(MAX_BITS, max(REGION_BITS, math.ceil(math.log2(size * BITS_A_WORD))))
    classes = max(1, math.ceil(size * BITS_A_WORD / (1 << bits)))
    known = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    out = _long_pairs(vocab)
    for of in range(classes):
        met = _candidates(vocab, bits, classes, of)
        out = out.unionByName(met.join(known, met["candidate"] == known["near"]).select("word", "near", "near_n"))
    return out


def spelling_groups(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    form: the most frequent near word (the first in code-point order of equal ones), if it is
    ``ratio`` times as frequent; root: where the forms lead."""
    with C.tidied() as keep:
        vocab = C.stored(vocabulary(docs, letters, occurrences))
        best = near_pairs(vocab).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        joined = vocab.join(best, "word", "left")
        fits = -F.col("best.less") >= F.lit(ratio) * F.col("n")
        words = C.stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
        steps = words.where("form is not null").select("word", F.col("form").alias("root"))
        # every step multiplies n by ratio, so there are few; each round doubles those taken
        most = vocab.agg(F.max("n")).first()[0] or 1
        for _ in range(math.ceil(math.log2(max(1.0, math.log(most, ratio) + 1)))):
            then = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
            steps = C.stored(steps.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        out = words.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return keep(C.stored(out))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(C.table(spark, sf_dir, "documents"))
