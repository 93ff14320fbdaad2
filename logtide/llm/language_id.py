"""Language identification by rank-order profiles of n-grams.

A word is a run of letters and combining marks that has a letter, lower-cased. With a
border mark on either side it gives its n-grams of one to three characters (a border
alone is none). An n-gram is known by its characters: three code points of 21 bits make
one number. A language's profile is its ``PROFILE`` most frequent n-grams, counted over
all documents it may learn from, in order of frequency (ties: smaller number first). A
document's own profile is made in the same way; its distance to a language is the sum,
over its n-grams, of how far each is out of place there, ``PROFILE`` where the language
doesn't have it. The nearest language is predicted (ties: by name); the score is the lead
over the second nearest, (d2 - d1) / d2.

Counts are summed inside tasks first, so at most one row for each language, n-gram and
task is shuffled (more where a task has met over ``HELD`` of them). Broadcast are the
profiles: PROFILE numbers for each language; a task looks them up by n-gram, so languages
that share nothing with a document cost it nothing.

Defined results: null texts and texts without a letter are ``und`` with score 0; a
null id is never held out nor learned from; null languages are not learned from; if
nothing could be learned, every text is ``und``; rows are independent, so repeated
rows come back as often; texts of many megabytes are counted piece by piece, cut at
blanks; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

PROFILE = 300
#: Counts that a task holds before it passes them on.
HELD = 2_000_000
#: Bytes of a text beyond which it is counted in pieces.
LONG = 4_000_000
#: Codes up to which n-grams are numbered by a table, not by sorting.
TABLE = 1 << 22
BORDER = ord("_")
UNKNOWN = "und"
FOLDS, HELD_OUT = 5, 0
_kinds = np.full(0x110000, 3, np.uint8)  # 1: letter, 2: mark, 0: neither, 3: not met yet


def _met(points: np.ndarray) -> np.ndarray:
    """The code points that occur, ascending; their kinds are known afterwards."""
    seen = np.zeros(len(_kinds), bool)
    seen[points] = True
    new = np.flatnonzero(seen & (_kinds == 3))
    _kinds[new] = [1 if chr(c).isalpha() else 2 * (unicodedata.category(chr(c))[0] == "M") for c in new.tolist()]
    return np.flatnonzero(seen)


class Grams:
    """The n-grams of a block of texts: for each length an array (one text after another) of numbers
    into ``code``, which ascends; those of text k are at[ends[k]:ends[k + 1]]."""

    def __init__(self, texts: list[bytes | None]):
        lowered = [(t or b"").decode().lower() for t in texts]
        points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
        met = _met(points)
        kind = _kinds[points]
        edge = np.diff(np.concatenate([[0], kind != 0, [0]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        letters = np.concatenate([[0], np.cumsum(kind == 1, dtype=np.int32)])
        real = letters[end] > letters[start]  # marks alone are no word
        start, size = start[real], (end - start)[real]
        # every word between two borders of its own; 0 means no character
        alphabet = np.union1d(met[_kinds[met] != 0], [BORDER])
        wide = len(alphabet) + 1
        number = np.zeros(len(_kinds), np.int32 if wide**3 < 2**31 else np.int64)
        number[alphabet] = np.arange(1, wide)
        first = np.cumsum(size + 2) - (size + 2)
        x = np.full(int((size + 2).sum()), number[BORDER])
        x[C.spans_of(first + 1, size)] = number[points[C.spans_of(start, size)]]
        last = np.zeros(len(x), bool)
        last[first + size + 1] = True
        two = x[:-1] * wide + x[1:]
        three = two[:-1] * wide + x[2:]
        codes = [x[x != number[BORDER]], two[~last[:-1]], three[~(last[:-2] | last[1:-1])]]
        words_to = np.searchsorted(start, np.cumsum([0, *[len(t) + 1 for t in lowered]]))
        self.ends = [np.concatenate([[0], np.cumsum(n)])[words_to] for n in (size, size + 1, size)]
        if wide**3 <= TABLE:
            met = np.zeros(wide**3, bool)
            for c in codes:
                met[c] = True
            code = np.flatnonzero(met)
            number = np.zeros(wide**3, np.int32)
            number[code] = np.arange(len(code))
            self.at = [number[c] for c in codes]
        else:
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            self.at = np.split(at, np.cumsum([len(c) for c in codes])[:-1])
        point = np.concatenate([[0], alphabet]).astype(np.int64)
        code = code.astype(np.int64)
        self.code = (point[code // wide**2] << 42) | (point[code // wide % wide] << 21) | point[code % wide]

    def counts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The codes of these texts together, ascending, and how often each occurs."""
        n = np.bincount(np.concatenate([at[ends[k] : ends[k + 1]] for k in texts for at, ends in zip(self.at, self.ends, strict=True)]), minlength=len(self.code))
        have = np.flatnonzero(n)
        return self.code[have], n[have]


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of several counts."""
    code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([p[1] for p in parts]), len(code)).astype(np.int64)


def pieces(text: bytes | None) -> list[bytes]:
    """A text cut at blanks into pieces of about LONG bytes."""
    out, at, text, most = [], 0, text or b"", LONG
    while len(text) - at > most:
        cut = text.find(b" ", at + most)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def text_counts(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts of each text."""
    cut = [pieces(t) for t in texts]
    if all(len(c) == 1 for c in cut):
        grams = Grams(texts)
        return [grams.counts([k]) for k in range(len(texts))]
    return [added([Grams([p]).counts([0]) for p in c]) for c in cut]


def ranked(code: np.ndarray, n: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order; ``code`` ascends."""
    key = n.astype(np.int64) * len(n) + np.arange(len(n))[::-1]
    if len(key) > most:
        top = np.sort(np.argpartition(-key, most)[:most])
        code, key = code[top], key[top]
    return code[np.argsort(-key)]


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = FOLDS, held_out: int = HELD_OUT, profile: int = PROFILE) -> dict[str, list[int]]:
    """Language -> the codes of its profile in order."""
    rows = docs.where(C.crc_fold(id_col, folds) != held_out).where(F.col(lang).isNotNull() & F.col(text).isNotNull())

    def count(batches):
        held: dict[str, list] = {}
        size = 0

        def rows_of():
            for name in sorted(held):
                code, n = added(held[name])
                yield C.out_batch({"lang": pa.string(), "gram": pa.int64(), "n": pa.int64()}, lang=[name] * len(code), gram=code, n=n)

        for part, texts in C.blocks(batches, "text"):
            by_lang: dict[str, list[int]] = {}
            for k, name in enumerate(C.column(part, "lang").to_pylist()):
                by_lang.setdefault(name, []).append(k)
            long = any(len(t or b"") > LONG for t in texts)
            grams = None if long else Grams(texts)
            for name, own in by_lang.items():
                new = added(text_counts([texts[k] for k in own])) if long else grams.counts(own)
                held.setdefault(name, []).append(new)
                size += len(new[0])
            if size > HELD:
                held = {name: [added(parts)] for name, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD // 2:
                    yield from rows_of()
                    held, size = {}, 0
        yield from rows_of()

    counted = C.map_arrow(rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile)
    out: dict[str, list] = {}
    for r in top.orderBy("lang", "rank").collect():  # PROFILE rows a language
        out.setdefault(r.lang, []).append(r.gram)
    return out


class Ranks:
    """The profiles, as the languages and ranks of each n-gram."""

    def __init__(self, profiles: dict[str, list[int]], profile: int = PROFILE):
        self.names, self.profile = sorted(profiles), profile
        code = np.array([c for n in self.names for c in profiles[n]], np.int64)
        size = np.array([len(profiles[n]) for n in self.names], np.int64)
        order = np.argsort(code, kind="stable")
        self.lang, self.rank = np.repeat(np.arange(len(size)), size)[order], C.spans_of(np.zeros(len(size), np.int64), size)[order]
        self.code, first, self.many = np.unique(code[order], return_index=True, return_counts=True)
        self.first = first

    def distances(self, mine: np.ndarray) -> np.ndarray:
        """To each language, of a document's profile."""
        out = np.full(len(self.names), self.profile * len(mine), np.int64)
        at = np.minimum(np.searchsorted(self.code, mine), len(self.code) - 1)
        place = np.flatnonzero(self.code[at] == mine)
        at = at[place]
        entry = C.spans_of(self.first[at], self.many[at])
        gap = np.abs(self.rank[entry] - np.repeat(place, self.many[at])) - self.profile
        return out + np.bincount(self.lang[entry], gap, len(out)).astype(np.int64)

    def nearest(self, code: np.ndarray, n: np.ndarray) -> tuple[str, float]:
        """The language of these counts and the lead over the next one."""
        if not len(code) or not self.names:
            return UNKNOWN, 0.0
        distance = self.distances(mine := ranked(code, n, self.profile))
        order = np.argsort(distance, kind="stable")
        best = int(distance[order[0]])
        second = int(distance[order[1]]) if len(order) > 1 else self.profile * len(mine)
        return self.names[order[0]], (second - best) / second if second else 0.0


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, profile: int = PROFILE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score; and the columns ``carry``, behind them."""
    drop, others = {"_text"} - {"_text" for c in carry if c == text}, [c for c in carry if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(Ranks(profiles, profile))

    def run(batches):
        ranks = shared.value
        for part, texts in C.blocks(batches, "_text"):
            got = [ranks.nearest(*c) for c in text_counts(texts)]
            kept = [c for c in part.schema.names if c not in drop]
            yield pa.RecordBatch.from_arrays([*[C.column(part, c) for c in kept], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*kept, "lang_pred", "score"])

    out = F.coalesce(C.crc_fold(id_col, folds) == held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), *[F.col(c).alias(f"_c_{c}") for c in others], F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in drop)
    done = C.map_arrow(rows, run, f"{fields}, lang_pred string, score double")
    return done.select("doc_id", "held_out", "lang_pred", "score", *[F.col("_text" if c == text else f"_c_{c}").alias(c) for c in carry])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return predict(docs, learn_profiles(docs))
