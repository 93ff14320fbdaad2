"""License scans: fuzzy search for short notices.

Texts are reduced to their words (A-Z lower-cased, everything but digits, letters
and non-ASCII characters a border), one blank between words. A notice that may
have k edits is split into k + 1 pieces: if it occurs with k edits at most, one of
the pieces occurs unchanged (pigeonhole). Exact search for the pieces over a whole
block of texts locates candidates; the regex library's bounded-error matching then
looks for the notice around each, between borders of words, and reports the best span
and its edits. Where a notice stands without edits, spans with edits that overlap it are dropped.
Phrases without edits give the base labels.

Defined results: a null or empty text has no words, no labels, score 0 and null
places; each row is scanned on its own, repeated or not, whatever its length; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Phrases and labels of the base rules.
BASE = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))
#: (label, notice, edits allowed)
NOTICES = (
    ("apache-2.0", b"licensed under the apache license version 2 0", 4),
    ("mit", b"released under the mit license", 2),
    ("gpl", b"licensed under the gnu general public license", 4),
    ("cc-by", b"licensed under cc by", 1),
    ("cc-by-nc", b"licensed under cc by nc", 1),
    ("cc-by-sa", b"licensed under cc by sa", 1),
    ("reserved", b"all rights reserved", 1),
    ("bsd", b"redistribution and use in source and binary forms", 4),
    ("mpl-2.0", b"subject to the terms of the mozilla public license", 4),
    ("lgpl", b"gnu lesser general public license", 2),
    ("public-domain", b"released into the public domain", 2),
    ("unlicense", b"this is free and unencumbered software", 3),
)
_to_words = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def seeds(notice: bytes, k: int) -> list[tuple[int, bytes]]:
    """The notice in k + 1 pieces of about the same length, with their places."""
    cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=256)
def fuzzy(notice: bytes, k: int):
    import regex

    return regex.compile(rb"(?b)(?:" + regex.escape(notice) + rb"){e<=%d}" % k)


def word_spans(page: bytes, low: int, high: int, begin: int, size: int, k: int, inside: tuple[int, int]):
    """(begin, end) of the runs of whole words around ``inside`` that begin within k characters of ``begin`` and
    are as long as ``size`` to within k; the text lies in [low, high)."""
    for a in range(max(low, begin - k), min(inside[0], begin + k) + 1):
        if a == low or page[a - 1] == 32:
            for b in range(max(inside[1], a + size - k), min(high, a + size + k) + 1):
                if b == high or page[b] == 32:
                    yield a, b


def places(haystack: bytes, needle: bytes):
    at = haystack.find(needle)
    while at >= 0:
        yield at
        at = haystack.find(needle, at + 1)


def fuzzy_spans(texts: list[bytes], notices=NOTICES) -> list[list[tuple[int, int, str, int]]]:
    """For each text of single-blank words: (begin, end, label, edits), one span for each place of a notice."""
    page = b"\n".join(texts)
    begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
    found: list[list] = [[] for _ in texts]
    for label, notice, k in notices:
        pattern, tried = fuzzy(notice, k), set()
        for offset, piece in seeds(notice, k):
            for at in places(page, piece):
                doc = int(np.searchsorted(begin, at, side="right")) - 1
                low, high = int(begin[doc]), int(begin[doc + 1]) - 1
                for a, b in word_spans(page, low, high, at - offset, len(notice), k, (at, at + len(piece))):
                    if (a, b) not in tried:
                        tried.add((a, b))
                        if m := pattern.fullmatch(page, a, b):
                            found[doc].append((a - low, b - low, label, sum(m.fuzzy_counts)))
    return [_best(spans) for spans in found]


def _best(spans: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Of overlapping spans of one label, the one with the fewest edits (then the first); of different labels, one without edits before those with."""
    kept: list = []
    held: dict[str, tuple[list[int], list[int]]] = {}  # of each label: begins and ends of what is kept, ascending
    ordered = sorted(set(spans), key=lambda s: (s[3], s[0], s[1], s[2]))
    exact = [s for s in ordered if not s[3]]
    exact_begins, exact_ends = [s[0] for s in exact], np.maximum.accumulate([s[1] for s in exact]) if exact else []
    for s in ordered:
        k = bisect_left(exact_begins, s[1])
        if s[3] and k and exact_ends[k - 1] > s[0]:
            continue
        begins, ends = held.setdefault(s[2], ([], []))
        k = bisect_left(begins, s[1])
        if not k or ends[k - 1] <= s[0]:
            begins.insert(k, s[0])
            ends.insert(k, s[1])
            kept.append(s)
    return sorted(kept)


def base_places(text: bytes, base=BASE) -> list[tuple[int, str]]:
    """(word number, label) of every place of a base phrase."""
    padded = b" " + text + b" "
    blanks = np.flatnonzero(np.frombuffer(padded, np.uint8) == 32)
    return sorted((int(np.searchsorted(blanks, at)), label) for phrase, label in base for at in places(padded, b" " + phrase + b" "))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<begin:long,end:long,label:string,edits:long>>"
_span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64())]))
_types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": _span}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", notices=NOTICES, base=BASE) -> DataFrame:
    """One row per document; ``spans`` are places in its words joined by single blanks."""
    sizes = {label: len(n) for label, n, _ in notices}

    def run(batches):
        for part, texts in C.blocks(batches, "text"):
            words = [(t or b"").translate(_to_words).split() for t in texts]
            joined = [b" ".join(w) for w in words]
            spans = fuzzy_spans(joined, notices)
            plain = [base_places(t, base) if any(p in t for p, _ in base) else [] for t in joined]
            names = [sorted({label for _, label in p}) for p in plain]
            every = [sorted({*n, *[s[2] for s in found]}) for n, found in zip(names, spans, strict=True)]
            score = [max([1.0 * bool(p), *[1 - s[3] / sizes[s[2]] for s in found]]) for p, found in zip(plain, spans, strict=True)]
            yield C.out_batch(
                _types,
                doc_id=C.column(part, "doc_id"),
                n_words=[len(w) for w in words],
                n_base=[len(p) for p in plain],
                first_word=[p[0][0] if p else None for p in plain],
                last_word=[p[-1][0] if p else None for p in plain],
                base_labels=[",".join(n) for n in names],
                labels=[",".join(n) for n in every],
                score=score,
                spans=[[dict(zip(("begin", "end", "label", "edits"), s, strict=True)) for s in found] for found in spans],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return C.map_arrow(rows, run, SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(C.table(spark, sf_dir, "documents"))
