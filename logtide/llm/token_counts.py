"""Token counts by a two-tier look-up of pre-tokens.

A pre-token is a run of blanks with the characters up to the next blank, or the
part of it from a line feed on. No piece of the vocabulary reaches over such a
border, so a text has as many tokens as its pre-tokens have together.

Tier one is a compact hash table (64-bit hash -> count) of the pre-tokens that
are frequent in the whole corpus. Each task encodes the heavy hitters of what it
read, ``SUMMARY`` of them at most, and sends their hashes, token counts and
frequencies; the ``FREQUENT`` most frequent hashes are broadcast: at most 9 bytes an
entry, whatever the size of the corpus. Tier two is a cache in each Python worker for
the misses. Pre-tokens themselves never leave a task. Both tiers only save work: what
they don't hold is encoded by the library.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; rows
are independent, so repeated rows and null ids come back as they are; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Entries of the broadcast table, entries each task sends for it.
FREQUENT, SUMMARY = 65_536, 4_096
#: Bytes of text after which a task forgets the long keys it has counted.
FORGET = 32_000_000
GLUE = b"\xff\n"  # a line feed that no blank stands before; 0xff isn't in UTF-8
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def pretokens(text: bytes) -> list[bytes]:
    """The keys whose token counts add up to that of the text."""
    if not text:
        return []
    text = text.replace("▁".encode(), b" ")  # the library writes a blank as this character
    keys = text.replace(b"\n", b" " + GLUE).split(b" ")
    if b"" not in keys and not text.startswith(b"\n"):
        return keys
    keys, held = [], b""
    parts = text.split(b" ")
    for k, part in enumerate(parts):  # each part has one blank before it (the first: the library's own)
        if part:
            keys.append(held + part)
            held = b""
        elif k == len(parts) - 1:
            keys.append(held)  # blanks at the end: the library adds the last one
        else:
            held += b" "
    return keys


@lru_cache(maxsize=2)
def encoder(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def key_length(path: str):
    sp = encoder(path)

    def length(key: bytes) -> int:
        if not key:  # a single blank at the end
            return 1
        if key.startswith(GLUE):
            return len(sp.encode(key[1:].decode())) - 1
        return len(sp.encode(key.decode()))

    return length


class Lengths(C.WordCache):
    """The worker's cache over the broadcast table."""

    def __init__(self, path: str, hashes: np.ndarray, counts: np.ndarray, most: int = C.CACHE_ENTRIES):
        self.slow = key_length(path)
        self.hashes, self.counts = hashes, counts
        super().__init__(self.find, most)

    def find(self, key: bytes) -> int:
        import xxhash

        h = np.uint64(xxhash.xxh64_intdigest(key))
        at = int(np.searchsorted(self.hashes, h))
        if at < len(self.hashes) and self.hashes[at] == h:
            return int(self.counts[at])
        return self.slow(key)


def worker_cache(path: str, key: str, shared) -> Lengths:
    """One cache for each table."""
    return C.held(("lengths", key), lambda: Lengths(path, shared.value["hashes"], shared.value["counts"]))


def frequent_lengths(docs: DataFrame, model_path: str, text: str = "text", summary: int = SUMMARY, keep: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and token counts of the most frequent pre-tokens, from every task's heavy hitters."""

    def heavy(batches):
        import xxhash

        seen: Counter = Counter()
        size = 0
        for _, texts in C.blocks(batches, text):
            for t in texts:
                seen.update(pretokens(t or b""))
                size += len(t or b"")
            if size > FORGET:
                seen, size = Counter({k: n for k, n in seen.items() if len(k) <= C.LONGEST_KEY}), 0
            if len(seen) > 40 * summary:  # keep the hitters, forget the tail
                seen = Counter(dict(seen.most_common(8 * summary)))
        top = sorted((x for x in seen.items() if len(x[0]) <= C.LONGEST_KEY), key=lambda x: (-x[1], x[0]))[:summary]
        length = key_length(model_path)
        h = np.array([xxhash.xxh64_intdigest(k) for k, _ in top], np.uint64).view(np.int64)
        yield C.out_batch({"h": pa.int64(), "length": pa.int64(), "n": pa.int64()}, h=h, length=[length(k) for k, _ in top], n=[n for _, n in top])

    hitters = C.map_arrow(docs.select(text), heavy, "h long, length long, n long")
    every = hitters.groupBy("h").agg(F.sum("n").alias("n"), F.min("length").alias("length"), F.max("length").alias("most"))
    table = every.where("length = most and most <= 255").orderBy(F.desc("n"), "h").limit(keep).select("h", "length").toArrow()  # FREQUENT rows of two numbers
    h, length = table.column("h").to_numpy().view(np.uint64), table.column("length").to_numpy().astype(np.uint8)
    order = np.argsort(h)
    return h[order], length[order]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text", limit: int = 4096, keep: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit."""
    import uuid

    name = uuid.uuid4().hex
    hashes, counts = frequent_lengths(docs, model_path, text, keep=keep)
    shared = docs.sparkSession.sparkContext.broadcast({"hashes": hashes, "counts": counts})

    def count(batches):
        for part, texts in C.blocks(batches, text):
            cache = worker_cache(model_path, name, shared)
            keys = [pretokens(t or b"") for t in texts]
            flat, n = C.looked_up(cache, keys)
            total = np.concatenate([[0], np.cumsum(flat)])[np.cumsum(n)] if len(n) else np.zeros(0, np.int64)
            tokens = np.diff(np.concatenate([[0], total]))
            cache.trim()
            yield C.out_batch({"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_()}, doc_id=C.column(part, id_col).cast(pa.int64()), n_bytes=[len(t or b"") for t in texts], n_tokens=tokens, over_limit=tokens > limit)

    return C.map_arrow(docs.select(id_col, text), count, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(C.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
