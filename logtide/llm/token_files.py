"""Token ids in files, compressed by Re-Pair grammars.

The corpus is dealt out by ranges of the id, so that the files, in the order of
their ``part`` and ``block`` columns, hold the documents in ascending id order.
A task encodes its documents and cuts them into blocks of about ``BLOCK_TOKENS``
ids. Each block is a grammar of its own: in rounds, the most frequent pairs of
neighbouring symbols get nonterminals and are replaced from left to right, never
over the border of two documents. A block stores

* ``left``, ``right``: the two symbols of each rule (uint32, little-endian),
* ``lengths``: how many ids each rule expands to (uint32),
* ``symbols``: the rewritten documents (uint16; ids and nonterminals),
* ``doc_ids``, ``doc_symbols``, ``doc_tokens``: the index of its documents,
* ``start``: ids of all documents of its part before it.

The number of rules is bounded so that a symbol takes 16 bits. Spark's Parquet
writer frames the blocks: its commit protocol makes a lost executor harmless, and
any store Spark can write to will do. ``decode_block`` expands a whole block,
``decode_slice`` opens only the rules that hold the ids asked for.

Defined results: a null text is an empty one (its only id is the end id); rows
with equal ids stand side by side, ordered by their texts; a null id comes first;
an empty table gives files without blocks and no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .encoding import worker_encoder

VOCAB = 49_408
BLOCK_TOKENS = 2_000_000
MAX_RULES = 65_536 - VOCAB
#: Pairs replaced after one count; the fewest places of a pair: a rule takes 12 bytes, each place saves 2.
PER_ROUND, MIN_COUNT = 4_096, 7
COUNT_BITS = 20
FILE_SCHEMA = "part int, block int, start long, n_tokens long, doc_ids array<long>, doc_symbols array<int>, doc_tokens array<int>, left binary, right binary, lengths binary, symbols binary"
_file_types = {"part": pa.int32(), "block": pa.int32(), "start": pa.int64(), "n_tokens": pa.int64(), "doc_ids": pa.list_(pa.int64()), "doc_symbols": pa.list_(pa.int32()), "doc_tokens": pa.list_(pa.int32()), "left": pa.binary(), "right": pa.binary(), "lengths": pa.binary(), "symbols": pa.binary()}


def frequent_pairs(code: np.ndarray, most: int, least: int) -> np.ndarray:
    """Up to ``most`` of the codes, the most frequent ones first, that occur ``least`` times or more.

    Counts by slots, which are never too low, show which codes can be among them; only those are sorted."""
    slot = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - COUNT_BITS)
    slot = slot.astype(np.int64)
    upper = np.bincount(slot, minlength=1 << COUNT_BITS)
    high = upper[upper >= least]
    if not len(high):
        return code[:0]
    enough = least if len(high) <= most else int(np.partition(high, len(high) - most)[len(high) - most])
    pairs, count = np.unique(code[upper[slot] >= enough], return_counts=True)
    top = np.flatnonzero(count >= least)
    return pairs[top[np.lexsort((pairs[top], -count[top]))][:most]]


def repair(ids: np.ndarray, n: np.ndarray, vocab: int = VOCAB, max_rules: int = MAX_RULES, per_round: int = PER_ROUND, min_count: int = MIN_COUNT):
    """The grammar of documents given one after another: (left, right, symbols, symbols of each document)."""
    seq = ids.astype(np.int64)
    last = np.zeros(len(seq), bool)  # no pair begins at a document's last symbol
    last[np.cumsum(n) - 1] = True
    left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = 12
    while (2 << bits) < 32 * per_round:
        bits += 1
    while len(left) < max_rules and len(seq) > 1:
        code = (seq[:-1] << 20) | seq[1:]
        free = ~last[:-1]
        chosen = frequent_pairs(code[free], min(per_round, max_rules - len(left)), min_count)
        if not len(chosen):
            break
        slot_of = lambda c: (c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        table = np.full(1 << bits, -1, np.int32)
        slots = slot_of(chosen)
        table[slots[::-1]] = np.arange(len(chosen))[::-1]  # of two pairs in one slot the more frequent one goes first, the other in a later round
        used = table[slots] == np.arange(len(chosen))
        table[:] = -1
        chosen = chosen[used]
        table[slots[used]] = np.arange(len(chosen))
        which = table[slot_of(code)]
        hit = np.flatnonzero(free & (which >= 0))
        hit = hit[chosen[which[hit]] == code[hit]]
        if not len(hit):
            break
        new_run = np.concatenate([[True], np.diff(hit) > 1])
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]  # of overlapping pairs, from the left
        seq[hit] = vocab + len(left) + which[hit]
        last[hit] = last[hit + 1]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq, last = seq[keep], last[keep]
        left, right = np.concatenate([left, chosen >> 20]), np.concatenate([right, chosen & ((1 << 20) - 1)])
    ends = np.flatnonzero(last) + 1
    return left.astype("<u4"), right.astype("<u4"), seq.astype("<u2"), np.diff(np.concatenate([[0], ends]))


def _size(symbols: np.ndarray, lengths: np.ndarray, vocab: int) -> np.ndarray:
    """Ids of each symbol; ``lengths`` are those of the rules."""
    symbols = symbols.astype(np.int64)
    if not len(lengths):
        return np.ones(len(symbols), np.int64)
    return np.where(symbols >= vocab, lengths[np.maximum(symbols - vocab, 0)], 1).astype(np.int64)


def expansion_lengths(left: np.ndarray, right: np.ndarray, vocab: int = VOCAB) -> np.ndarray:
    """Ids of each rule; a rule uses ids and earlier rules only."""
    out = [0] * len(left)
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        out[k] = (out[a - vocab] if a >= vocab else 1) + (out[b - vocab] if b >= vocab else 1)
    return np.array(out, "<u4")


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, vocab: int = VOCAB) -> np.ndarray:
    """The ids of the symbols: every rule is written out once, those of one depth together; then one gather does the rest."""
    size = expansion_lengths(left, right, vocab).astype(np.int64)
    parts = np.stack([left, right]).astype(np.int64)
    begin = np.concatenate([np.arange(vocab), vocab + np.cumsum(size) - size])
    full = np.concatenate([np.ones(vocab, np.int64), size])
    table = np.empty(vocab + int(size.sum()), "<u4")
    table[:vocab] = np.arange(vocab)
    written = np.zeros(vocab + len(left), bool)
    written[:vocab] = True
    open_rules = np.arange(len(left))
    while len(open_rules):
        ready = written[parts[0, open_rules]] & written[parts[1, open_rules]]
        now, open_rules = open_rules[ready], open_rules[~ready]
        a, b = parts[:, now]
        to = begin[vocab + now]
        table[C.spans_of(to, full[a])] = table[C.spans_of(begin[a], full[a])]
        table[C.spans_of(to + full[a], full[b])] = table[C.spans_of(begin[b], full[b])]
        written[vocab + now] = True
    return table[C.spans_of(begin[symbols], full[symbols])]


def decode_block(block: dict) -> np.ndarray:
    return expand(np.frombuffer(block["symbols"], "<u2"), np.frombuffer(block["left"], "<u4"), np.frombuffer(block["right"], "<u4"))


def decode_slice(block: dict, doc: int, start: int = 0, length: int | None = None, opened: set[int] | None = None) -> np.ndarray:
    """Ids start .. start + length of the block's document number ``doc``: from the symbols that hold
    them down the rules, past every part that ends before or begins behind them by its length.

    ``opened``: takes the rules that were opened."""
    first = int(sum(block["doc_symbols"][:doc]))
    symbols = np.frombuffer(block["symbols"], "<u2")[first : first + int(block["doc_symbols"][doc])]
    left, right, lengths = (np.frombuffer(block[k], "<u4") for k in ("left", "right", "lengths"))
    ends = np.cumsum(_size(symbols, lengths, VOCAB))
    stop = int(ends[-1]) if length is None else min(start + length, int(ends[-1]))
    if stop <= start:
        return np.zeros(0, "<u4")
    a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
    place = int(ends[a - 1]) if a else 0
    todo, out = symbols[a:b][::-1].tolist(), []
    while todo:
        symbol = todo.pop()
        size = int(lengths[symbol - VOCAB]) if symbol >= VOCAB else 1
        if place >= stop:
            break
        if place + size <= start:
            place += size
        elif symbol < VOCAB:
            out.append(symbol)
            place += 1
        else:
            if opened is not None:
                opened.add(symbol - VOCAB)
            todo += [int(right[symbol - VOCAB]), int(left[symbol - VOCAB])]
    return np.array(out, "<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    def encode(batches):
        encoder, part, block, start = worker_encoder(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def packed():
            ids, n = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            left, right, symbols, per_doc = repair(ids, n)
            return C.out_batch(_file_types, part=[part], block=[block], start=[start], n_tokens=[len(ids)], doc_ids=[[i for h in held for i in h[0]]], doc_symbols=[per_doc], doc_tokens=[n], left=[left.tobytes()], right=[right.tobytes()], lengths=[expansion_lengths(left, right).tobytes()], symbols=[symbols.tobytes()])

        for piece, texts in C.blocks(batches, text):
            ids, n = encoder.encode(texts)
            held.append((C.column(piece, id_col).to_pylist(), ids, n))
            if sum(len(h[1]) for h in held) >= block_tokens:
                yield packed()
                block, start = block + 1, start + sum(len(h[1]) for h in held)
                held = []
        if held:
            yield packed()

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text)
    ordered = rows.repartitionByRange(F.col(id_col), F.xxhash64(text)).sortWithinPartitions(id_col, F.xxhash64(text), text)
    C.map_arrow(ordered, encode, FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files, decoded: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = read_token_files(spark, path)
    base, at = {}, 0
    for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row for each part, not for each document
        base[r.part], at = at, at + r.n
    shared = spark.sparkContext.broadcast(base)
    types = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}

    def decode(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.slice(k, 1).to_pylist()[0]
                ids, n = decode_block(block), np.array(block["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                yield C.out_batch(types, doc_id=block["doc_ids"], start=shared.value[block["part"]] + block["start"] + ends - n, n_tokens=n, ids_crc32=crc)

    return C.map_arrow(files, decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = C.scratch_dir(spark)
    write_token_files(C.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return document_digests(spark, path)
