"""The n-gram Jaccard join: which documents link, and what they reach by links.

A document is a row of a sparse document x shingle matrix (distinct shingles of
``WIDTH`` words); the overlaps of all documents are that matrix times its transpose.
It is never formed whole:

1. Rows with equal sets are one class; only one row of each class goes on.
2. Sizes bound overlaps. Two sets with similarity s or more share a shingle among the
   first n - ceil(s n) + 1 of each, in any common order. Only these entries enter the
   product. The order puts shingles that are frequent in the corpus last (``HEAVY`` of
   them are known to all tasks), so the columns stay short.
3. Entries are dealt out by ranges of (shingle, size, class), so a column that half of
   the corpus has is spread over many tasks. Neighbours in a column are compared first;
   what links that way is one component. Later steps look at the columns that still hold
   several components, those of the same classes once.
4. Each class has the counts of its shingles in ``CELLS`` cells; the sum of the cells'
   minima is an upper bound of two sets' overlap. Blocks of ``BLOCK`` x ``BLOCK`` classes
   of a column are multiplied, cells by cells. Pairs of different components above the
   bound that their sizes demand make families; each task gives a forest of them (an entry
   each at most), not the pairs.
5. In families of more than ``ROOM`` shingles the bound is taken again from about as many
   cells as a set has shingles (``SKETCH`` bytes of them come together at once), which
   leaves families of sets that have most of their shingles in common.
6. A family's sets come together in blocks of about ``ROOM`` shingles and are multiplied:
   overlaps are counted shingle by shingle, and of the links a forest comes out. Large
   families are cut by size as well, as only sets of similar size can link.
7. Components of all links, by large-star and small-star rounds.

So rows grow with entries and members, not with pairs, however large a group is. A key that
holds more than 1 / HOT of a join's rows has its partner broadcast (HOT partners at most).

No link between different sets is lost: a pair that could link is in one family and
compared there by all its shingles (by their 64-bit hashes), or both are connected already.

Defined results: a text without words (null, empty) has an empty set, links with
nothing and is its own component; fewer words than WIDTH give one shingle of all; rows
are told apart by position only, so repeated rows link with each other, and rows that
share an id are compared like any others; a null id never names a component unless no
member has an id (then null); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WIDTH, PERCENT = 5, 80
#: Frequent shingles known to all tasks, the count in one task that makes a candidate.
HEAVY, HEAVY_AT, HEAVY_BUFFER = 100_000, 8, 2_000_000
CELLS, BLOCK = 256, 1_024
#: Bytes of cells in a block, where a set counts for LEAST_WEIGHT at least; cells of a small set.
SKETCH, LEAST_WEIGHT, LEAST_CELLS = 12_000_000, 1_024, 64
#: Shingles of a block of sets, entries of one component's columns that are multiplied together, nodes a task keeps in mind.
ROOM, ENTRIES, NODES = 1_000_000, 4_096, 500_000
#: Edges up to which one task joins them up.
FEW_EDGES = 100_000
BROADCAST_ROWS = 200_000
HOT = 1_000

# --- sets ---------------------------------------------------------------------


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; a text of fewer words has one of all."""
    words = C.Words([(t or b"").lower() for t in texts])
    every, ends, out = C.mix64(C.windows(words.hash, width)), words.ends().tolist(), []
    for a, b in zip(ends, ends[1:], strict=False):
        if b - a >= width:
            s = np.sort(every[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(C.mix64(C.windows(words.hash[a:b], b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> bytes | None:
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def least_shared(n, percent: int = PERCENT):
    """Shingles that a set of n has in common with any set it links with, at least."""
    return (percent * n + 99) // 100


def prefix(s: np.ndarray, heavy: np.ndarray, weight: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The entries that any linked set must share one of: light shingles first."""
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
        w = np.where(heavy[at] == s, weight[at], 0)
        if w.any():
            s = s[np.lexsort((s, w))]
    return s[: len(s) - least_shared(len(s), percent) + 1]


def cells(s: np.ndarray) -> bytes:
    """Counts of the shingles by their first byte; all 255 if one doesn't fit (then it bounds nothing)."""
    c = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=CELLS)
    return (np.full(CELLS, 255) if c.max(initial=0) > 254 else c).astype(np.uint8).tobytes()


def fine_cells(s: np.ndarray) -> bytes:
    """As cells(), in the largest power of two of cells that isn't above the set's size."""
    bits = max(LEAST_CELLS, len(s)).bit_length() - 1
    c = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return (np.full(len(c), 255) if c.max(initial=0) > 120 else c).astype(np.uint8).tobytes()


def packed(s: np.ndarray) -> bytes:
    """A sorted set as the steps between its shingles, byte by byte: the high bytes are nearly
    all 0, so Spark's compression of files and shuffles leaves them out."""
    return np.diff(s, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel())


# --- passes over the texts ----------------------------------------------------


def keyed(docs: DataFrame, id_col: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    both = [F.col(id_col).cast("long"), F.coalesce(F.col(text), F.lit(""))]
    return docs.select(both[0].alias("doc_id"), F.col(text).alias("text"), F.xxhash64(*both).alias("k1"), F.hash(*both).alias("k2"), *[F.col(c).alias(f"_c_{c}") for c in carry])


def heavy_shingles(docs: DataFrame, width: int = WIDTH, keep: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many distinct texts have, sorted, and the log2 of how many; they only set an order."""

    def hitters(batches):
        seen, held, size = set(), [], 0

        def flush():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= HEAVY_AT
            return C.out_batch({"h": pa.int64(), "n": pa.int64()}, h=u[many].view(np.int64), n=n[many])

        for _, texts in C.blocks(batches, "text"):
            for s in shingle_sets(texts, width):
                c = class_of(s)
                if c is None or c in seen:
                    continue
                seen.add(c)
                held.append(s)
                size += len(s)
            if size >= HEAVY_BUFFER:
                yield flush()
                held, size = [], 0
                if len(seen) > 500_000:
                    seen.clear()
        if held:
            yield flush()

    rows = C.map_arrow(docs.select("text"), hitters, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(keep).collect()
    h = np.array([r.h for r in rows], np.int64).view(np.uint64)
    w = np.array([max(1, int(r.n).bit_length()) for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], w[order]


def document_sets(docs: DataFrame, heavy, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: its key, size, class, prefix and cell counts."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        h, w = shared.value
        for part, texts in C.blocks(batches, "text"):
            sets = shingle_sets(texts, width)
            first = [prefix(s, h, w, percent).view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, first)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first) if first else np.zeros(0, np.int64)))
            kept = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[C.column(part, c) for c in kept], pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.binary()), lists, pa.array([cells(s) for s in sets], pa.binary())], names=[*kept, "n", "class", "prefix", "cells"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return C.map_arrow(docs, run, f"{fields}, n long, class binary, prefix array<long>, cells binary")


def full_sets(docs: DataFrame, needed: DataFrame, width: int = WIDTH) -> DataFrame:
    """The sets of the classes in ``needed`` (node, k1, k2), made again from one text of each."""
    few = needed.count() <= BROADCAST_ROWS
    rows = docs.select("text", "k1", "k2").join(F.broadcast(needed) if few else needed, ["k1", "k2"]).select("node", "text")

    def run(batches):
        for part, texts in C.blocks(batches, "text"):
            sets = shingle_sets(texts, width)
            yield C.out_batch({"node": pa.int64(), "items": pa.binary(), "fine": pa.binary()}, node=C.column(part, "node"), items=[packed(s) for s in sets], fine=[fine_cells(s) for s in sets])

    return C.map_arrow(rows, run, "node long, items binary, fine binary")


# --- the product --------------------------------------------------------------


def columns(reps: DataFrame) -> DataFrame:
    """Entries of columns with two classes or more: (h, node, n) and the entry before (prev, prev_n).

    The first and the last column of a task may go on in another one, so they stay as well."""
    entries = reps.select(F.explode("prefix").alias("h"), "n", "node")
    dealt = entries.repartitionByRange("h", "n", "node").sortWithinPartitions("h", "n", "node")

    def scan(batches):
        last, last_kept, first = None, True, True
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).select(["h", "n", "node"])
            h = t.column("h").to_numpy()
            node, n = t.column("node").combine_chunks(), t.column("n").to_numpy()
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            before = np.maximum(np.arange(len(h)) - 1, 0)
            prev = pc.if_else(pa.array(same), node.take(pa.array(before)), pa.scalar(None, pa.int64()))
            prev_n = np.where(same, n[before], 0)
            if last is not None and last["h"][0] == h[0]:
                same[0] = last_kept = True
                prev = pa.concat_arrays([pa.array([last["node"][0]], pa.int64()), prev.slice(1)])
                prev_n[0] = last["n"][0]
            if last is not None and last_kept:
                yield C.out_batch(types, **last)
            keep = same.copy()
            keep[:-1] |= same[1:]
            keep[0] |= first
            first = False
            whole = {"h": pa.array(h), "node": node, "n": pa.array(n), "prev": prev, "prev_n": pa.array(prev_n)}
            last = {k: v.slice(len(h) - 1).to_pylist() for k, v in whole.items()}
            last_kept = bool(keep[-1])
            keep[-1] = False
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([whole[k].filter(mask) for k in types], names=list(types))
        if last is not None:
            yield C.out_batch(types, **last)

    types = {"h": pa.int64(), "node": pa.int64(), "n": pa.int64(), "prev": pa.int64(), "prev_n": pa.int64()}
    return C.map_arrow(dealt, scan, "h long, node long, n long, prev long, prev_n long")


def size_allows(a, b, percent: int = PERCENT):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def bound_allows(x: np.ndarray, y: np.ndarray, n_x, n_y, percent: int = PERCENT) -> np.ndarray:
    """Whether the overlap that the cell counts x and y (a row each) still allow is enough."""
    overlap = np.minimum(np.minimum(x, y).sum(axis=1, dtype=np.int64), np.minimum(n_x, n_y))
    unknown = (x[..., 0] == 255) & (y[..., 0] == 255)
    overlap = np.where(unknown, np.minimum(n_x, n_y), overlap)
    return (100 + percent) * overlap >= percent * (n_x + n_y)


def possible(pairs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b; stored) that the cells' bound allows."""
    few = pairs.count() <= BROADCAST_ROWS  # then rows of CELLS bytes for each are sent, else both sides are shuffled
    for name in ("a", "b"):
        of = reps.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("cells").alias(f"{name}_cells"))
        pairs = of.join(F.broadcast(pairs) if few else pairs, name)

    def test(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(C.column(batch, c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in ("a_cells", "b_cells"))
            keep = bound_allows(x, y, C.column(batch, "a_n").to_numpy(), C.column(batch, "b_n").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return C.map_arrow(pairs.select("a", "b", "a_n", "b_n", "a_cells", "b_cells"), test, "a long, b long")


class Forest:
    """A task's union-find over nodes: says which edges join two trees, and forgets all beyond NODES."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while self.up.setdefault(root, root) != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        if len(self.up) > NODES:
            self.up.clear()
        return np.fromiter(map(self.find, nodes.tolist()), np.int64, len(nodes))

    def join(self, i: int, js: np.ndarray, node: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
        """Joins the node at i with those at js; ``root`` follows. The edges that were needed."""
        edges, mine = [], int(root[i])
        other, first = np.unique(root[js], return_index=True)
        for r, k in zip(other.tolist(), first.tolist(), strict=True):
            if r != mine:
                edges.append((int(node[i]), int(node[js[k]])))
                self.up[r] = mine
        root[np.isin(root, other)] = mine
        return edges


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    ab = np.array(edges, np.int64).reshape(-1, 2)
    return C.out_batch({"a": pa.int64(), "b": pa.int64()}, a=ab[:, 0], b=ab[:, 1])


def column_families(entries: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all classes of different components which share a column and whose cells allow a link.

    entries: h, node, n, comp, cells, size (classes in the column), lo (its smallest component), parts (into which the columns of one lo are dealt)."""
    n_blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    dealt = entries.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    dealt = dealt.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other"), "part": F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")})
    keys = ["lo", "part", "bi", "bj"]
    dealt = dealt.select(*keys, "h", "own", "node", "n", "comp", "cells").repartition(*keys).sortWithinPartitions(*keys, "h")

    def multiply(batches):
        forest = Forest()
        for t, starts in C.runs(batches, [*keys, "h"], 20_000):
            node, comp, n, own, bi, bj = (t.column(c).to_numpy() for c in ("node", "comp", "n", "own", "bi", "bj"))
            raw, edges = t.column("cells").combine_chunks(), []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                c, m, g = comp[a:b], n[a:b], node[a:b]
                if (c == c[0]).all():
                    continue
                root, same = forest.roots(g), bi[a] == bj[a]
                side = np.zeros(b - a, np.int8) if same else (own[a:b] == bj[a]).astype(np.int8)
                cell = np.frombuffer(b"".join(raw.slice(a, b - a).to_pylist()), np.uint8).reshape(-1, CELLS)
                for i in np.flatnonzero(side == 0).tolist():  # a row of the block at a time
                    js = np.flatnonzero((root != root[i]) & (c != c[i]) & ((side == 1) if not same else True) & (100 * np.minimum(m, m[i]) >= percent * np.maximum(m, m[i])))
                    js = js[js > i] if same else js
                    if len(js):
                        js = js[bound_allows(cell[js], cell[i], m[js], m[i], percent)]
                        edges += forest.join(i, js, g, root)
            yield _edge_batch(edges)

    return C.map_arrow(dealt, multiply, "a long, b long")


def family_blocks(members: DataFrame, heavy: DataFrame, percent: int, room: int) -> DataFrame:
    """members (family, node, n, comp, weight), each with the blocks (low, i, high, j) it is compared in and its side there.

    A heavy family, of more weight than ``room``, is cut into bands of sizes, a band into blocks; only sets
    of one band or of two neighbouring ones can link."""
    if not heavy.limit(1).count():
        return members.select("family", "node", "n", "comp", *[F.lit(0).alias(c) for c in ("low", "i", "high", "j", "side")])
    bound = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    step = float(np.log(100 / percent * 1.001)) if percent < 100 else 1e-3
    band = F.when(F.col("big"), F.floor(F.log(F.col("n").cast("double")) / step)).otherwise(0).cast("int")
    cut = members.join(bound(heavy).withColumn("big", F.lit(True)), "family", "left").withColumn("band", band)
    bands = C.stored(cut.where("big").groupBy("family", "band").agg(F.ceil(F.sum("weight") / room).cast("int").alias("blocks")))
    for k, name in ((0, "mine"), (-1, "above"), (1, "below")):
        cut = cut.join(bound(bands.select("family", (F.col("band") + k).alias("band"), F.col("blocks").alias(name))), ["family", "band"], "left")
    n = F.coalesce("mine", F.lit(1))
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    up_to = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    place = lambda low, i, high, j, side: F.struct(low.alias("low"), i.cast("int").alias("i"), high.alias("high"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    here = F.transform(up_to(n), lambda k: place(F.col("band"), F.least(own, k), F.col("band"), F.greatest(own, k), F.when(own <= k, 0).otherwise(1)))
    above = F.transform(up_to(F.coalesce("above", F.lit(0))), lambda k: place(F.col("band"), own, F.col("band") + 1, k, F.lit(0)))
    below = F.transform(up_to(F.coalesce("below", F.lit(0))), lambda k: place(F.col("band") - 1, k, F.col("band"), own, F.lit(1)))
    return cut.withColumn("at", F.explode(F.concat(here, above, below))).select("family", "node", "n", "comp", "at.*")


def heavy_families(members: DataFrame, room: int) -> DataFrame:
    return C.stored(members.groupBy("family").agg(F.sum("weight").alias("total")).where(F.col("total") > room).select("family"))


def named_by(edges: DataFrame, name: str) -> DataFrame:
    """(node, ``name``) of every node that stands in an edge, its component's smallest node."""
    found = components(edges)
    return C.stored(found.select(F.col("v").alias("node"), F.col("m").alias(name)).union(found.select("m", "m").distinct()))


def in_blocks(blocks: DataFrame, sets: DataFrame, item: str, compare) -> DataFrame:
    """Edges that ``compare`` finds in each block: (node, n ascending, comp, side, items, forest) -> edges."""
    keys = ["family", "low", "i", "high", "j"]
    blocks = C.stored(blocks)
    dealt = sets.select("node", F.col(item).alias("items")).join(F.broadcast(blocks) if blocks.count() <= BROADCAST_ROWS else blocks, "node").select(*keys, "side", "node", "n", "comp", "items").repartition(*keys).sortWithinPartitions(*keys, "n")

    def run(batches):
        forest = Forest()
        for t, starts in C.runs(batches, keys, 200):
            node, n, comp, side = (t.column(c).to_numpy() for c in ("node", "n", "comp", "side"))
            raw, edges = t.column("items").combine_chunks(), []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                c, s = comp[a:b], side[a:b]
                if (c == c[0]).all() or (s == 1).all():
                    continue
                edges += compare(node[a:b], n[a:b], c, s, raw.slice(a, b - a).to_pylist(), forest)
            yield _edge_batch(edges)

    return C.map_arrow(dealt, run, "a long, b long")


def refined(members: DataFrame, heavy: DataFrame, sets: DataFrame, percent: int, sketch: int) -> DataFrame:
    """members, with the heavy families split by the bound of their finer cells; a class left alone goes."""
    heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_ROWS else heavy
    inside = C.stored(members.join(heavy, "family", "left_semi").withColumn("weight", F.greatest("n", F.lit(LEAST_WEIGHT))))
    blocks = family_blocks(inside, heavy_families(inside, sketch), percent, sketch)
    every = named_by(in_blocks(blocks, sets, "fine", lambda *block: block_candidates(*block, percent)), "sub")
    split = joined(inside, every, "node").withColumn("family", F.col("sub")).select(*members.columns)
    return C.stored(members.join(heavy, "family", "left_anti").unionByName(split))  # a sub-family's name is one of its nodes, no other family's


def family_links(edges: DataFrame, comp_of: DataFrame | None, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join components, among all classes that the edges connect: enough of them to connect what is linked."""
    every = named_by(edges, "family")
    few = F.broadcast(every) if every.count() <= BROADCAST_ROWS else every
    members = reps.select("node", "n", "k1", "k2").join(few, "node")
    members = C.stored(members.withColumn("comp", F.col("node")) if comp_of is None else joined(C.stored(members), comp_of, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    sets = C.stored(full_sets(texts, members.select("node", "k1", "k2"), width))
    members = members.select("family", "node", "n", "comp", F.col("n").alias("weight"))
    heavy = heavy_families(members, ROOM)
    if heavy.limit(1).count():
        members = refined(members, heavy, sets, percent, SKETCH)
        heavy = heavy_families(members, ROOM)
    return C.stored(in_blocks(family_blocks(members, heavy, percent, ROOM), sets, "items", lambda *block: block_links(*block, percent)))


def _ahead(node: np.ndarray, n: np.ndarray, side: np.ndarray, root: np.ndarray, percent: int):
    """For each row of a block: (i, first, to, mask of rows first .. to - 1 that it is to be compared with)."""
    cross = bool(side.max())
    last = np.searchsorted(percent * n, 100 * n, side="right").tolist()  # sets behind are too large
    for i in range(len(node) - 1):
        to = last[i]
        others = root[i + 1 : to] != root[i]
        if cross:
            others &= side[i + 1 : to] != side[i]
        if others.any():
            yield i, i + 1, to, others


def block_candidates(node: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, raw: list[bytes], forest: Forest, percent: int = PERCENT) -> list[tuple[int, int]]:
    """The edges of a block between classes of different components whose fine cells allow a link."""
    root, edges = forest.roots(node), []
    size = np.array([len(r) for r in raw])
    levels = {}
    for c in np.unique(size).tolist():
        rows = np.flatnonzero(size == c)
        own = np.frombuffer(b"".join([raw[k] for k in rows.tolist()]), np.uint8).reshape(-1, c)
        half = own[:, ::2] + own[:, 1::2]  # 240 at most, or 255 + 255 of cells that say nothing
        half[own[:, 0] == 255] = 255
        levels[c] = (int(rows[0]), own, half)
    for i, a, b, others in _ahead(node, n, side, root, percent):
        others &= comp[a:b] != comp[i]
        keep, c = np.zeros(b - a, bool), int(size[i])
        x = levels[c][1][i - levels[c][0]]
        for wide, k in ((c, 1), (2 * c, 2)):  # a set of up to 1.25 times the size has as many cells or twice as many
            js = np.flatnonzero(others & (size[a:b] == wide))
            if len(js):
                y = levels[wide][k][js + a - levels[wide][0]]
                keep[js] = bound_allows(y, x, n[js + a], n[i], percent)
        edges += forest.join(i, np.flatnonzero(keep) + a, node, root)
    return edges


def block_links(node: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, raw: list[bytes], forest: Forest, percent: int = PERCENT) -> list[tuple[int, int]]:
    """The links of a block that join trees of the forest; classes of one component are in one tree already."""
    _, first, inverse = np.unique(comp, return_index=True, return_inverse=True)
    for k in np.flatnonzero(first[inverse] != np.arange(len(node))).tolist():
        x, y = forest.find(int(node[k])), forest.find(int(node[first[inverse[k]]]))
        if x != y:
            forest.up[x] = y
    sets, root, edges = [unpacked(r) for r in raw], forest.roots(node), []
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    mark = np.zeros(int(item.max()) + 1, bool)
    for i, a, b, others in _ahead(node, n, side, root, percent):
        own = item[begin[i] : begin[a]]
        mark[own] = True
        shared = np.add.reduceat(mark[item[begin[a] : begin[b]]].astype(np.int64), begin[a:b] - begin[a])
        mark[own] = False
        js = np.flatnonzero(others & (100 * shared >= percent * (n[i] + n[a:b] - shared)))
        edges += forest.join(i, js + a, node, root)
    return edges


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner", most: int | None = None) -> DataFrame:
    """left with the one row that ``right`` has for a key; both are stored tables. Keys with more than
    1 / HOT of left's rows, HOT at most, don't meet in one task: their rows of ``right`` are broadcast.
    So is all of ``right`` up to ``most`` rows."""
    if right.count() <= (BROADCAST_ROWS if most is None else most):
        return left.join(F.broadcast(right), key, how)
    hot = C.stored(left.groupBy(key).count().where(F.col("count") > max(left.count() // HOT, 10_000)).select(key))
    if not hot.limit(1).count():
        return left.join(right, key, how)
    few = F.broadcast(hot)
    cold = left.join(few, key, "left_anti").join(right, key, how)
    return cold.unionByName(left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how))


# --- components ---------------------------------------------------------------


def contracted(edges: DataFrame) -> DataFrame:
    """Each task replaces its edges (a, b) by stars (v, m), m the smallest node it can reach."""

    def run(batches):
        forest = Forest()
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = forest.find(x), forest.find(y)
                if x != y:
                    forest.up[max(x, y)] = min(x, y)
        v = np.array(list(forest.up), np.int64)
        m = np.fromiter(map(forest.find, v.tolist()), np.int64, len(v))
        v, m = v[v != m], m[v != m]
        for k in range(0, len(v), 50_000):
            yield C.out_batch({"v": pa.int64(), "m": pa.int64()}, v=v[k : k + 50_000], m=m[k : k + 50_000])

    return C.map_arrow(edges, run, "v long, m long")


def components(edges: DataFrame) -> DataFrame:
    """(v, m) for every node that isn't the smallest of its component: m is.

    Edges are dealt out by both ends, so a node that half of them meet in is spread over all tasks;
    up to FEW_EDGES one task joins up."""
    edges = edges.select("a", "b")
    if C.stored(edges).count() <= FEW_EDGES:
        return C.stored(contracted(edges.coalesce(1)))
    e = C.stored(contracted(edges.repartition("a", "b")))
    while True:
        roots = e.select(F.col("m").alias("v")).distinct()
        chained = e.join(roots, "v", "left_semi").limit(1).count()
        forked = 0 if chained else e.groupBy("v").count().where("count > 1").limit(1).count()
        if not chained and not forked:
            return e
        both = C.stored(e.select(F.col("v").alias("u"), F.col("m").alias("w")).union(e.select("m", "v")))
        low = C.stored(both.groupBy("u").agg(F.min("w").alias("lw")).select("u", F.least("u", "lw").alias("m")))
        large = C.stored(joined(both.where("w > u"), low, "u").select(F.col("w").alias("v"), "m").distinct())
        least = C.stored(large.groupBy("v").agg(F.min("m").alias("lm")))
        small = joined(large, least, "v").select(F.when(F.col("m") == F.col("lm"), F.col("v")).otherwise(F.col("m")).alias("v"), F.col("lm").alias("m"), F.col("v").alias("old"))
        new = C.stored(contracted(small.select("v", "m").union(small.select(F.col("old"), "m")).distinct().repartition("v", "m")))
        C.dropped(e, both, low, large, least)
        e = new


# --- operator -----------------------------------------------------------------


def column_edges(shared: DataFrame, reps: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Edges that connect the classes whose links aren't known yet, from the columns that hold several components of ``found``."""
    comp_of = found.select(F.col("v").alias("node"), F.col("m").alias("comp"))
    with_comp = lambda df: joined(df, comp_of, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # a column of two classes that lie in two tasks has not been compared
    digest = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"s{k}") for k in (0, 1)]
    mixed = with_comp(shared).groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.count("prev").alias("joined"), *digest).where("lo < hi and (size > 2 or joined < size - 1)")
    mixed = C.stored(mixed.groupBy("size", "s0", "s1").agg(F.min(F.struct("h", "lo")).alias("c")).select("c.h", "c.lo", "size"))  # columns of the same classes have the same product
    parts = C.stored(mixed.groupBy("lo").agg(F.ceil(F.sum("size") / ENTRIES).cast("int").alias("parts")))
    left = C.stored(joined(mixed, parts, "lo"))
    rest = C.stored(with_comp(C.stored(joined(shared.select("h", "node", "n"), left, "h"))))
    return C.stored(column_families(rest.join(reps.select("node", "cells"), "node"), percent, BLOCK))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable); then what names the row's
    id and text (k1, k2) and its component (``component``; null without words)."""
    with C.tidied() as keep:
        texts = keyed(docs, id_col, text)
        first = C.stored(document_sets(texts, heavy_shingles(texts, width), width, percent))
        rows = C.stored(first.drop("prefix", "cells"))
        reps = first.where("class is not null").select("class", "n", "k1", "k2", "prefix", "cells").dropDuplicates(["class"])
        entries = C.stored(reps.withColumn("node", F.monotonically_increasing_id()))
        C.dropped(first)
        shared = C.stored(columns(entries))
        reps = C.stored(entries.drop("prefix"))
        C.dropped(entries)
        pair = [F.least("node", "prev").alias("a"), F.greatest("node", "prev").alias("b")]
        near = C.stored(shared.where(F.col("prev").isNotNull() & size_allows(F.col("n"), F.col("prev_n"), percent)).select(*pair).distinct())
        with C.tidied() as keep_found:
            found = keep_found(components(family_links(possible(near, reps, percent), None, reps, texts, width, percent)))
        with C.tidied() as keep_found:
            comp_of = found.select(F.col("v").alias("node"), F.col("m").alias("comp"))
            more = family_links(column_edges(shared, reps, found, percent), comp_of, reps, texts, width, percent)
            whole = keep_found(components(found.select(F.col("v").alias("a"), F.col("m").alias("b")).union(more)))
        C.dropped(shared, near, found)

        of_class = C.stored(joined(reps.select("class", "node"), whole.select(F.col("v").alias("node"), F.col("m").alias("component")), "node", "left").select("class", F.coalesce("component", "node").alias("component")))
        C.dropped(reps, whole)
        named = keep(C.stored(joined(rows, of_class, "class", "left", 0).select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2", "component")))
        lowest = keep(C.stored(named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))))
    out = joined(named, lowest, "component", "left", 0)
    return out.select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "k1", "k2", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without all but one row of each component (the one with the smallest
    id; of equal ids, any one text, once). Texts without words link with nothing and stay."""
    with C.tidied() as keep:
        comp = C.stored(jaccard_components(docs, id_col, text, width, percent).where("component is not null").select("component", "doc_id", "k1", "k2"))
        best = comp.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "k1", "k2")).alias("s"), F.count("*").alias("size")).where("size > 1")
        best = C.stored(best.select("component", F.col("s.k1").alias("b1"), F.col("s.k2").alias("b2")))
        rows = joined(comp, best, "component")
        chosen = (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2"))
        losers = keep(C.stored(rows.where(~chosen).select("k1", "k2").distinct()))
        again = keep(C.stored(rows.where(chosen).groupBy("k1", "k2").count().where("count > 1").select("k1", "k2")))
    bound = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    left = keyed(docs, id_col, text, tuple(docs.columns)).drop("doc_id", "text").join(bound(losers), ["k1", "k2"], "left_anti")
    if again.limit(1).count():  # a chosen row that the input repeats
        once = left.join(bound(again), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        left = left.join(bound(again), ["k1", "k2"], "left_anti").unionByName(once)
    return left.select(*[F.col(f"_c_{c}").alias(c) for c in docs.columns])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(C.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
