"""Sources mixed to target weights, by functions of DataFrames only.

A source's words make up blocks of at most ``block_words`` consecutive words of one
document. The blocks of a source have a random order, by their hashes; a source gives whole
passes over its blocks, then the first blocks of the order, and the last block is
cut, so that a source gives its target to the word. How many blocks of each source an output
shard gets is drawn before any block is moved: from the root, which holds each source's
exact quota, a tree splits the quotas in halves by multivariate hypergeometric draws, until a
leaf is a shard. A leaf's blocks of a source are the next ones of its order, so shards are
disjoint, and each is shuffled by itself.

The order's ranks are counted in two steps (buckets of hashes, then inside each bucket),
so that no task sorts a whole source. A source's weight follows from its rank in code-point
order, so a row for each source goes through one task; nothing larger does. The tree
takes sources in bands of BAND, each halved evenly, so that a row holds a bounded array.

Nulls: a null text has no words; a null source is a source, the last one; a null id is an
id. Rows equal in id, source and text are told apart by a number, so repeated rows keep their
own blocks. A document without words has none taken; a corpus without words has targets of 0.
Further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Words of a block, words of an output shard (about 100 MB of text).
BLOCK_WORDS, SHARD_WORDS = 512, 1 << 24
#: A document is taken so often at most.
PASSES = 3
WEIGHTS = (1, 2, 3)
#: Buckets of a source's order at most, and blocks for each.
BUCKETS, BUCKET_BLOCKS = 1 << 16, 1_024
#: Sources that are drawn together.
BAND = 256
SEED = 12
_DOC = ["doc_id", "source", "size", "digest"]


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, digest, copies: the texts themselves are read once, here."""
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    return rows.groupBy(*_DOC).agg(F.count("*").alias("copies"))


def targets(known: DataFrame, weights: Sequence[float] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """source, number, source_size, target: the sources share the corpus's size by weight, none
    beyond ``passes`` times its own.

    Sources reach their limit in order of limit / weight; those behind the first that
    doesn't share what the others leave."""
    own = known.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    ranked = own.withColumn("number", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")))
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = ranked.withColumns({"left": F.sum("source_size").over(whole) - passes * F.coalesce(F.sum("source_size").over(before), F.lit(0)), "shares": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    fits = passes * F.col("source_size") / F.col("weight") >= F.col("left") / F.col("shares")
    first = F.min(F.when(fits, F.struct((F.col("source_size") / F.col("weight")).alias("at"), F.col("number").alias("number"), F.col("left").alias("left"), F.col("shares").alias("shares")))).over(whole)
    found = left.withColumn("first", first)
    share = F.col("weight") * (F.col("first.left") / F.col("first.shares"))
    return found.select("source", F.col("number").cast("long").alias("number"), "source_size", F.least(share, (passes * F.col("source_size")).cast("double")).alias("target"))


def _known_source(left: DataFrame, sources: DataFrame, columns: Sequence[str]) -> DataFrame:
    named = sources.select(F.col("source").alias("_source"), *columns)
    return left.join(named, left["source"].eqNullSafe(named["_source"])).drop("_source")


def ordered_blocks(known: DataFrame, sources: DataFrame, block_words: int, seed: int) -> DataFrame:
    """doc, copy, block, first, words, number, source_size, goal, key, rank, before: each block's place in its source's order, from 0, and the words in front of it."""
    docs = _known_source(known.where("size > 0"), sources, ["number", "source_size", F.round("target").cast("long").alias("goal")])
    doc = F.struct(*_DOC).alias("doc")
    copies = docs.select(doc, "number", "source_size", "goal", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    cut = copies.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("doc.size") - 1) / block_words))).alias("block"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), text("doc.doc_id"), text("doc.digest"), text("copy"), text("block")))
    blocks = cut.select("doc", "copy", "block", (F.col("block") * block_words).alias("first"), F.least(F.lit(block_words), F.col("doc.size") - F.col("block") * block_words).cast("long").alias("words"), "number", "source_size", "goal", key.alias("key"))
    # a bucket is a range of keys; a source has about one for each BUCKET_BLOCKS blocks
    many = F.least(F.lit(BUCKETS), F.floor(F.col("source_size") / (block_words * BUCKET_BLOCKS)) + 1)
    unit = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(1 << 48)
    blocks = C.stored(blocks.withColumn("bucket", F.floor(unit * many).cast("long")))
    sums = blocks.groupBy("number", "bucket").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    earlier = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    starts = sums.select("number", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_rank"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("number", "bucket").orderBy("key", "doc", "copy", "block")
    placed = blocks.withColumns({"_at": F.row_number().over(inside) - 1, "_w": F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")})
    out = placed.join(starts, ["number", "bucket"])
    return out.select("doc", "copy", "block", "first", "words", "number", "source_size", "goal", "key", (F.col("_rank") + F.col("_at")).alias("rank"), (F.col("_before") + F.col("_w")).alias("before"))


# --- the splitting tree -----------------------------------------------------------


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """A value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among the ``marked`` ones, by inversion of ``u`` in [0, 1).

    The probabilities follow from one another; they are summed upwards from the mode, then
    downwards from it, as far as twelve deviations."""
    n, k, d = total.cast("double"), marked.cast("double"), drawn.cast("double")
    deviation = F.sqrt(F.greatest(d * (k / F.greatest(n, F.lit(1.0))) * ((n - k) / F.greatest(n, F.lit(1.0))) * ((n - d) / F.greatest(n - 1, F.lit(1.0))), F.lit(0.0)))
    reach = (F.ceil(deviation * 12) + 12).cast("long")
    mode = F.floor((d + 1) * ((k + 1) / (n + 2))).cast("long")
    lowest, highest = F.greatest(F.lit(0).cast("long"), drawn - (total - marked)), F.least(drawn, marked)
    plan = F.struct(F.least(F.greatest(mode, lowest), highest).alias("mode"), lowest.alias("lowest"), highest.alias("highest"), reach.alias("reach"))

    def found(p: Column) -> Column:
        up = F.sequence(F.lit(0).cast("long"), F.least(p["reach"], p["highest"] - p["mode"]))
        down = F.sequence(F.lit(0).cast("long"), F.least(p["reach"], p["mode"] - p["lowest"]))
        rise = lambda x: (marked - x).cast("double") * (drawn - x) / ((x + 1).cast("double") * (total - marked - drawn + x + 1))  # noqa: E731  P(x + 1) / P(x)
        fall = lambda x: x.cast("double") * (total - marked - drawn + x) / ((marked - x + 1).cast("double") * (drawn - x + 1))  # noqa: E731  P(x - 1) / P(x)

        def summed(steps: Column, ratio, sign: int) -> Column:
            return F.aggregate(steps, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum")), lambda s, i: F.struct((s["p"] * ratio(p["mode"] + sign * i)).alias("p"), (s["sum"] + s["p"]).alias("sum")))["sum"]

        def reached(steps: Column, ratio, sign: int, goal: Column) -> Column:
            """The first value at which the sum is above the goal."""
            start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), p["mode"].alias("at"))
            return F.aggregate(steps, start, lambda s, i: F.struct((s["p"] * ratio(p["mode"] + sign * i)).alias("p"), (s["sum"] + s["p"]).alias("sum"), F.when(s["sum"] <= goal, p["mode"] + sign * i).otherwise(s["at"]).alias("at")))["at"]

        def chosen(sums: Column) -> Column:
            goal = u * (sums["up"] + sums["down"] - 1)  # the mode is in both
            return F.when(goal < sums["up"], reached(up, rise, 1, goal)).otherwise(reached(down, fall, -1, goal - sums["up"] + 1))

        return _let(F.struct(summed(up, rise, 1).alias("up"), summed(down, fall, -1).alias("down")), chosen)

    return _let(plan, found)


def _half(quotas: Column, seeds: Callable[[Column], Column], odd: Column) -> Column:
    """The left child's quotas: half of all blocks, each source's number drawn given those before it."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q)

    def drawn(n: Column) -> Column:
        start = F.struct(n.alias("rest"), F.floor((n + odd) / 2).cast("long").alias("room"), F.array().cast("array<bigint>").alias("left"))

        def step(s: Column, q: Column) -> Column:
            x = hypergeometric(s["rest"], q, s["room"], seeds(F.size(s["left"])))
            return _let(x, lambda v: F.struct((s["rest"] - q).alias("rest"), (s["room"] - v).alias("room"), F.concat(s["left"], F.array(v)).alias("left")))

        return F.aggregate(quotas, start, step)["left"]

    return _let(total, drawn)


def splitting_tree(quotas: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """shard, number, begin, end of quotas (number, quota): which ranks of each source's order each of 2 ** levels shards gets; those without any are left out."""
    band = F.floor(F.col("number") / BAND).cast("long")
    nodes = quotas.groupBy(band.alias("band")).agg(F.sort_array(F.collect_list(F.struct("number", F.col("quota").cast("long").alias("quota")))).alias("of"))
    nodes = nodes.select("band", F.lit(0).cast("long").alias("node"), F.col("of.number").alias("numbers"), F.col("of.quota").alias("quotas"))
    for level in range(levels):
        u = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), F.col("band"), i), 11).cast("double") / float(1 << 53)  # noqa: B023, E731
        halved = nodes.withColumn("left", _half(F.col("quotas"), u, (F.col("node") + F.col("band")) % 2))
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        children = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))
        nodes = halved.select("band", "numbers", F.explode(children).alias("child")).select("band", "child.node", "numbers", "child.quotas")
        if level % 4 == 3:
            nodes = C.stored(nodes.repartition("band", "node"))
    leaves = nodes.select(F.col("node").alias("shard"), F.explode(F.arrays_zip("numbers", "quotas")).alias("x")).select("shard", F.col("x.numbers").alias("number"), F.col("x.quotas").alias("quota")).where("quota > 0")
    upto = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return leaves.withColumn("end", F.sum("quota").over(upto)).select("shard", "number", (F.col("end") - F.col("quota")).alias("begin"), "end")


# --- the mixture --------------------------------------------------------------------


def mixture(known: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """doc (doc_id, source, size, digest), copy, pass, first, words, shard, position: the words [first, first + words)
    of a document stand at ``position`` of an output shard."""
    ranked = C.stored(ordered_blocks(known, sources, block_words, seed))
    # a pass begins where the last one has ended; a block is taken while its source's goal isn't reached
    begin = lambda p: p * F.col("source_size") + F.col("before")
    taken = F.transform(F.filter(F.sequence(F.lit(0), F.lit(passes - 1)), lambda p: begin(p) < F.col("goal")), lambda p: F.struct(p.alias("pass"), F.least(F.col("words"), F.col("goal") - begin(p)).alias("words")))
    counted = ranked.groupBy("number").agg(F.count("*").alias("blocks"), F.sum(F.size(taken)).alias("quota"), F.first("goal").alias("goal"))
    counted = C.stored(counted)
    whole = counted.agg(F.sum("goal")).first()[0] or 0
    levels = max(0, (-(-whole // shard_words) - 1).bit_length())
    quotas = counted.where("quota > 0")
    leaves = splitting_tree(quotas.select("number", "quota"), levels, seed).join(quotas.select("number", "quota", "blocks"), "number")
    # ranges of ranks meet in stretches of a source's mean number of blocks in a shard
    stretch = lambda rank: F.floor(rank / F.greatest(F.floor(F.col("quota") / (1 << levels)), F.lit(1))).cast("long")
    spread = leaves.select("shard", "number", "begin", "end", F.explode(F.sequence(stretch(F.col("begin")), stretch(F.col("end") - 1))).alias("stretch"))
    items = ranked.join(counted.select("number", "blocks", "quota"), "number").select("doc", "copy", "block", "first", "number", "rank", "blocks", "quota", "key", F.explode(taken).alias("t"))
    items = items.select("doc", "copy", F.col("t.pass").alias("pass"), "first", F.col("t.words").alias("words"), "number", (F.col("t.pass") * F.col("blocks") + F.col("rank")).alias("rank"), "quota", "key")
    dealt = items.withColumn("stretch", stretch(F.col("rank"))).join(spread, ["number", "stretch"]).where("rank >= begin AND rank < end")
    shuffled = Window.partitionBy("shard").orderBy(F.md5(F.concat_ws(":", "key", F.col("pass").cast("string"), F.lit(str(seed)))), "doc", "copy", "pass", "first")
    return dealt.select("doc", "copy", "pass", "first", "words", "shard", (F.row_number().over(shuffled) - 1).alias("position"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, passes: int = PASSES, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents(), targets() and mixture() of a corpus."""
    known = C.stored(documents(docs))
    sources = C.stored(targets(known, weights, passes))
    return known, sources, mixture(known, sources, block_words, shard_words, passes, seed)


def taken(known: DataFrame, sources: DataFrame, mix: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document, copies apart."""
    doc = F.struct(*_DOC).alias("doc")
    all_docs = known.select(doc, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).cast("long").alias("words"))
    sums = mix.select("doc", "copy", "words").unionByName(all_docs).groupBy("doc", "copy").agg(F.sum("words").alias("taken"))
    out = sums.select("doc.doc_id", "doc.source", "doc.size", "taken")
    return _known_source(out, sources, ["source_size", "target"]).select("doc_id", "source", "size", "source_size", "target", "taken")


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with C.tidied() as keep:
        return keep(C.stored(taken(*mixed(C.table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")))
