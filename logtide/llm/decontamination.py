"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

A benchmark item is cut into windows of ``WINDOW`` consecutive words (a shorter item
is one window). A first pass counts how often each word of the benchmark occurs in
the documents; that gives every window its rarest words. A second pass writes the
index: postings (term, document, position) of those terms. The lists of a window's
two rarest terms, moved by their offsets in the window, are intersected: what is in
both is a place where the window may stand, and within ``SLOP`` positions of each
other a proximity match. The last pass reads the documents once more, counts their
words and compares the whole window at each candidate place.

What grows with the benchmark is broadcast only below ``BROADCAST_ROWS`` rows, which
are counted first; beyond that Spark joins by shuffling. What grows with the corpus is
never broadcast. Postings of a frequent term
are spread over documents and positions, so no key holds them all.

Defined results: a null or empty text has no words and no hits; a document is known
by its id and its text, so rows that repeat both get the same answer and rows that
share the id alone are judged apart; an item without words never matches, one with
a null id is listed as the empty string, items with equal texts are all listed;
empty tables give no rows or no hits; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, SLOP = 13, 2
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null: none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NO_WORD), "")


def bounded(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: terms, and the items that hold them."""
    words = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    at = words.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))))
    return at.select("item", F.slice("w", F.col("at"), window).alias("terms")).groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items"))


def keyed(docs: DataFrame, id_col: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The id as doc_id, the text, and two hashes of both that name the document; ``carry`` as _c_<name>."""
    both = [F.col(id_col).cast("long"), F.coalesce(F.col(text), F.lit(""))]
    return docs.select(both[0].alias("doc_id"), F.col(text).alias("text"), F.xxhash64(*both).alias("k1"), F.hash(*both).alias("k2"), *[F.col(c).alias(f"_c_{c}") for c in carry])


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """How often each of the terms occurs in all documents."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return tokens.join(bounded(terms, n_terms), "term").groupBy("term").agg(F.count("*").alias("n"))


def rarest_terms(windows: DataFrame, counts: DataFrame, n_terms: int) -> DataFrame:
    """windows with their rarest term and offset (t1, o1) and the next one (t2, o2; null for one word).

    A window with a term that no document holds is left out: its posting list is empty."""
    at = windows.select("window_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("o", "term"))
    known = at.join(bounded(counts, n_terms), "term").groupBy("window_id", "n_terms").agg(F.array_sort(F.collect_list(F.struct("n", "o", "term"))).alias("by"))
    known = known.where(F.size("by") == F.col("n_terms"))
    second = F.when(F.size("by") > 1, F.element_at("by", 2))
    first = F.element_at("by", 1)
    return known.select("window_id", first["term"].alias("t1"), first["o"].alias("o1"), second["term"].alias("t2"), second["o"].alias("o2"))


def postings(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The index: (term, document, position) of these terms; positions from 0."""
    tokens = docs.select("k1", "k2", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return tokens.join(bounded(terms, n_terms), "term").select("term", "k1", "k2", "pos")


def candidates(index: DataFrame, rare: DataFrame, n_windows: int, slop: int = SLOP) -> DataFrame:
    """(document, window_id, start, gap): both rarest terms stand there, ``gap`` positions off their distance in the window."""
    first = index.join(bounded(rare, n_windows), F.col("term") == F.col("t1")).select("k1", "k2", "window_id", (F.col("pos") - F.col("o1")).alias("start"), "t2", "o2")
    alone = first.where(F.col("t2").isNull()).select("k1", "k2", "window_id", "start", F.lit(0).alias("gap"))
    two = first.where(F.col("t2").isNotNull()).withColumn("gap", F.explode(F.sequence(F.lit(-slop), F.lit(slop))))
    moved = two.select("k1", "k2", "window_id", "start", "gap", F.col("t2").alias("term"), (F.col("start") + F.col("o2") + F.col("gap")).alias("pos"))
    return moved.join(index, ["k1", "k2", "pos", "term"]).select("k1", "k2", "window_id", "start", "gap").unionByName(alone)


def _covered(hits: Column) -> Column:
    """Words inside at least one of the sorted (start, end) pairs."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    fold = lambda acc, h: F.struct((acc["n"] + F.greatest(h["end"] - F.greatest(h["start"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], h["end"]).alias("to"))
    return F.aggregate(hits, zero, fold, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = SLOP, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated; then n_near_items
    (items with a window whose rarest terms stand within ``slop`` of their distance), items, spans, ``carry``."""
    with C.tidied() as keep:
        names = keyed(docs, id_col, text)
        windows = C.stored(benchmark_windows(benchmark, item_col, item_text, window).withColumn("window_id", F.monotonically_increasing_id()))  # written once
        n_windows = windows.count()
        terms = windows.select(F.explode("terms").alias("term")).distinct()
        n_terms = terms.count()
        counts = C.stored(term_counts(names, terms, n_terms))
        rare = C.stored(rarest_terms(windows, counts, n_terms))
        seeds = rare.select(F.col("t1").alias("term")).union(rare.where("t2 is not null").select("t2")).distinct()
        index = C.stored(postings(names, seeds, n_terms).distinct())  # rows that repeat id and text have one list
        found = candidates(index, rare, n_windows, slop).join(bounded(windows, n_windows), "window_id")
        exact = F.when((F.col("gap") == 0) & (F.col("start") >= 0), F.struct("start", "terms", "items"))
        by_doc = keep(C.stored(found.groupBy("k1", "k2").agg(F.collect_set(exact).alias("places"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("near"))))
    # candidate documents grow with the corpus: they are dealt out by their key with the documents, whatever their number
    joined = keyed(docs, id_col, text, carry).join(by_doc.hint("shuffle_hash"), ["k1", "k2"], "left")
    kept = [f"_c_{c}" for c in carry]
    counted = joined.select("doc_id", *kept, "near", "places", F.when(F.col("places").isNotNull() & (F.size("places") > 0), F.col("text")).alias("text"), F.size(words_of(F.col("text"))).alias("n_words"))
    tokens = counted.withColumn("w", F.when(F.col("text").isNotNull(), words_of(F.col("text"))))
    hit = F.filter("places", lambda p: F.slice(F.col("w"), p["start"] + 1, F.size(p["terms"])) == p["terms"])
    hits = tokens.withColumn("hits", F.when(F.col("w").isNotNull(), hit))
    spans = F.array_sort(F.array_distinct(F.transform("hits", lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.size(p["terms"])).alias("end")))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda p: p["items"]))))
    none_s, none_i = F.expr("cast(array() as array<struct<start:int,end:int>>)"), F.expr("cast(array() as array<string>)")
    out = hits.select("doc_id", *kept, F.col("n_words").cast("long").alias("n_words"), F.coalesce(spans, none_s).alias("spans"), F.coalesce(items, none_i).alias("items"), F.size(F.coalesce(F.col("near"), none_i)).cast("long").alias("n_near_items"))
    n_hit = _covered(F.col("spans")).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "n_near_items",
        "items",
        "spans",
        *[F.col(f"_c_{c}").alias(c) for c in carry],
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
