"""Fill-in-the-middle training texts, cut at units.

A unit is a run of ASCII letters or one other code point. One Aho-Corasick automaton
reads each text as classes of its characters (letter, other, and those of the
sentinels apart) and reports only events: the places where letters begin or end, and
sentinels that stand in the text. Between two events lie one unit of letters or as many units as
code points, so the number of units in front of any event is a sum, and a rank is looked up
among the events: no list of units is made.

The cuts, the order of the parts and which texts stay plain follow from the hash of the
seed and the id. A text that holds a sentinel stays plain, so sentinels in an output are always its own.

Nulls: a null text is empty, and empty texts are plain; a null id is hashed as nothing
behind the colon. Rows that repeat give equal rows. Further columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: What stands in front of the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts of a hundred that are changed, and of these the ones whose suffix comes first.
CHANGED, SUFFIX_FIRST = 90, 20
SEED = 1

_LETTERS, _OTHERS = "aPSM", ".<>"
_CLASSES = bytes(ord(c) if c in "PSM<>" else ord("a") if c.isascii() and c.isalpha() else ord(".") for c in map(chr, range(256)))


def _automaton() -> ahocorasick.Automaton:
    """Pairs of characters at which letters begin (1) or end (2), and sentinels (0)."""
    out = ahocorasick.Automaton()
    for a in _LETTERS:
        for b in _OTHERS:
            out.add_word(b + a, 1)
            out.add_word(a + b, 2)
    for s in (PREFIX, SUFFIX, MIDDLE):
        out.add_word(s, 0)
    out.make_automaton()
    return out


class Units:
    """The units of a text, known by the places where the class of characters changes.

    ``begin``: where a stretch of one class begins, ``before``: units in front of it; ``n``: units;
    ``marked``: whether a sentinel stands in the text."""

    def __init__(self, text: str, automaton: ahocorasick.Automaton):
        self.size = len(text)
        seen = text.encode("ascii", "replace").translate(_CLASSES).decode("ascii")  # a byte for each code point
        events = np.fromiter((2 * at + kind if kind else -1 for at, kind in automaton.iter(seen)), np.int64)
        self.marked = bool((events < 0).any())
        events = events[events >= 0]
        self.begin = np.concatenate([[0], (events - 1) >> 1])
        self.letters = np.concatenate([[seen[:1] in _LETTERS and self.size > 0], events & 1 == 1])
        length = np.diff(np.append(self.begin, self.size))
        self.before = np.concatenate([[0], np.cumsum(np.where(self.letters, 1, length))])
        self.n = int(self.before[-1])

    def place(self, rank: int) -> int:
        """The code point at which unit ``rank`` begins; the text's end for rank n."""
        if rank >= self.n:
            return self.size
        k = int(np.searchsorted(self.before, rank, side="right")) - 1
        return int(self.begin[k]) + (0 if self.letters[k] else rank - int(self.before[k]))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form ('plain', 'psm', 'spm'), prefix_chars, middle_chars, output."""
    schema = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    numbers = ("_h1", "_h2", "_h3", "_h4")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[h.alias(c) for h, c in zip(draws(F.col("doc_id"), seed), numbers, strict=True)])

    def task(batches):
        automaton = _automaton()
        for batch, texts in C.blocks(batches):
            got = []
            for raw, *h in zip(texts, *[C.column(batch, c).to_pylist() for c in numbers], strict=True):
                text = raw.decode()
                units = Units(text, automaton)
                if not text or units.marked or h[2] % 100 >= changed:
                    got.append((units.n, "plain", None, None, text))
                    continue
                a, b = (units.place(r) for r in sorted((h[0] % (units.n + 1), h[1] % (units.n + 1))))
                first, middle, last = text[:a], text[a:b], text[b:]
                if h[3] % 100 < suffix_first:
                    got.append((units.n, "spm", a, b - a, f"{SUFFIX}{last}{PREFIX}{first}{MIDDLE}{middle}"))
                else:
                    got.append((units.n, "psm", a, b - a, f"{PREFIX}{first}{SUFFIX}{last}{MIDDLE}{middle}"))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            cols = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), *cols], names=list(schema))

    return C.map_arrow(rows, task, ", ".join(f"{c} {t}" for c, t in schema.items()))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its parts between the sentinels, which no changed text holds itself."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(C.table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
