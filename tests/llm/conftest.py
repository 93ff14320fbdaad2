import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "river stone Window light garden paper seven cloud winter Market bridge silver morning letter forest copper".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def hard_rows():
    """Nulls in every column, empty, blank, very long and repeated texts, ties, near copies, other scripts."""
    rng = random.Random(5)
    base = sentence(rng, 60)
    near = [" ".join([*base.split()[:-k], *["x%d" % k] * k]) for k in range(1, 4)]
    texts = [None, "", "   \n\t ", "one", "Two words", "cc by", "…", "12 34", "½ ² ① Ⅷ", base, base, base.upper(), *near, "été ÉTÉ Straße naïve İstanbul 你好 世界 мир", "tab\tand\x0bothers\x0c\r\nline", "a " * 3000, sentence(rng, 4000)]
    texts += ["\n".join(["same line here again now"] * 5), "licensed under the Apache License, Version 2.0 all rights reserved", "licensed undr the apache licence version 2 0", "<|endoftext|> & <b> #*$%", "éclair ▁under  double", "x" * 5000]
    rows = [(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[10], rows[10], (8, "another text of the same id", "de", "web", 1), (None, base, None, None, None), (None, None, None, None, None), (-7, base, "fr", None, 3), (2**40, "far id " + base, "en", "books", 9)]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(hard_rows(), SCHEMA)
    clash = "node score _text k1 k2 words n before queue lang_pred _id _label grade".split()
    return df.withColumns({c: F.lit("clash") for c in clash}).repartition(3)


@pytest.fixture(scope="session")
def none(hard):
    return hard.limit(0)


@pytest.fixture(scope="session")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)
