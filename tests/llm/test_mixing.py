"""Spelling variants, mixing and fill-in-middle against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest

from logtide.llm import spelling_variants as S

from . import brute
from .conftest import ordered, pairs


def spelled(rng, n=400):
    """Documents of words and their misspellings, some of them long, with ties."""
    letters = "abcdéèû"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 30, 31, 32, 33, 34, 60]))) for _ in range(24)]
    words = []
    for w in base:
        words += [w] * rng.choice([3, 30, 400])
        for _ in range(rng.randrange(6)):
            i, k = rng.randrange(len(w)), rng.randrange(3)
            words += [w[:i] + ("" if k == 0 else rng.choice(letters)) + w[i + (k < 2) :]] * rng.choice([1, 2, 3, 40])
    rng.shuffle(words)
    return [(k, " ".join(words[k::n]), "en", "web", 1) for k in range(n)]


@pytest.mark.parametrize("which", ["spelled", "hard", "real", "none"])
def test_spelling_groups(request, spark, which):
    if which == "spelled":
        df = spark.createDataFrame(spelled(random.Random(2), 40), "doc_id long, text string, lang string, source string, n_chars long")
    else:
        df = request.getfixturevalue(which)
    got = S.spelling_groups(df).collect()
    want = brute.spelling_groups(pairs(df))
    assert ordered(got) == ordered(want)
    if which == "spelled":
        assert sum(r.form is not None for r in got) > 10 and any(len(r.word) > S.LONG and r.n_near for r in got)


def test_spelling_classes(spark, monkeypatch):
    """A vocabulary that needs several filters gives the same."""
    df = spark.createDataFrame(spelled(random.Random(3), 40), "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(S, "MAX_BITS", S.REGION_BITS)
    monkeypatch.setattr(S, "BITS_A_WORD", 4_000)
    assert ordered(S.spelling_groups(df).collect()) == ordered(brute.spelling_groups(pairs(df)))


def test_neighbourhoods_are_whole_and_distinct():
    rng = random.Random(4)
    letters = "abcé"
    for n in (1, 2, 7):
        words = ["".join(rng.choice(letters) for _ in range(n)) for _ in range(20)]
        codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(20, n)
        got = S.neighbourhood(codes, np.frombuffer(letters.encode("latin-1"), np.uint8), lambda h: np.arange(len(h)))
        for r, w in enumerate(words):
            mine = [c for k, c in got if k == r]
            want = {w[:i] + w[i + 1 :] for i in range(n)} | {w[:i] + a + w[i + 1 :] for i in range(n) for a in letters} | {w[:i] + a + w[i:] for i in range(n + 1) for a in letters}
            assert Counter(mine) == Counter(want - {w})


def test_hashes_follow_the_edits():
    """The hash of a candidate is that of its letters: the filter loses none."""
    codes = np.frombuffer(b"abcdabcdefa", np.uint8)[None, :]
    seen = []
    S.neighbourhood(codes, np.frombuffer(b"abcdefg", np.uint8), lambda h: (seen.append(h), np.arange(len(h)))[1])
    texts = [c for _, c in S.neighbourhood(codes, np.frombuffer(b"abcdefg", np.uint8), lambda h: np.arange(len(h)))]
    for h, t in zip(np.concatenate(seen), texts, strict=True):
        c = np.frombuffer(t.encode("latin-1"), np.uint8)
        assert h == (S._LETTER[0][c] * S._POWER[: len(c)]).sum(dtype=np.uint64)


def test_very_long_words(spark):
    a = "ab" * 100_000
    rows = [(1, f"{a} {a}"), (2, f"{a}c {a}c {a[:-1]}"), (3, f"x{a[1:]} x{a[1:]} {a[:-1]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(len(r.word), r.word[0], r.n, r.n_near) for r in S.spelling_groups(df).collect()}
    words = brute.spelling_counts(rows)
    assert got == {(len(w), w[0], n, sum(brute.one_edit(w, v) for v in words)) for w, n in words.items()}


@pytest.mark.parametrize("which", ["hard", "odd", "real", "none"])
def test_fill_in_middle(request, spark, which):
    from pyspark.sql import functions as F

    from logtide.llm import fill_in_middle as M

    if which == "odd":
        rng = random.Random(6)
        texts = ["".join(rng.choice("aZé<>PSM .\n你𝒳") for _ in range(rng.randrange(12))) for _ in range(600)]
        texts += ["<P>", "a<S", "<M>x", "<", "P>", "aé" * 300_000, "word " * 200_000]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    else:
        df = request.getfixturevalue(which)
    got = M.fill_in_middle(df)
    assert ordered(got.collect()) == ordered(brute.filled(pairs(df)))
    back = got.select("doc_id", M.restored(F.col("output"), F.col("form")).alias("text"))
    assert ordered(pairs(back)) == ordered((i, t or "") for i, t in pairs(df))
    if which == "odd":
        assert got.where("form <> 'plain'").count() > 300 and got.where("form = 'spm'").count() > 50


def test_hypergeometric_draws(spark):
    """Frequencies of the inversion are the exact probabilities, on both sides of the mode."""
    from math import comb

    from pyspark.sql import functions as F

    from logtide.llm import mixing as M

    cases, size = [(20, 7, 10), (9, 9, 4), (50, 3, 25), (12, 0, 6), (30, 12, 1)], 4_000
    for total, marked, drawn in cases:
        n = lambda v: F.lit(v).cast("long")
        got = Counter(r[0] for r in spark.range(size).select(M.hypergeometric(n(total), n(marked), n(drawn), (F.col("id") + 0.5) / size)).collect())
        for x in range(max(0, drawn - total + marked), min(marked, drawn) + 1):
            assert abs(got[x] / size - comb(marked, x) * comb(total - marked, drawn - x) / comb(total, drawn)) < 2 / size
    large = spark.range(40).select(M.hypergeometric(n(10**9), n(4 * 10**8), n(5 * 10**8), (F.col("id") + 0.5) / 40).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(large[0] - 2e8) < 20 and 7_000 < large[1] < 8_500


def test_splitting_tree_keeps_every_quota(spark):
    from logtide.llm import mixing as M

    rng = random.Random(8)
    quota = {k: rng.choice([1, 5, 300, 4_000]) for k in range(600)}
    df = spark.createDataFrame(list(quota.items()), "number long, quota long")
    leaves = M.splitting_tree(df, 5).collect()
    shards, ranges = Counter(), {}
    for r in leaves:
        shards[r.shard] += r.end - r.begin
        ranges.setdefault(r.number, []).append((r.begin, r.end))
    for k, own in ranges.items():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == quota[k] and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert len(ranges) == 600 and len(shards) == 32
    assert max(shards.values()) - min(shards.values()) <= 15  # an odd block a level in each of three bands
    large = [sum(1 for r in leaves if r.number == k) for k in quota if quota[k] == 4_000]
    assert min(large) == 32 and len({r.end - r.begin for r in leaves if quota[r.number] == 4_000}) > 10


@pytest.mark.parametrize("which", ["hard", "real", "none", "few"])
def test_mixing(request, spark, which):
    from logtide.llm import mixing as M

    if which == "few":
        rows = [(k, "w " * (k % 90), "big" if k % 3 else None if k % 5 else f"s{k % 7}") for k in range(400)] + [(1, "a b", "tiny"), (1, "a b", "tiny"), (2, "", "void")]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    else:
        df = request.getfixturevalue(which)
    known, sources, mix = M.mixed(df, block_words=16, shard_words=500)
    got, pieces = M.taken(known, sources, mix).collect(), mix.collect()
    rows = [(r.doc_id, r.source, len(brute.blank_words(r.text))) for r in df.select("doc_id", "source", "text").collect()]
    assert ordered((r.doc_id, r.source, r["size"]) for r in got) == ordered(rows)
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    if not rows:
        return
    want, by = brute.mix_targets(sizes), Counter()
    for r in got:
        by[r.source] += r.taken
        assert (r.source_size, r.target) == (sizes[r.source], pytest.approx(want[r.source])) and r.taken <= 3 * r["size"]
    assert all(abs(by[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    # no words twice in a pass, every shard shuffled and without holes, all shards as large to a block a level
    words = Counter((p.doc, p.copy, p["pass"], w) for p in pieces for w in range(p.first, p.first + p.words))
    assert not words or max(words.values()) == 1
    shards = {}
    for p in pieces:
        shards.setdefault(p.shard, []).append(p.position)
    assert all(sorted(at) == list(range(len(at))) for at in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1 and len(shards) > 1
    assert ordered(map(str, M.mixed(df, block_words=16, shard_words=500)[2].collect())) == ordered(map(str, pieces))


def test_mixing_is_native(spark, sf):
    from logtide.llm import mixing as M

    known, sources, mix = M.mixed(spark.read.parquet(f"{sf}/documents.parquet"), shard_words=20_000)
    plan = M.taken(known, sources, mix)._jdf.queryExecution().toString() + mix._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
