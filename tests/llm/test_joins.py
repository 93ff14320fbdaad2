"""Decontamination, the Jaccard join and the pipeline against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from logtide.llm import decontamination, jaccard_join, registry
from tests.conftest import rows_of
from tests.llm import brute
from tests.llm.conftest import SCHEMA, ordered, pairs, sentence

CONTRACT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def bench_rows():
    rng = random.Random(9)
    long = [sentence(rng, 30) for _ in range(6)]
    return [*enumerate(long), (6, long[0]), (7, "Two, WORDS"), (8, "one"), (9, None), (10, ""), (11, "..."), (None, long[1]), (12, "the " * 20), (13, sentence(rng, 13))]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(bench_rows(), "item_id long, text string")


@pytest.fixture(scope="module")
def planted(spark, hard):
    rng, items = random.Random(1), [t for _, t in bench_rows() if t]
    rows = []
    for k in range(60):
        item = rng.choice(items).split()
        a = rng.randrange(len(item))
        passage = " ".join(item[a : a + rng.randrange(8, 30)])
        rows.append((100 + k, f"{sentence(rng, rng.randrange(200))} {passage.upper() if k % 3 else passage}, {sentence(rng, 5)} {passage if k % 4 == 0 else ''}", "en", "web", 0))
    rows.append((500, "the " * 500, "en", "web", 0))
    return hard.select(*spark.createDataFrame([], SCHEMA).columns).unionByName(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination(planted, bench, monkeypatch, most):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
    got = decontamination.contamination(planted, bench, carry=("text", "lang"))
    want = brute.decontaminated(pairs(planted), bench_rows())
    assert ordered(got.select(*CONTRACT).collect()) == ordered(want)
    assert sum(r[2] > 0 for r in want) > 20


def test_decontamination_of_real_and_of_nothing(spark, sf, real, none, bench):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = decontamination.contamination(real, items).select(*CONTRACT)
    assert ordered(got.collect()) == ordered(brute.decontaminated(pairs(real), [(r.item_id, r.text) for r in items.collect()]))
    assert not decontamination.contamination(none, bench).count()
    assert not decontamination.contamination(real, bench.limit(0)).where("n_hit > 0").count()


def test_decontamination_of_repeated_rows(spark, planted, bench):
    """Rows that repeat id and text share one list of postings: no more candidates, the same answers."""
    hit = decontamination.contamination(planted, bench).where("n_hit > 0").select("doc_id").distinct()
    some = planted.join(hit, "doc_id", "left_semi").select("doc_id", "text")
    many = some.crossJoin(spark.range(40).withColumnRenamed("id", "k")).drop("k")
    index = decontamination.postings(decontamination.keyed(many, "doc_id", "text"), some.limit(1).select(F.explode(decontamination.words_of(F.col("text"))).alias("term")).distinct(), 10).distinct()
    assert index.count() == decontamination.postings(decontamination.keyed(some.distinct(), "doc_id", "text"), index.select("term").distinct(), 10).count()
    once = {tuple(r) for r in decontamination.contamination(some, bench).select(*CONTRACT).collect()}
    got = decontamination.contamination(many, bench).select(*CONTRACT)
    assert {tuple(r) for r in got.collect()} == once and got.count() == 40 * some.count()


def test_decontamination_stays_native(spark, sf, real):
    plan = decontamination.contamination(real, spark.read.parquet(f"{sf}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "ExternalRDD"))


def copies(n_groups=12, seed=3):
    """Groups of near copies at similarities around the limit, chains of them, and exact copies."""
    rng, rows = random.Random(seed), []
    for g in range(n_groups):
        w = sentence(rng, rng.randrange(5, 120)).split()
        for _ in range(rng.randrange(2, 9)):
            rows.append(" ".join(w))
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        common = sentence(random.Random(g % 3), 40)
        rows += [f"{common} {sentence(rng, 60)}" for _ in range(4)]
    return rows


@pytest.fixture(scope="module")
def near(spark, hard):
    rows = [(1_000 + k, t, "en", "web", 0) for k, t in enumerate(copies())]
    return hard.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, SCHEMA)).repartition(4)


@pytest.mark.parametrize("most, block, room", [(200_000, 1_024, 400_000), (0, 3, 200)])
def test_jaccard_components(near, monkeypatch, most, block, room):
    """Also with blocks of three classes, families cut at 200 shingles and nothing broadcast."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", most)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "ROOM", room)
    monkeypatch.setattr(jaccard_join, "SKETCH", 4 * room)
    monkeypatch.setattr(jaccard_join, "FEW_EDGES", most // 2)
    got = jaccard_join.jaccard_components(near).select("doc_id", "n_shingles", "component_id").collect()
    want = brute.linked(pairs(near))
    assert ordered(got) == ordered(want)
    assert len({r[2] for r in want}) < len(want) - 20


def test_jaccard_of_columns_cut_between_tasks(spark):
    """Pairs that share one prefix shingle only, in more range partitions than a few."""
    rng, rows = random.Random(11), []
    for k in range(300):
        w = [f"w{rng.randrange(10**9)}" for _ in range(9)]
        rows += [(2 * k, " ".join(w[:8])), (2 * k + 1, " ".join(w))]
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert ordered(got) == ordered(brute.linked(rows))


def near_copies(n, words, changed, seed=7):
    """Texts of one base, each with its own words at ``changed`` places: mutually below the limit, or about it."""
    rng = random.Random(seed)
    base = sentence(rng, words).split()
    out = []
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(words), changed):
            w[at] = f"own{k}x{at}"
        out.append(" ".join(w))
    return out


def test_rows_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    """One column of some thousand classes that hardly link: its edges are a forest, not pairs, and nothing is lost."""
    seen = {}
    for name in ("column_families", "in_blocks"):
        real_one = getattr(jaccard_join, name)

        def counted(*args, name=name, real_one=real_one):
            out = jaccard_join.C.stored(real_one(*args))
            seen[name] = out.count()
            return out

        monkeypatch.setattr(jaccard_join, name, counted)
    texts = near_copies(1_200, 60, 2) + near_copies(30, 60, 1, seed=8)
    rows = list(enumerate(texts))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(brute.linked(rows))
    assert seen["column_families"] <= 16 * len(rows) and seen["in_blocks"] <= 4 * len(rows)


def test_a_column_of_5000_classes(spark):
    """The product of one column of 5,000 classes gives at most one edge for each of them and block pair."""
    from pyspark.sql import functions as F

    cell = bytes([5, *[0] * 255])
    entries = spark.range(5_000).select(F.lit(1).alias("h"), F.col("id").alias("node"), F.lit(5).cast("long").alias("n"), F.col("id").alias("comp"), F.lit(cell).alias("cells"), F.lit(5_000).cast("long").alias("size"), F.lit(0).cast("long").alias("lo"), F.lit(1).alias("parts"))
    edges = jaccard_join.column_families(entries)
    found = jaccard_join.components(edges)
    assert 4_999 <= edges.count() <= 5_000 * 10
    assert found.count() == 4_999 and [r.m for r in found.select("m").distinct().collect()] == [0]


def test_joined_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    left = jaccard_join.C.stored(spark.range(60_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 7 ELSE id END AS k"))
    right = jaccard_join.C.stored(spark.range(100).selectExpr("id AS k", "id * 2 AS v"))
    for how, size in (("inner", 30_000 + 50), ("left", 60_000)):
        got = jaccard_join.joined(left, right, "k", how)
        assert got.count() == size and got.where("v = 14").count() == 30_001


def test_jaccard_of_real_and_of_nothing(real, none):
    got = jaccard_join.jaccard_components(real).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(brute.linked(pairs(real)))
    assert not jaccard_join.jaccard_components(none).count()
    assert not jaccard_join.one_of_each(none).count()


def test_one_of_each_component_stays(near):
    kept, rows = pairs(jaccard_join.one_of_each(near)), pairs(near)
    groups, roots = {}, brute.roots(rows)
    for k, ((i, t), (_, n, _)) in enumerate(zip(rows, brute.linked(rows), strict=True)):
        groups.setdefault(roots[k] if n else ("blank", k), []).append((i, t))
    assert len(kept) == len(groups)
    assert all(k in rows for k in kept)
    lowest = {min(i for i, _ in g if i is not None) for g in groups.values() if any(i is not None for i, _ in g)}
    assert lowest <= {i for i, _ in kept}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, sf, name):
    got, want = registry.queries()[name](spark, sf).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    frames = [docs]
    for _, stage in P.STAGES[:-1]:
        frames.append(P.common.stored(stage(spark, frames[-1], sf)))
        assert frames[-1].columns == docs.columns
    texts = [pairs(f) for f in frames]
    told = P.language_id.predict(docs, P.language_id.learn_profiles(docs), carry=("text",)).where(f"lang_pred <> 'und' AND score >= {P.LEAST_LEAD}")
    assert sorted(texts[1]) == sorted(pairs(told)) and len(texts[1]) >= 0.99 * sum(any(c.isalpha() for c in t) for _, t in texts[0])
    assert set(texts[2]) <= set(texts[1]) and len(texts[2]) >= 0.8 * len(texts[1])
    groups = {c: min(i for i, _, d in brute.linked(texts[2]) if d == c) for _, _, c in brute.linked(texts[2])}
    assert sorted(i for i, _ in texts[3]) == sorted(groups.values())
    clean = {r[0] for r in brute.decontaminated(texts[3], items) if not r[5]}
    assert sorted(i for i, _ in texts[4]) == sorted(clean)
    packed = P.STAGES[-1][1](spark, frames[-1], sf)
    assert packed.select("doc_id").distinct().count() == len(texts[4])


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_hard_rows_and_none(spark, hard, none, sf, stage):
    import corpus_pipeline as P

    out = P.STAGES[stage][1](spark, hard, sf)
    assert stage == 4 or out.columns == hard.columns
    assert out.count() and not P.STAGES[stage][1](spark, none, sf).count()
