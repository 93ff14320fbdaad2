"""Quality classifier, toxicity and language ID: held-out accuracy, defined results, small plain versions."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from logtide.llm import language_id, quality_classifier, toxicity
from tests.llm import brute
from tests.llm.conftest import ordered, pairs

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


def auc(score, y):
    order = np.argsort(np.argsort(score))
    pos = order[y == 1]
    return (pos.sum() - len(pos) * (len(pos) - 1) / 2) / (len(pos) * (y == 0).sum())


def test_ordinal_thresholds_are_ordered_and_grades_found():
    rng = np.random.default_rng(4)
    n, doc = 900, np.repeat(np.arange(900), 5)
    slot = rng.integers(0, 40, len(doc))
    z = np.bincount(doc, (slot / 20 - 1) / 5, n)
    grade = np.searchsorted(np.quantile(z, [0.3, 0.7]), z)
    m = quality_classifier.fit_ordinal(doc, slot, np.full(len(doc), 0.2), grade, 3)
    assert (np.diff(m.thresholds) > 0).all()
    tails = m.tails(np.bincount(doc, m.weight[slot] * 0.2, n))
    assert (np.diff(tails, axis=1) <= 0).all()
    assert ((tails >= 0.5).sum(axis=1) == grade).mean() > 0.85


def test_quality_classifier_on_unseen_ratings(larger):
    docs, labels = larger
    rated = labels.selectExpr("doc_id", "quality AS rating")
    model = quality_classifier.fit_quality(docs, rated.where("crc32(cast(doc_id AS string)) % 3 <> 1"))
    got = quality_classifier.grade_texts(docs, model).join(rated.where("crc32(cast(doc_id AS string)) % 3 = 1"), "doc_id").toPandas()
    assert auc(got["expected_grade"].to_numpy(), got["rating"].to_numpy()) > 0.8


@pytest.mark.parametrize("which", ["hard", "none"])
def test_quality_classifier_defined_results(request, spark, labels, which):
    docs = request.getfixturevalue(which)
    for ratings in (labels.selectExpr("doc_id", "quality AS rating"), labels.selectExpr("doc_id", "cast(null AS int) AS rating")):
        got = quality_classifier.grade_texts(docs, quality_classifier.fit_quality(docs, ratings)).collect()
        assert ordered((r.doc_id,) for r in got) == ordered((i,) for i, _ in pairs(docs))
        assert all(0 <= r.tail <= 1 for r in got)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(7)
    n, step, start = np.array([3, 0, 5, 1]), rng.normal(size=(2, 2)), rng.normal(size=2)
    e = rng.normal(size=9)
    fwd, bwd = toxicity.messages(e, n, step, start)
    p, at = toxicity.marginals(fwd, bwd), 0
    for m in n:
        own = e[at : at + m]
        weights = {y: np.exp(start[y[0]] + sum(own[k] * y[k] for k in range(m)) + sum(step[y[k - 1], y[k]] for k in range(1, m))) for y in itertools.product((0, 1), repeat=int(m)) if m}
        for k in range(m):
            assert p[at + k] == pytest.approx(sum(w for y, w in weights.items() if y[k]) / sum(weights.values()))
        at += m


@pytest.mark.parametrize("piece", [1 << 18, 1_000])
def test_messages_of_long_sequences(monkeypatch, piece):
    """Against one step a token, for sequences far longer than a block, and for pieces that cut them."""
    monkeypatch.setattr(toxicity, "PIECE", piece)
    rng = np.random.default_rng(5)
    n = np.array([0, 1, 20_011, 0, 3, 64, 4_096, 700, 0])
    step, start, e = rng.normal(size=(2, 2)), rng.normal(size=2), 12 * rng.normal(size=int(n.sum()))
    fwd, bwd = toxicity.messages(e, n, step, start)
    t, at = np.exp(step), 0
    for m in n.tolist():
        x, f, b = np.exp(np.clip(e[at : at + m], -40, 40)), np.empty(m), np.ones(m)
        for k in range(m):
            f[k] = x[k] * ((t[0, 1] + f[k - 1] * t[1, 1]) / (t[0, 0] + f[k - 1] * t[1, 0]) if k else np.exp(start[1] - start[0]))
        for k in range(m - 2, -1, -1):
            b[k] = (t[1, 0] + x[k + 1] * b[k + 1] * t[1, 1]) / (t[0, 0] + x[k + 1] * b[k + 1] * t[0, 1])
        np.testing.assert_allclose(fwd[at : at + m], f, rtol=1e-8)
        np.testing.assert_allclose(bwd[at : at + m], b, rtol=1e-8)
        at += m


def test_messages_of_ten_million_tokens():
    n = np.array([10_000_000])
    p = toxicity.marginals(*toxicity.messages(np.tile([-4.0, 3.0, -4.0, -4.0], n[0] // 4), n, np.array([[0.0, -2.0], [0.0, 1.0]]), np.array([0.0, -3.0])))
    assert np.isfinite(p).all() and p[1_000_001] == pytest.approx(p[9_000_001]) and p[1_000_001] > p[1_000_002]


def test_learning_sample_is_bounded_by_rows_and_bytes_not_by_length(spark):
    """Long texts teach; repeated rows count once; a kind ends with the document that reaches the bytes."""
    ids = [i for i in range(400) if brute.fold(i, 3) != 1]
    long_text = "word " * 60_000
    docs = spark.createDataFrame([(i, long_text if i == ids[0] else f"text {i}") for i in ids] * 2 + [(ids[1], "another text of the id"), (ids[2], None)], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, int(k % 2 == 0)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    everything = toxicity.learning_sample(docs, labels, "doc_id", "text")
    assert len(everything) == len(ids) + 1 and max(len(w) for w, _ in everything) == 60_000
    few = toxicity.learning_sample(docs, labels, "doc_id", "text", toxic=10, clean=20)
    assert sorted(label for _, label in few) == [0] * 20 + [1] * 10
    small = toxicity.learning_sample(docs, labels, "doc_id", "text", most=90)
    for kind in (0, 1):
        sizes = [len(" ".join(w.decode() for w in words)) for words, label in small if label == kind]
        assert sum(sizes) >= 90 and sum(sizes) - max(sizes) < 90
    many = spark.range(500).selectExpr(f"{ids[3]}L AS doc_id", "concat('own ', id) AS text")
    assert len(toxicity.learning_sample(many, labels, "doc_id", "text", toxic=10, clean=20)) in (10, 20)


def test_field_knows_more_than_its_word_list(larger):
    """On held-out labels the field ranks better than the number of listed words, and marks fewer clean texts."""
    docs, labels = larger
    sample = toxicity.learning_sample(docs, labels, "doc_id", "text")
    listed = toxicity.toxic_vocabulary(toxicity.distinct_texts(sample))
    got = toxicity.tag(docs, toxicity.train(sample), carry=("text",)).join(labels, "doc_id").where("held_out").toPandas()
    counts = np.array([sum(toxicity.token_labels([toxicity.core(w) for w in (t or "").encode().split()], 1, listed)) for t in got["text"]])
    y, s = got["toxic"].to_numpy(), got["score"].to_numpy()
    assert auc(s, y) > auc(counts, y) + 0.01
    hit = s >= toxicity.CUT
    assert (hit & (y == 0)).sum() < ((counts >= 1) & (y == 0)).sum()


def test_toxicity_on_held_out_labels(larger):
    docs, labels = larger
    got = toxicity.tag(docs, toxicity.fit_field(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    y, s = got["toxic"].to_numpy(), got["score"].to_numpy()
    assert auc(s, y) > 0.95
    hit = got["predicted"].to_numpy() == 1
    assert (hit & (y == 1)).sum() >= 0.9 * (y == 1).sum()
    assert (hit & (y == 0)).sum() <= 0.02 * (y == 0).sum()


@pytest.mark.parametrize("which", ["hard", "none"])
def test_toxicity_defined_results(request, labels, real, which):
    docs = request.getfixturevalue(which)
    for field in (toxicity.fit_field(real, labels), toxicity.fit_field(docs, labels.limit(0))):
        got = toxicity.tag(docs, field, carry=tuple(docs.columns)).collect()
        ids = [(i, brute.fold(i, 3) == 1) for i, _ in pairs(docs)]
        assert ordered((r[0], r[1]) for r in got) == ordered(ids)
        assert all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.7) for r in got)


def test_spans_are_places_in_the_text():
    text = "été bad word fine Bad".encode()
    got = toxicity.spans(text, np.array([0.1, 0.9, 0.8, 0.2, 0.7]))
    assert [text.decode()[s["begin"] : s["end"]] for s in got] == ["bad word", "Bad"]


def test_language_on_held_out_documents(larger):
    docs, _ = larger
    got = language_id.predict(docs, language_id.learn_profiles(docs), carry=("lang",)).where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_rank_order_distance_against_a_plain_version():
    profiles = {"a": [5, 9, 1], "b": [1, 2]}
    order = [9, 1, 7]
    plain = {n: sum(abs(p.index(s) - k) if s in p else 3 for k, s in enumerate(order)) for n, p in profiles.items()}
    best, second = sorted(plain.values())
    got = language_id.Ranks(profiles, 3).nearest(np.array([1, 7, 9]), np.array([2, 1, 3]))
    assert got == (min(plain, key=plain.get), (second - best) / second)


@pytest.mark.parametrize("table", [1 << 22, 1])
def test_ngrams_against_a_plain_version(monkeypatch, table):
    monkeypatch.setattr(language_id, "TABLE", table)
    rng = random.Random(1)
    parts = ["a", "B", "ö", "½", "²", "①", "Ⅷ", "中", "\u0301", " ", "_", "3", "naïve", "İ", "Σας", "🙂", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(400)] + ["", None, "½ ² ①"]
    for t, (code, n) in zip(texts, language_id.text_counts([None if t is None else t.encode() for t in texts]), strict=True):
        want = brute.ngrams(t)
        assert dict(zip(code.tolist(), n.tolist(), strict=True)) == want
        assert language_id.ranked(code, n, 5).tolist() == brute.rank_order(want, 5)


def test_a_long_text_is_counted_in_pieces(monkeypatch):
    text = ("wörter und andere words " * 400).encode()
    whole = language_id.text_counts([text])[0]
    monkeypatch.setattr(language_id, "LONG", 1_000)
    assert len(language_id.pieces(text)) > 5 and b"".join(language_id.pieces(text)) == text
    assert all((a == b).all() for a, b in zip(language_id.text_counts([text, b"x"])[0], whole, strict=True))


def test_profiles_and_predictions_against_a_plain_version(spark, real):
    docs = real.limit(120).cache()
    rows = docs.select("doc_id", "text", "lang").collect()
    total = {}
    for r in rows:
        if r.lang is not None and r.text is not None and brute.fold(r.doc_id, 5) != 0:
            total.setdefault(r.lang, Counter()).update(brute.ngrams(r.text))
    profiles = {name: brute.rank_order(c, 300) for name, c in total.items()}
    assert language_id.learn_profiles(docs) == profiles
    got = {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(docs, profiles).collect()}
    for r in rows:
        mine = brute.rank_order(brute.ngrams(r.text), 300)
        far = sorted((sum(abs(p.index(g) - k) if g in p else 300 for k, g in enumerate(mine)), name) for name, p in profiles.items())
        assert (r.doc_id, far[0][1], (far[1][0] - far[0][0]) / far[1][0]) in got if mine else (r.doc_id, "und", 0.0) in got


def test_every_language_has_a_profile(spark):
    rng = np.random.default_rng(4)
    rows = [(5 * k + d, " ".join(chr(0x4E00 + 10 * k + i) for i in rng.integers(0, 10, 30)), f"l{k:03}") for k in range(300) for d in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn_profiles(docs)
    assert sorted(profiles) == sorted({r[2] for r in rows})
    got = language_id.predict(docs, profiles, carry=("lang",)).where("NOT held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


@pytest.mark.parametrize("which", ["hard", "none"])
def test_language_defined_results(request, real, which):
    docs = request.getfixturevalue(which)
    for profiles in (language_id.learn_profiles(real), language_id.learn_profiles(docs), {}):
        got = language_id.predict(docs, profiles, carry=tuple(docs.columns))
        got = [(r[0], r[1], r[2], r[3]) for r in got.collect()]
        assert ordered(r[:2] for r in got) == ordered((i, brute.fold(i, 5) == 0) for i, _ in pairs(docs))
        assert all(0 <= r[3] <= 1 for r in got)
    by_text = {(r.doc_id, r.text): r for r in language_id.predict(docs, language_id.learn_profiles(real), carry=("text",)).collect()}
    assert all((r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t)) for (_, t), r in by_text.items())
