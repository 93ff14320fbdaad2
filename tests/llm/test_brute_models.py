"""The ordinal regression and the proximity search against plain versions."""

import random

import numpy as np
import pytest

from logtide.llm import decontamination
from logtide.llm import quality_classifier as Q

from . import brute
from .conftest import ordered, pairs


def graded(rng, n, slots, grades):
    docs = [{s: rng.random() for s in rng.sample(range(slots), 4)} for _ in range(n)]
    grade = [min(grades - 1, int(grades * (0.6 * sum(v for s, v in d.items() if s < slots // 2) / 2 + 0.4 * rng.random()))) for d in docs]
    entries = [(k, s, v) for k, d in enumerate(docs) for s, v in d.items()]
    return docs, np.array(grade), *(np.array(c) for c in zip(*entries, strict=True))


@pytest.mark.parametrize("grades", [2, 3, 5])
def test_first_step_follows_the_gradient(grades):
    """A first step goes, in every weight and threshold, where differences of the plain likelihood say."""
    rng = random.Random(grades)
    docs, grade, doc, slot, value = graded(rng, 60, 12, grades)
    before = Q.fit_ordinal(doc, slot, value, grade, grades, epochs=0)
    after = Q.fit_ordinal(doc, slot, value, grade, grades, epochs=1)
    start = brute.log_likelihood(docs, grade, before.weight, before.thresholds)
    for s in range(12):
        moved = before.weight.copy()
        moved[s] += 1e-5
        slope = (brute.log_likelihood(docs, grade, moved, before.thresholds) - start) / 1e-5
        assert abs(slope) < 1e-4 or np.sign(slope) == np.sign(after.weight[s] - before.weight[s])
    assert brute.log_likelihood(docs, grade, 0.02 * after.weight, before.thresholds) > start


def test_fit_is_near_the_best():
    """No change of one weight or of all thresholds makes the plain likelihood much better."""
    docs, grade, doc, slot, value = graded(random.Random(7), 400, 8, 3)
    m = Q.fit_ordinal(doc, slot, value, grade, 3, epochs=400)
    best = brute.log_likelihood(docs, grade, m.weight, m.thresholds)
    assert best > brute.log_likelihood(docs, grade, np.zeros_like(m.weight), m.thresholds) + 0.1
    for step in (-0.3, 0.3):
        assert brute.log_likelihood(docs, grade, m.weight, m.thresholds + step) < best
        for s in range(8):
            moved = m.weight.copy()
            moved[s] += step
            assert brute.log_likelihood(docs, grade, moved, m.thresholds) < best + 1e-3


@pytest.mark.parametrize("which", ["hard", "real"])
def test_scores_are_those_of_single_tokens(request, which):
    rng = np.random.default_rng(3)
    model = Q.Ordinal(rng.normal(size=Q.SLOTS), np.array([-0.4, 0.9]))
    docs = request.getfixturevalue(which)

    def plain(text):
        tokens = brute.blank_words(text)
        z = sum(model.weight[s] for t in tokens for s in Q.features(t.encode())) / max(1, len(tokens))
        tails = 1 / (1 + np.exp(model.thresholds - z))
        return round(z, 6), round(tails.sum(), 6), round(tails[0], 6), int((tails >= 0.5).sum()), bool(tails[0] >= 0.5)

    got = Q.grade_texts(docs, model).collect()
    assert ordered((r.doc_id, round(r.z, 6), round(r.expected_grade, 6), round(r.tail, 6), r.predicted_grade, r.kept) for r in got) == ordered((i, *map(lambda x: x.item() if hasattr(x, "item") else x, plain(t))) for i, t in pairs(docs))


def test_near_items(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 16])))) for k in range(12)] + [(None, "w1 w2 w3"), (99, None)]
    docs = []
    for k in range(60):
        w = [rng.choice(words) for _ in range(rng.randrange(30))]
        own = rng.choice(items)[1]
        if own and rng.random() < 0.7:
            passage = own.split()
            passage.insert(rng.randrange(len(passage) + 1), "extra")
            w[3:3] = passage
        docs.append((k, " ".join(w)))
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute.near_items(docs, items, slop=decontamination.SLOP)
    assert ordered((r.doc_id, r.n_near_items) for r in got.collect()) == ordered(want) and any(n for _, n in want)
