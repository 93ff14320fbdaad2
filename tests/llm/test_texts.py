"""Token counts, token files, packing, license scans and quality rules against plain versions."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from logtide.llm import encoding, license_scan, packing, quality_rules, token_counts, token_files
from tests.llm import brute
from tests.llm.conftest import hard_rows, ordered, pairs

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def odd_texts(n=400):
    rng = random.Random(11)
    parts = ["a", "B", "the", "word's", " ", "  ", "\n", "\t", "\r\n", "é", "é", "ß", "İ", "中文", "🙂", "'ll", "<|endoftext|>", "<", "|", "1234", "_", "▁", " ", "　", "​", "don't", "...", "#", "naïve", "Ελλάς", "ﬁ", "�", "\x7f", "x̧"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_pretokens_add_up_to_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    length = token_counts.key_length(PIECES)
    for t in odd_texts():
        assert sum(length(k) for k in token_counts.pretokens(t.encode())) == len(sp.encode(t)), repr(t)


def test_encoder_is_the_library(plain_ids):
    e = encoding.Encoder(WORDS, most=50)
    texts = odd_texts()
    ids, n = e.encode([t.encode() for t in texts])
    ends = np.cumsum(n)
    for t, b, m in zip(texts, ends, n, strict=True):
        assert ids[b - m : b].tolist() == plain_ids(t), repr(t)


@pytest.mark.parametrize("which", ["hard", "real", "none"])
def test_token_counts(request, which):
    import sentencepiece

    sp, docs = sentencepiece.SentencePieceProcessor(model_file=PIECES), request.getfixturevalue(which)
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in pairs(docs)]
    for keep in (65_536, 3):
        assert ordered(token_counts.count_tokens(docs, PIECES, keep=keep).collect()) == ordered(want)


def test_frequent_lengths_are_the_library_s(real):
    import xxhash

    hashes, counts = token_counts.frequent_lengths(real, PIECES, keep=500)
    assert 100 < len(hashes) <= 500 and (np.diff(hashes.astype(object)) > 0).all()
    length, table = token_counts.key_length(PIECES), dict(zip(hashes.tolist(), counts.tolist(), strict=True))
    keys = {k for _, t in pairs(real) for k in token_counts.pretokens((t or "").encode())}
    met = [k for k in keys if xxhash.xxh64_intdigest(k) in table]
    assert len(met) == len(table) and all(table[xxhash.xxh64_intdigest(k)] == length(k) for k in met)


@pytest.mark.parametrize("which", ["hard", "real", "none"])
def test_token_files(request, spark, tmp_path, plain_ids, which):
    docs, path = request.getfixturevalue(which), str(tmp_path / "files")
    token_files.write_token_files(docs, path, WORDS, block_tokens=3_000)
    got = token_files.document_digests(spark, path).collect()
    want = [(i, len(ids := plain_ids(t)), crc(ids)) for i, t in pairs(docs)]
    assert ordered((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == ordered(want)
    got.sort(key=lambda r: r.start)
    ids = [-(2**63) if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[: len(got)].tolist()
    texts = defaultdict(list)
    for i, t in pairs(docs):
        texts[i].append(plain_ids(t))
    for block in token_files.read_token_files(spark, path).limit(4).collect():
        for k in range(0, len(block.doc_ids), 5):
            whole = token_files.decode_slice(block.asDict(), k).tolist()
            assert whole in texts[block.doc_ids[k]]
            for a, m in ((0, 1), (len(whole) // 3, 7), (len(whole) - 1, 5)):
                opened = set()
                assert token_files.decode_slice(block.asDict(), k, a, m, opened).tolist() == whole[a : a + m]
                assert len(opened) <= 64  # the rules above these few ids, not all


def test_repair_replaces_pairs_and_round_trips():
    rng = np.random.default_rng(3)
    ids, n = rng.integers(0, 30, 20_000), np.array([1, 9_999, 4_000, 6_000])
    left, right, symbols, per = token_files.repair(ids, n)
    assert len(left) and len(symbols) < len(ids) and per.sum() == len(symbols)
    assert token_files.expand(symbols, left, right).tolist() == ids.tolist()
    lengths = token_files.expansion_lengths(left, right)
    assert [token_files.expand(np.array([token_files.VOCAB + k]), left, right).size for k in range(0, len(left), 7)] == lengths[::7].tolist()


@pytest.mark.parametrize(("which", "least"), [("hard", 1), ("real", 1), ("none", 1), ("hard", packing.LEAST), ("real", packing.LEAST), ("none", packing.LEAST)])
def test_packing_places_each_id_once(request, plain_ids, which, least):
    docs = request.getfixturevalue(which)
    got = packing.pack(docs, WORDS, least=least).collect()
    want = Counter((i, tuple(plain_ids(t))) for i, t in pairs(docs))
    total = sum(len(ids) * k for (_, ids), k in want.items())
    assert sum(r.length for r in got) == total
    pieces = Counter()
    for (i, ids), k in want.items():
        pieces[i, len(ids)] += k
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(pieces)
    texts = defaultdict(list)
    for (i, ids), _ in want.items():
        texts[i, len(ids)].append(ids)
    for key, p in by_doc.items():
        cover = Counter()
        for a, m, c in p:
            cover.update(range(a, a + m))
            assert c in {crc(ids[a : a + m]) for ids in texts[key]}
        assert cover == Counter({x: pieces[key] for x in range(key[1])})
    for p in by_seq.values():
        p.sort()
        assert [a for a, _ in p] == np.cumsum([0, *[m for _, m in p]])[: len(p)].tolist()
        size = sum(m for _, m in p)
        assert size <= 4096 and size & (size - 1) == 0
    assert set(by_seq) == set(range(len(by_seq)))


def test_packing_holds_its_mixture(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat('word ', 200) AS text", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source").repartition(5)
    got = packing.pack(docs, WORDS, targets={"a": 0.25, "b": 0.75}, window_tokens=8_192).toPandas()
    share = got.groupby(["window", "queue"])["length"].sum().unstack().fillna(0)
    both = share[:-1][(share["a"][:-1] > 0) & (share["b"][:-1] > 0)]
    assert len(both) > 5
    full = both[:-2]
    assert (abs(full["a"] - 2_048) <= 1).all() and (abs(full["b"] - 6_144) <= 1).all()


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.3, "c": 0.2}])
def test_packing_holds_its_mixture_in_each_sequence(spark, targets):
    """Also in those behind the last one that a dry queue (b, with the targets) has a part in."""
    docs = spark.range(700).selectExpr("id AS doc_id", "repeat('word ', 200) AS text", "CASE WHEN id % 7 = 0 THEN 'b' WHEN id % 7 < 4 THEN 'a' ELSE 'c' END AS source").repartition(5)
    got = packing.pack(docs, WORDS, targets=targets).toPandas()
    share = got.groupby(["sequence_id", "queue"])["length"].sum().unstack().fillna(0)
    total = share.sum()
    full = share[share.sum(axis=1) == 4_096]
    assert len(full) == int(total.sum()) // 4_096
    want = targets or (total / total.sum()).to_dict()
    begun, checked = share.cumsum(), 0
    for k, row in full.iterrows():
        wet = [x for x in want if begun[x][k] < total[x] or targets is None]
        if any(begun[x][k] == total[x] and row[x] for x in want if x not in wet):
            continue  # a queue runs dry in this one
        assert all(abs(row[x] - 4_096 * want[x] / sum(want[y] for y in wet)) <= 2 for x in wet)
        checked += 1
    assert checked >= len(full) - 3


@pytest.mark.parametrize("targets", [None, {"big": 0.5, "other": 0.5}])
def test_packing_keeps_every_source(spark, targets):
    docs = spark.range(5_000).selectExpr("id AS doc_id", "repeat('word ', 10) AS text", "CASE id % 4 WHEN 0 THEN 'big' WHEN 1 THEN 'other' ELSE concat('site', id) END AS source").repartition(5)
    got = packing.pack(docs, WORDS, targets=targets).toPandas()
    assert set(got["queue"]) == {r.source for r in docs.select("source").distinct().collect()}
    assert (got.groupby("doc_id")["length"].sum() == got.groupby("doc_id")["doc_tokens"].max()).all()
    share = got.groupby(["sequence_id", "queue"])["length"].sum().unstack().fillna(0)
    full = share[share.sum(axis=1) == 4_096]
    held = full if targets is None else full[:4]  # 'big' and 'other' have ids for six sequences
    assert len(held) >= 4
    assert (abs(held[["big", "other"]] - (1_024 if targets is None else 2_048)) <= 2).all(axis=None)


def test_packing_of_a_rare_source_takes_its_ids_not_the_rounds():
    s = packing.Schedule(["common", "rare"], [10**13, 30_000])
    p = packing.pieces(s, np.array([1]), np.array([0]), np.array([30_000]))  # this document spans all rounds
    assert len(p["length"]) <= 30_000 and p["length"].sum() == 30_000
    assert (p["begin"] == np.cumsum(p["length"]) - p["length"]).all() and (np.diff(p["sequence_id"]) > 0).all()
    s = packing.Schedule(["common", "rare"], [400_000, 60])  # all pieces together fill the sequences without a gap
    cut = [packing.pieces(s, np.full(len(x), q), x, n) for q, x, n in ((0, np.arange(0, 400_000, 1_000), np.full(400, 1_000)), (1, np.array([0, 50]), np.array([50, 10])))]
    at = np.sort(np.concatenate([c["sequence_id"] * 10_000 + c["offset"] for c in cut]))
    length = np.concatenate([c["length"] for c in cut])[np.argsort(np.concatenate([c["sequence_id"] * 10_000 + c["offset"] for c in cut]))]
    assert length.sum() == 400_060 and (at % 10_000 == np.where(np.diff(at // 10_000, prepend=-1) > 0, 0, np.roll(at % 10_000 + length, 1))).all()


@pytest.mark.parametrize(
    ("lengths", "most"),
    [
        ([[2_000] * 200] * 20, 9),  # ids by themselves: 10.8 pieces a document
        ([[2_000] * 5] * 1_000, 9),  # 489
        ([[700, 1, 90, 2_500] * 400, [40, 3_000] * 50, [5_000], [7], [255], [256]], 3.5),
        ([[3], [100, 5]], 2),  # no whole block
    ],
)
def test_packing_in_blocks_keeps_documents_together(lengths, most):
    """No gaps, each id once, few pieces, and over any run of sequences from the first one a share to within two blocks."""
    least = packing.LEAST
    s = packing.Schedule([str(q) for q in range(len(lengths))], [sum(n) for n in lengths], least=least)
    q = np.repeat(np.arange(len(lengths)), [len(n) for n in lengths])
    n, x = np.concatenate(lengths).astype(np.int64), np.concatenate([np.cumsum(n) - n for n in lengths]).astype(np.int64)
    p = packing.pieces(s, q, x, n)
    assert len(p["row"]) <= most * len(n)
    order = np.lexsort((p["begin"], p["row"]))
    begin = (p["begin"] - x[p["row"]])[order]
    ends = begin + p["length"][order]
    first = np.append(True, np.diff(p["row"][order]) > 0)
    assert (begin == np.where(first, 0, np.roll(ends, 1))).all() and (ends[np.append(first[1:], True)] == n).all()
    order = np.lexsort((p["offset"], p["sequence_id"]))
    first = np.append(True, np.diff(p["sequence_id"][order]) > 0)
    assert (p["offset"][order] == np.where(first, 0, np.roll((p["offset"] + p["length"])[order], 1))).all()
    size = np.bincount(p["sequence_id"], p["length"]).astype(int)
    assert (size[: s.full] == 4_096).all() and all(m and not m & (m - 1) for m in size[s.full :].tolist())
    given = np.zeros((len(size), len(lengths)))
    np.add.at(given, (p["sequence_id"], q[p["row"]]), p["length"])
    mixed = s.blocks * least // 4_096 - 1  # sequences before the queues' rests
    due = np.arange(1, mixed + 1)[:, None] * 4_096 * s.share
    assert (abs(given[: max(mixed, 0)].cumsum(axis=0) - due) <= 2 * least).all()


@pytest.mark.parametrize("which", ["hard", "real", "none"])
def test_license_base(request, which):
    docs = request.getfixturevalue(which)
    got = license_scan.scan_licenses(docs)
    assert ordered(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == ordered((i, *brute.license_base(t)) for i, t in pairs(docs))
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_places_of_long_texts():
    """As counted one by one on short texts; in time that grows with the text on long ones."""
    rng = random.Random(7)
    for _ in range(200):
        text = b" ".join(rng.choice([b"cc", b"by", b"all", b"rights", b"reserved", b"x"]) for _ in range(rng.randrange(60)))
        w = text.split()
        want = sorted((k, label) for phrase, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        assert license_scan.base_places(text) == want
        spans = [(a, a + rng.randrange(1, 9), rng.choice("ab"), rng.randrange(3)) for a in (rng.randrange(80) for _ in range(rng.randrange(40)))]
        kept = []
        for s in sorted(set(spans), key=lambda s: (s[3], s[0], s[1], s[2])):
            if not any(s[2] == o[2] and s[0] < o[1] and o[0] < s[1] for o in kept) and not any(s[3] and not o[3] and s[0] < o[1] and o[0] < s[1] for o in spans):
                kept.append(s)
        assert license_scan._best(spans) == sorted(kept)
    began = time.perf_counter()
    assert len(license_scan.base_places(b"cc by " * 300_000)) == 299_999 + 1
    assert len(license_scan._best([(k, k + 1, "a", 0) for k in range(100_000)])) == 100_000
    assert time.perf_counter() - began < 30


def test_fuzzy_search_misses_no_notice():
    rng = random.Random(2)
    texts, notices = [], license_scan.NOTICES
    for k in range(300):
        _, notice, most = notices[k % len(notices)]
        s = bytearray(notice)
        for _ in range(rng.randrange(most + 2)):
            at = rng.randrange(len(s))
            rng.choice([lambda: s.__setitem__(at, 122), lambda: s.__delitem__(at), lambda: s.insert(at, 113)])()  # noqa: B023
        texts.append(b" ".join([b"before that text", bytes(s), b"and after"]))
    found = license_scan.fuzzy_spans(texts)
    for t, spans in zip(texts, found, strict=True):
        assert spans == brute.notices(t, notices)


def test_notices_are_whole_words():
    labels = lambda t: {s[2] for s in license_scan.fuzzy_spans([t])[0]}
    assert labels(b"licensed under cc by nd") == {"cc-by"} and labels(b"licensed under cc byzantine rules") == set()
    assert labels(b"xall rights reserved") == labels(b"all rights reservd") == {"reserved"}
    assert labels(b"licensd under cc by nc") == {"cc-by", "cc-by-nc"} and labels(b"gall rights reserved2") == set()


@pytest.mark.parametrize("which", ["hard", "real", "none"])
def test_quality_counts(request, labels, which):
    docs = request.getfixturevalue(which)
    got = quality_rules.judge(docs, quality_rules.fit_rules(docs, labels))
    want = []
    for i, t in pairs(docs):
        c = brute.quality_counts(t)
        want.append((i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert ordered(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()) == ordered(want)
    assert not got.where("kept AND base_failed").count()


def test_trees_are_monotone_and_useful():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1_500, 3))
    y = ((x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=1_500)) > 0).astype(float)
    trees = quality_rules.fit_trees(x, y, np.array([1, -1, 0]))
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.85
    for f, sign in ((0, 1), (1, -1)):
        grid = np.repeat(x[:50], 40, axis=0)
        grid[:, f] = np.tile(np.linspace(-3, 3, 40), 50)
        assert (sign * np.diff(trees.score(grid).reshape(50, 40), axis=1) >= -1e-12).all()


def test_flat_trees_are_the_trees_walked_one_by_one(real, labels):
    """Scores and verdicts on real labels against a walk from node to node."""
    trees = quality_rules.fit_rules(real, labels)
    assert trees is not None

    def plain(row):
        raw = trees.base
        for k in trees.roots.tolist():
            while trees.left[k] != k:
                k = int(trees.left[k] if row[trees.feature[k]] <= trees.threshold[k] else trees.right[k])
            raw += trees.value[k]
        return 1 / (1 + np.exp(-raw))

    got = {(r.doc_id, r.n_words): r for r in quality_rules.judge(real, trees).collect()}
    for i, t in pairs(real):
        counts, x = quality_rules.statistics([None if t is None else t.encode()])
        r = got[i, int(counts[0][0])]
        assert r.score == pytest.approx(plain(x[0]), rel=1e-9)
        assert r.kept == (not r.base_failed and r.score >= quality_rules.KEEP_AT)


def test_without_enough_grades_the_base_rules_decide(spark, real, labels):
    for few in (labels.limit(0), labels.where("quality = 1"), labels.orderBy("doc_id").limit(quality_rules.LEAST_GRADED - 1)):
        assert quality_rules.fit_rules(real, few) is None
    assert not quality_rules.judge(real, None).where("kept = base_failed").count()


def test_graded_sample_holds_with_repeated_ids(spark, real, labels, monkeypatch):
    """An id that repeats with many texts brings no more rows to the fit than the sample."""
    sizes = []
    monkeypatch.setattr(quality_rules, "fit_trees", lambda x, y, m: sizes.append(len(y)))
    graded = labels.where("quality is not null").limit(40)
    many = real.select("doc_id", "text").unionByName(graded.select("doc_id").join(spark.range(50).selectExpr("concat('own text ', id) AS text")))
    quality_rules.fit_rules(many, graded, sample=600)
    assert sizes == [600]


def test_hard_rows_hold_the_cases():
    rows = hard_rows()
    assert any(r[1] is None for r in rows) and any(r[0] is None for r in rows) and len(rows) != len(set(rows))
