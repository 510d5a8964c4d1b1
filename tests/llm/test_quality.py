"""Held-out quality, tables, edges."""

import numpy as np

from tessera.llm import queries
from tessera.llm import quality
from tessera.llm.quality import FEATURES, LEXICAL, SLOTS, AdditiveModel, Lexicon, featured, fit, label_counts, learn, lexical_slots, lexicons, part_of, scored, text_features


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = queries.op9_quality(spark, sf).where("held_out").join(truth, "doc_id").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    assert len(bad) > 50 and (good[:, None] > bad[None, :]).mean() > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = AdditiveModel(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95


def test_without_both_labels():
    x = np.random.default_rng(0).random((10, len(FEATURES)))
    assert np.allclose(AdditiveModel(x, np.ones(10)).score(x), 10.5 / 11)
    assert np.allclose(AdditiveModel(np.zeros((0, len(FEATURES))), np.zeros(0)).score(x), 0.5)


def test_features():
    assert text_features(None) == text_features("") == [0.0] * len(FEATURES)
    f = dict(zip(FEATURES, text_features("AB AB 12.\nx"), strict=True))
    assert f["upper"] == 4 / 8 and f["digits"] == 2 / 8 and f["distinct_words"] == 3 / 4 and f["repeated_words"] == 1 / 4


def test_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (5, 0), (99, 1)], "doc_id long, quality int")
    features = featured(docs)
    got = scored(features, fit(features, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert scored(featured(docs.limit(0)), fit(features.limit(0), labels)).count() == 0


def test_scores_equal_a_plain_evaluation():
    rng = np.random.default_rng(4)
    x = np.round(rng.random((800, len(FEATURES))), 2)
    model = AdditiveModel(x, (x[:, 2] + x[:, 3] * x[:, 4] > 0.8).astype(float))
    assert model.pairs
    for row, score in zip(x[:60], model.score(x[:60]), strict=True):
        bins = [sum(v >= e for e in edges.tolist()) for v, edges in zip(row, model.edges, strict=True)]
        total = model.base + sum(t[b] for t, b in zip(model.single, bins, strict=True)) + sum(t[bins[i]][bins[j]] for (i, j), t in zip(model.pairs, model.double, strict=True))
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def leaves_gain(g, h, leaves):
    return sum(sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1) for a, b in leaves)


def test_trees_take_the_best_cuts():
    rng = np.random.default_rng(6)
    for _ in range(20):
        g, h, n = rng.normal(size=9), rng.random(9), rng.integers(1, 30, 9)
        one = max(([(0, c), (c, 9)] for c in range(1, 9) if min(n[:c].sum(), n[c:].sum()) >= 8), key=lambda x: leaves_gain(g, h, x))
        two = []
        for at, (a, b) in enumerate(one):
            two += [one[:at] + [(a, c), (c, b)] + one[at + 1 :] for c in range(a + 1, b) if min(n[a:c].sum(), n[c:b].sum()) >= 8]
        best = max([one, *two], key=lambda x: leaves_gain(g, h, x))
        expected = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 1)) for a, b in best])
        assert np.allclose(AdditiveModel._tree(g, h, n), expected)


def test_clashing_names_and_long_texts(spark, docs):
    df = docs.withColumn("digits", docs.doc_id).withColumn("_x", docs.doc_id).withColumn("_id", docs.doc_id).unionByName(docs.limit(1).selectExpr("77L doc_id", "repeat('long text ', 200000) text", "lang", "source", "score", "77L digits", "77L _x", "77L _id"))
    features = featured(df)
    assert features.columns == ["doc_id", "lang", "source", "score", "digits", "_x", "_id", "features"]
    got = scored(features, fit(features, spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")))
    assert got.columns == ["doc_id", "lang", "source", "digits", "_x", "_id", "score"]
    assert all(r.digits == r.doc_id and 0 <= r.score <= 1 for r in got.collect())


def plain_slots(raw):
    """The slots of a text by Python integers, byte by byte."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words = []
    for w in low.split():
        code = sum((b + 1) * pow(0x100000001B3, k + 1, 1 << 64) for k, b in enumerate(w)) % (1 << 64)
        words.append((code * 0x9E3779B97F4A7C15 % (1 << 64)) >> 49)
    runs, before = [], []
    for k in range(len(low) - 3):
        code = int.from_bytes(low[k : k + 4], "little")
        runs.append((code * 0x9E3779B1 % (1 << 32)) >> 17)
        before.append(((code & 0xFFFFFF) * 0x85EBCA6B % (1 << 32)) >> 17)
    return words, runs, before


def test_slots_equal_plain_ones_over_steps(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [b"", b" ", b"ab", b"A b\n", "Große Wörter, zum Teil lange".encode(), *(rng.choice(list(b"abC. \n"), rng.integers(1, 200)).astype(np.uint8).tobytes() for _ in range(30))]
    for step in (quality.STEP, 32):  # no word of these is longer than a step
        monkeypatch.setattr(quality, "STEP", step)
        for raw in texts:
            if max(map(len, raw.split()), default=0) > step:
                continue
            got = [np.concatenate([np.zeros(0, int), *k]).tolist() for k in zip(*lexical_slots(raw), strict=True)] or [[], [], []]
            assert [*got] == [*plain_slots(raw)]


def test_counts_and_odds_equal_plain_ones(spark):
    rows = [(1.0, "good words here"), (0.0, "bad words THERE"), (1.0, "good words here"), (0.0, None), (1.0, ""), (0.0, "x")]
    counts = label_counts(spark.createDataFrame(rows, "_label double, text string").repartition(3))
    expected = np.zeros_like(counts)
    for label, text in rows:
        raw = (text or "").encode()
        for kind, slots in enumerate(plain_slots(raw)):
            np.add.at(expected[part_of(raw), int(label), kind], slots, 1)
    assert (counts == expected).all()
    lexicon = lexicons(counts)[-1]
    good, bad = expected.sum(0)[1, 0], expected.sum(0)[0, 0]
    words = plain_slots(b"good bad news")[0]
    odds = [np.log((good[w] + 1) / (good.sum() + SLOTS)) - np.log((bad[w] + 1) / (bad.sum() + SLOTS)) for w in words]
    assert abs(lexicon.features(b"good bad news")[0] - np.mean(odds)) < 1e-5
    assert lexicon.features(b"good")[0] > 0 > lexicon.features(b"bad")[0]
    assert lexicon.features(b"") == [0.0] * len(LEXICAL)
    assert Lexicon(np.zeros((2, 3, SLOTS))).features(b"some words")[:2] == [0.0, 0.0]


def test_words_alone_tell_quality(spark):
    """Two vocabularies of equal surface: only the lexical features can tell them apart, and held-out texts show it."""
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdefghijklmnopqrst"))
    vocabulary = ["".join(rng.choice(letters, 5)) for _ in range(400)]
    rows = []
    for k in range(600):
        half = vocabulary[:200] if k % 2 else vocabulary[200:]
        words = np.where(rng.random(60) < 0.65, rng.choice(half, 60), rng.choice(vocabulary, 60))
        rows.append((k, " ".join(words), k % 2))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs, labels = frame.select("doc_id", "text"), frame.where("doc_id < 400").select("doc_id", "quality")
    known, model = learn(docs, labels)
    late = [(r.score > 0.5) == r.doc_id % 2 for r in scored(featured(docs, known=known), model).where("doc_id >= 400").collect()]
    assert len(late) == 200 and np.mean(late) > 0.95
    surface = featured(docs)
    late = [(r.score > 0.5) == r.doc_id % 2 for r in scored(surface, fit(surface, labels)).where("doc_id >= 400").collect()]
    assert np.mean(late) < 0.7


def test_lexical_edges(spark, docs):
    """Nulls, no labels, no rows, a word of many steps."""
    df = docs.unionByName(docs.limit(1).selectExpr("77L doc_id", "repeat('x', 700000) text", "lang", "source", "score"), allowMissingColumns=True)
    for labels in ([(1, 1), (1, 0), (3, None), (5, 0), (99, 1)], [(1, 1)], []):
        known, model = learn(df, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = scored(featured(df, known=known), model).collect()
        assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    known, model = learn(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert scored(featured(docs.limit(0), known=known), model).count() == 0
