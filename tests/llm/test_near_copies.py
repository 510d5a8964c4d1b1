"""The pipeline's near copies against all pairs on five words and a similarity of 0.8."""

import random
import re

import corpus_pipeline


def groups(rows, n=5, percent=80):
    """The least id of each row's component."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for _, t in rows]
    sets = [{tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for w in words]
    label = [i for i, _ in rows]
    for x in range(len(rows)):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                old, new = max(label[x], label[y]), min(label[x], label[y])
                label = [new if v == old else v for v in label]
    return label


def test_near_copies_share_four_fifths_of_five_words(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(100)]
        for c in range(5):
            words = list(base)
            for k in rng.sample(range(5, 95), rng.randrange(1, 3)):
                words[k] = f"e{rng.randrange(10**6)}"
            rows.append((10 * g + c, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.join_near_copies(spark, docs, "").collect())
    assert kept == sorted(set(groups(rows))) != sorted(set(groups(rows, 4, 85)))
