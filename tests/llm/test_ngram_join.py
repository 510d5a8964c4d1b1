"""Components against all pairs."""

import random
import re

import numpy as np
import pytest

from tessera.llm import ngram_join
from tessera.llm.components import components


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 4]) for k in range(len(words) - 3)} if len(words) >= 4 else ({tuple(words)} if words else set())


def brute(rows):
    found = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(found[i] & found[j])
            if both and 100 * both >= 85 * len(found[i] | found[j]):
                parent[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(s), least.get(top(k))) for k, ((i, _), s) in enumerate(zip(rows, found, strict=True))), key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, ngram_join.join(df).collect()), key=str) == brute(rows)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 20)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ngram_join, "SAMPLE_OF", 2)
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, edited(rng, base, rng.randrange(8))) for k in range(80)]
    rows += [(100 + k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 90))) + " " + passage) for k in range(30)]
    rows += [(200 + k, edited(rng, base[: 100 + k], 1)) for k in range(20)]
    check(spark, rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two  three"), (8, "a b c d"), (8, "a b c d"), (None, "A b C d"), (None, None), (None, "alone here now then"), (9, "x " * 9000), (10, "X " * 8000), (11, "cafÉ a b c"), (12, "café a b c"), (42, "unlike all the others here")]
    check(spark, rows)
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_each_group_stays(spark, docs):
    kept = ngram_join.representatives(docs).collect()
    assert kept[0].__fields__ == docs.columns
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "2", "3", "4", "5", "None", "7", "8"])


def test_divide_skip_is_exact():
    rng = np.random.default_rng(6)
    for _ in range(100):
        query = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
        others = [np.unique(rng.choice([query, rng.integers(0, 60, 40).astype(np.uint64)][int(rng.random() < 0.3)], rng.integers(1, 40))) for _ in range(12)]
        others.append(query[: len(query) - 1])
        exact = [k for k, o in enumerate(others) if 100 * (c := len(np.intersect1d(query, o))) >= 85 * (len(query) + len(o) - c)]
        assert ngram_join.divide_skip(query, others) == exact


def test_parity_never_overstates():
    rng = np.random.default_rng(7)
    for n, m in ((5, 5), (200, 180), (3000, 200)):
        a, b = (np.unique(rng.integers(0, 2**63, k, dtype=np.uint64)) for k in (n, m))
        b = np.unique(np.concatenate((b, a[: n // 2])))
        assert ngram_join.apart(ngram_join.parity(a), ngram_join.parity(b)) <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
