"""Removed bytes against a count of all windows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_dedup


def brute(rows, length, words=0):
    """Rows as dedup() gives them; with words, a span of fewer words stays unless it is of LENGTH bytes."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(raw[k : k + length] for _, raw in texts for k in range(len(raw) - length + 1))
    out = []
    for i, raw in texts:
        covered = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if counts[raw[k : k + length]] > 1:
                covered[k : k + length] = b"\1" * length
        for m in re.finditer(b"\1+", bytes(covered)):
            if len(raw[m.start() : m.end()].split()) < words and m.end() - m.start() < suffix_dedup.LENGTH:
                covered[m.start() : m.end()] = bytes(m.end() - m.start())
        spans = sum(1 for k, c in enumerate(covered) if c and (not k or not covered[k - 1]))
        out.append((i, len(raw), sum(covered), spans, bytes(b for b, c in zip(raw, covered, strict=True) if not c)))
    return sorted(out, key=str)


def check(spark, rows, length=suffix_dedup.LENGTH, words=0):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(df, length=length, words=words).collect()]
    assert sorted(got, key=str) == brute(rows, length, words)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_windows(spark, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé ") for _ in range(3000))
    rows = []
    for k in range(100):
        at, size = rng.randrange(2400), rng.choice([300, 380, 399, 400, 401, 430, 500, 900])
        part = base[at : at + size]
        if rng.random() < 0.3:
            p = rng.randrange(len(part))
            part = part[:p] + "Z" + part[p + 1 :]
        rows.append((k, "".join(rng.choice("wxyz") for _ in range(rng.randrange(300))) + part + "".join(rng.choice("wxyz") for _ in range(rng.randrange(300)))))
    check(spark, rows)


def test_edges(spark):
    base = "".join(random.Random(9).choice("abc def") for _ in range(1200))
    rows = [(1, None), (2, ""), (3, "x" * 399), (4, "x" * 401), (5, "ab" * 350), (6, base), (6, base), (None, base[:500]), (None, None), (7, "Ein. " * 200), (8, "Ein. " * 120 + base[:450]), (9, "é" * 300)]
    check(spark, rows)


def test_near_copies_of_copied_runs(spark):
    base = "".join(random.Random(4).choice("abcdefg ") for _ in range(2500))
    rows = [(k, base) for k in range(5)] + [(10 + k, base[: 200 * k] + "#" + base[200 * k + 1 :]) for k in range(1, 12)]
    check(spark, rows)


@pytest.mark.parametrize("length, words", [(200, 0), (200, 51), (64, 0)])
def test_other_lengths_and_words(spark, length, words):
    rng = random.Random(7)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(400))
    cuts = [(rng.randrange(1200), rng.choice([60, 150, 210, 260, 300, 420])) for _ in range(60)]
    check(spark, [(k, "".join(rng.choice("wxyz ") for _ in range(150)) + base[a : a + n] + str(k)) for k, (a, n) in enumerate(cuts)], length, words)


def test_hot_buckets_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", 3)
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefg ") for _ in range(700))
    rows = [(k, "".join(rng.choice("wxyz") for _ in range(40)) + shared[k % 9 : 395 + k % 23] + "".join(rng.choice("ab") for _ in range(60))) for k in range(80)]
    check(spark, rows)


@pytest.mark.parametrize("length, most", [(400, 40), (101, 60), (20, 3000)])
def test_a_piece_gives_one_range(spark, length, most):
    """A passage amid different texts: its suffixes are not a row each, where strings are as long as a piece."""
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefg ") for _ in range(1000))
    rows = [(k, "".join(rng.choice("wxyz") for _ in range(300)) + base + "".join(rng.choice("stuv") for _ in range(300))) for k in range(2)]
    found = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()
    assert len(found) == 2 and all(len(r.ranges) <= most for r in found)
    check(spark, rows, length)


def test_clashing_names(spark, docs):
    df = docs.withColumnsRenamed({"lang": "d", "source": "h"}).withColumn("ranges", F.lit(1)).withColumn("_d", F.lit(2)).withColumn("Spans", F.lit(3))
    got = suffix_dedup.dedup(df)
    assert got.columns == ["doc_id", "text", "d", "h", "score", "ranges", "_d", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    assert sorted(str((r.doc_id, r.d, r.h)) for r in got.collect()) == sorted(str((r.doc_id, r.lang, r.source)) for r in docs.collect())


def test_columns_and_empty_table(spark, docs):
    got = suffix_dedup.dedup(docs.withColumnRenamed("score", "kept"), as_text=True)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    by_id = {r.doc_id: r for r in got.collect()}
    assert got.count() == docs.count() and by_id[7].n_removed == 5000 and by_id[2].kept == ""
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


def test_the_cover_covers():
    assert {(a - b) % suffix_dedup.CYCLE for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.CYCLE))


def test_chunks_of_long_texts(monkeypatch):
    raw = bytes(random.Random(1).choices(range(97, 105), k=9000))
    whole = {}
    for first, last, place, bucket in suffix_dedup.runs(raw):
        whole |= {i: (place - i, bucket) for i in range(first, last + 1)}
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    parts = {}
    for first, last, place, bucket in suffix_dedup.runs(raw):
        parts |= {i: (place - i, bucket) for i in range(first, last + 1)}
    assert parts == whole and len(whole) == len(raw) - suffix_dedup.LENGTH + 1
