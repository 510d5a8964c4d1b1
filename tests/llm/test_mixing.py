"""Water-filling against the loop it stands for, and the repetitions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import mixing


def loop(sizes, weights=(5, 2, 1), epochs=2, share=1.5):
    """Clamp what is above its cap, give the excess to the others by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    open_, fixed, left = set(names), {}, share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > epochs * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in open_}
        for s in over:
            fixed[s] = epochs * sizes[s]
            left -= fixed[s]
            open_.discard(s)
    return fixed


@settings(max_examples=8, deadline=None)
@given(sizes=st.dictionaries(st.one_of(st.none(), st.sampled_from([f"s{k}" for k in range(12)] + ["é", "Z", "𝒳", ""])), st.integers(0, 5000), min_size=1, max_size=8))
def test_targets_equal_the_loop(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == {s: pytest.approx(t, abs=1e-6) for s, t in loop(sizes).items()}


def test_repeats_meet_targets(spark):
    rows = [(k, f"s{k % 3}" if k % 7 else None, 1 + k % 40) for k in range(6000)] + [(None, "s0", 3), (5, "s0", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.repeats <= 2 for r in got)
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.size * r.repeats
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.repeated(mixing.mix(df)).count() == sum(r.repeats for r in got)


def test_rows_without_ids_are_spread(spark):
    df = spark.createDataFrame([(None, "s0", 1 + k % 300) for k in range(3000)] + [(k, "s1", 5) for k in range(2000)], "doc_id long, source string, size long")
    places = df.where("doc_id is null").select(F.shiftright(mixing.seeded_order(F.col("doc_id"), F.col("size"), mixing.SEED), mixing.BUCKET_BITS)).distinct().count()
    taken = {r.source: (r.n, r.target) for r in mixing.mix(df).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("repeats")).alias("n")).collect()}
    assert places > 200 and all(abs(n - target) <= 300 for n, target in taken.values())


def test_words_and_edges(spark, docs):
    for r in docs.withColumn("size", mixing.n_words(F.col("text"))).collect():
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    sized = docs.withColumn("size", mixing.n_words(F.col("text"))).withColumn("target", F.lit("old"))
    assert mixing.mix(sized).count() == docs.count()
    assert mixing.mix(sized.limit(0)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(k, f"s{k % 3}", 1 + k % 9) for k in range(300)], "doc_id long, source string, size long")
    wide = df
    for c in ("_mix_at", "_mix_bucket", "_mix_source", "_mix_plan", "_MIX_part", "_mix_copy", "Target", "of", "part", "end"):
        wide = wide.withColumn(c, F.col("doc_id"))
    got, plain = mixing.mix(wide), mixing.mix(df)
    assert got.columns == ["doc_id", "source", "size", "_mix_at", "_mix_bucket", "_mix_source", "_mix_plan", "_MIX_part", "_mix_copy", "of", "part", "end", "source_size", "target", "repeats"]
    assert all(r._mix_at == r._mix_bucket == r._mix_source == r._mix_plan == r.end == r.doc_id for r in got.collect())
    assert sorted(got.select(plain.columns).collect()) == sorted(plain.collect())
    assert mixing.repeated(got).select("_mix_copy").count() == mixing.repeated(plain).count()
