"""Filters before ranking and merging, the incremental merge, two-level lists, one-pass audits."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics as A
from tessera.operators import classify as C
from tessera.operators import evidence as R
from tessera.operators import gaps as G
from tessera.plans import gap_queries as Q
from tessera.streaming.keyed_table import KeyedTable

REGISTRY = "record long, work string, title string, source array<string>, metadata_match_confidence string, review_priority string, registry_status string, analysis_readiness string"
KEY = ["record", "work"]


def merge(old, new):
    return R.upsert(old, new, KEY, "at_row", ["title"], ["source"])


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def evidence(rng, n, first):
    return [(rng.randrange(40), f"w{rng.randrange(5)}", first + k, rng.choice(["", "late", "later"]), [rng.choice("gh")], rng.choice("ABC"), *rng.choice([("P1", "s1", "r1"), ("P2", "s2", "r2"), ("P2", "s3", "r3")])) for k in range(n)]


@pytest.fixture
def late(spark):
    rng, schema = random.Random(4), "record long, work string, at_row long, title string, source array<string>, metadata_match_confidence string, review_priority string, registry_status string, analysis_readiness string"
    return [spark.createDataFrame(evidence(rng, 60, k * 1000), schema) for k in range(3)]


@pytest.fixture
def registry(spark):
    rows = [(k, f"w{k % 5}", "" if k % 3 else f"t{k}", ["o"], "D" if k % 4 == 0 else "A", f"P{1 + k % 4}", "old", "old") for k in range(60)]
    return spark.createDataFrame(rows, REGISTRY)


def rows_of(df):
    return sorted(map(str, (tuple(r[c] for c in REGISTRY_COLUMNS) for r in df.collect())))


REGISTRY_COLUMNS = [c.split()[0] for c in REGISTRY.split(", ")]


def test_batches_and_a_replay_equal_one_merge(spark, tmp_path, registry, late):
    kept = KeyedTable(spark, str(tmp_path / "t"), registry.schema, KEY, buckets=16)
    assert kept.read().count() == 0
    kept.merge(registry, lambda old, new: new)
    for k, part in enumerate(late):
        assert kept.merge(part, merge, "late", k)
        assert not kept.merge(part, merge, "late", k) and not kept.merge(part, merge, "late", 0)
    whole = late[0].unionByName(late[1]).unionByName(late[2])
    assert rows_of(kept.read()) == rows_of(merge(registry, whole))
    assert kept.state()["version"] == 4


def test_only_touched_buckets_are_written(spark, tmp_path, registry, late):
    kept = KeyedTable(spark, str(tmp_path / "t"), registry.schema, KEY, buckets=16)
    kept.merge(registry, lambda old, new: new)
    before, one = kept.files(), late[0].limit(1)
    kept.merge(one, merge)
    changed = [b for b, f in kept.files().items() if before.get(b) != f]
    touched = one.select(F.pmod(F.xxhash64(*KEY), F.lit(16)).cast("string")).first()[0]
    assert changed == [touched] and len(before) > 8
    kept.merge(late[0].limit(0), merge)
    assert kept.read().count() >= 60


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path, registry, late):
    kept = KeyedTable(spark, str(tmp_path / "t"), registry.schema, KEY, buckets=4)
    kept.merge(registry, lambda old, new: new)
    for part in late:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        kept.follow(spark.readStream.schema(part.schema).parquet(str(tmp_path / "in")), merge, "late", str(tmp_path / "done")).awaitTermination()
    once = rows_of(kept.read())
    # Without its own progress a stream begins anew with batch 0: all of it is known.
    kept.follow(spark.readStream.schema(late[0].schema).parquet(str(tmp_path / "in")), merge, "late", str(tmp_path / "lost")).awaitTermination()
    assert rows_of(kept.read()) == once == rows_of(merge(registry, late[0].unionByName(late[1]).unionByName(late[2])))


def test_two_merges_of_one_version_do_not_both_win(spark, tmp_path, registry):
    kept = KeyedTable(spark, str(tmp_path / "t"), registry.schema, KEY, buckets=4)
    kept.merge(registry, lambda old, new: new)
    with pytest.raises(RuntimeError, match="another merge"):
        kept._commit(kept.state() | {"version": 1})


def test_what_may_be_merged(spark):
    rows = [(1, "D", "metadata_candidate_needs_review"), (2, "A", "metadata_candidate_needs_review"), (3, "B", "metadata_matched_needs_official_alignment"), (4, "A", "no_match"), (5, None, "metadata_candidate_needs_review"), (6, "", "metadata_candidate_needs_review"), (7, "A", None)]
    df = spark.createDataFrame(rows, "id int, metadata_match_confidence string, review_status string")
    assert sorted(r.id for r in R.mergeable(df).collect()) == [2, 3, 5, 6]


def test_filters_before_the_ranking(spark):
    text = "Physical Review 12 (1950) on rays and Curie"
    refs = [(1, 1, "x", text), (1, 2, "x", text + "!"), (1, 3, "x", "A book, Oxford University Press 1950"), (2, 4, "x", text), (3, 5, "nobel_lecture", "Delivered in Stockholm, Nature 1950"), (4, 6, "scientific_background", "doi 10.1234/abc of 1960, rays"), (None, 7, "x", text), (4, 8, "x", None)]
    gaps = [(1, 1952, "for rays", "Marie Curie"), (3, 1960, "x", "A B"), (4, 1950, "rays", "Anna Li"), (5, 1950, None, None)]
    r = spark.createDataFrame(refs, "record int, ref int, pdf_type string, reference_text string")
    g = spark.createDataFrame(gaps, "record int, award_year int, motivation string, full_name string")
    got = {x.ref: (x.record, x.reference_class, x.name_in_reference, x.score, x.place) for x in G.ranked_gap_candidates(r, g, "record", "ref").collect()}
    assert got == {1: (1, "likely_journal_article", True, 6 + 7 + 2 + 3, 1), 6: (4, "doi_present", False, 8 + 4 - 5 + 2 + 3, 1)}
    assert sorted(x.record for x in G.without_references(r, g, "record", "ref").collect()) == [3, 5]


def test_the_query_has_rows_on_both_sides_of_each_filter(spark, sf_dir):
    refs, queue = Q.gap_references(spark, sf_dir), Q.gap_queue(spark, sf_dir)
    classes = Counter(r[0] for r in refs.select(C.reference_class(F.col("reference_text"))[0]).collect())
    assert set(C.USABLE_CLASSES) < set(classes) and classes["aggregate_further_reading"] and classes["book_or_chapter"]
    outside = refs.join(queue, "record_id", "left_anti").count()
    plain = Counter(r[0] for r in refs.where(G.usable(C.reference_class(F.col("reference_text"))[0])).select(C.is_boilerplate(F.col("reference_text"))).collect())
    rows = Q.f03_usable_references(spark, sf_dir).collect()
    assert outside and plain[True] and plain[False] and {r.name_in_reference for r in rows} == {True, False} and len({r.gap_tier for r in rows}) >= 3
    graded = Counter((r.metadata_match_confidence == "D", r.review_status) for r in Q.graded(spark, sf_dir).collect())
    assert len(graded) == 8


def test_lists_of_a_key_with_many_rows(spark):
    """A million rows of one key and ten values: what is gathered is one row a value and column."""
    rows = spark.range(1_000_000).select(F.lit("k").alias("key"), (F.col("id") % 10).cast("string").alias("a"), F.when(F.col("id") % 3 == 0, " ").otherwise(F.lit("x")).alias("b"), (999_999 - F.col("id")).alias("at"))
    lists = A.ordered_lists(rows, ["key"], ["a", "b"], "at")
    assert tuple(lists.first()) == ("k", [str(9 - k) for k in range(10)], ["x"])
    plan = plan_of(lists)
    assert plan.count("collect_list") >= 1 and "min(_at" in plan


def test_lists_with_ties_blanks_and_null_keys(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", "b", "c", "", " ", None]), rng.choice(["x", "y"]), rng.randrange(6)) for _ in range(80)] + [(9, None, " ", 1)]
    df = spark.createDataFrame(rows, "key int, v string, w string, at int").repartition(5)
    expected = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        seen = lambda i: [v for _, v in sorted((min(r[3] for r in mine if r[i] == v), v) for v in {r[i] for r in mine if r[i] and r[i].strip()})]  # noqa: B023, E731
        expected[key] = (seen(1), seen(2))
    assert {r.key: (r.v, r.w) for r in A.ordered_lists(df, ["key"], ["v", "w"], "at").collect()} == expected
    flags = df.select("*", *[F.lit(c == "official").alias(c) for c in ("official", "dataset", "dataset_matched", "dataset_unresolved")])
    assert {r.key: (r.v, r.w) for r in R.registry([flags], ["key"], "at", [], ["v", "w"]).collect()} == expected


def test_an_audit_is_one_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = spark.createDataFrame([(1,), (2,), (3,)], "id int")
        other = spark.createDataFrame([(1,), (1,), (4,), (None,)], "id int")
        rows = R.audit(base, "id", {"a": other, "b": other.where("id = 1"), "c": base})
        plan = plan_of(rows)
        assert sorted(map(tuple, rows.collect())) == [(1, 2, 2, 1), (2, 0, 0, 1), (3, 0, 0, 1)]
        assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1 and "Join" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_rows_are_cut_before_the_shuffle(spark):
    rows = A.first_rows(spark.range(1000).select((F.col("id") % 3).alias("k"), "id"), ["k"], [F.col("id").desc()], 2)
    assert sorted((r.k, r.id, r.place) for r in rows.collect()) == [(0, 996, 2), (0, 999, 1), (1, 994, 2), (1, 997, 1), (2, 995, 2), (2, 998, 1)]
    assert "WindowGroupLimit" in plan_of(rows)


def test_context_of_records(spark):
    clues = [(1, 1, "facts", "reference_like", "on rays", "p2", ""), (1, 2, "x", "pdf_link", "file", "p1", "f1"), (1, 3, "", "pdf_link", "no file", "p2", ""), (1, 4, "x", "doi", "rays and more rays", None, "f9"), (1, 5, "x", "doi", "nothing", "p3", None), (7, 6, "x", "doi", "z" * 400, "p1", None), (None, 7, "x", "doi", "lost", "p1", None), (1, 8, "x", "pdf_link", "again", "p1", "f1")]
    df = spark.createDataFrame(clues, "id int, at int, target_type string, clue_type string, clue_text string, source_page string, href string")
    records = spark.createDataFrame([(1, ["rays"]), (2, ["rays"])], "id int, terms array<string>")
    got = {r.id: (r.source_pages, r.pdf_links, r.snippets) for r in R.evidence_context(df, records, "id", "at").collect()}
    assert got == {1: (["p2", "p1", "p3"], ["f1"], ["[facts] on rays", "[x] rays and more rays", "[pdf_link] no file"]), 2: ([], [], []), 7: (["p1"], [], ["[x] " + "z" * 299 + "..."])}
