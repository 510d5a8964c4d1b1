"""Searches over every token, however frequent, against brute force."""

import random

from pyspark.sql import functions as F

from tessera.operators import match as M


def best_work(query, ref, years, works, article=10.0):
    share = lambda a: len(set(a) & set(ref)) / len(a) if a else 0.0
    found = []
    for w, title, source, year in works:
        if set(title) & set(query):
            y = year is not None and year in years
            score = article + (20.0 if y else 0.0) + 70 * share(title) + (10.0 if share(source) >= 0.5 else 0.0)
            found.append((-score, w, share(title), y))
    if not found:
        return None
    least, w, title, y = min(found)
    grade = "A" if title >= 0.75 and y else "B" if title >= 0.6 and y else "C" if -least >= 65 and y else None
    return grade and (w, -least, grade)


def test_search_cascade_over_frequent_tokens(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(9)]
    works = [(k, rng.sample(words, rng.randrange(4)), rng.sample(["s1", "s2", "w1"], rng.randrange(3)), rng.choice([1990, 1991, 1992, None])) for k in range(200)]
    refs = []
    for k in range(60):
        ref = [*rng.sample(words, 4), rng.choice(["s1", "s2"]), f"only{k}"]
        refs += [(k, pos, ref[:2] if pos == 0 else ref, ref, rng.sample([1990, 1991, 1993], rng.randrange(3))) for pos in range(2)]
    refs += [(60, 0, ["none"], ["none"], [1990]), (61, 0, [], [], [])]
    queries = spark.createDataFrame(refs, "ref_id long, pos int, query_tokens array<string>, ref_tokens array<string>, years array<long>")
    table = spark.createDataFrame([(*w, True) for w in works], "work_id long, title_tokens array<string>, source_tokens array<string>, year long, article boolean")
    expected = {}
    for k, pos, query, ref, years in refs:
        hit = best_work(query, ref, years, works)
        if hit and k not in expected:
            expected[k] = pos, *hit
    got = {r.ref_id: (r.pos, r.work_id, r.score, r.confidence) for r in M.search_cascade(queries, table).collect()}
    assert got == expected and {v[0] for v in got.values()} == {0, 1} and len(got) < 60


def test_best_containment_equals_all_pairs_and_meets_few(spark):
    """Frequent and rare tokens, ties, items and documents without tokens, tokens of no document."""
    rng = random.Random(5)
    words = [f"common{k}" for k in range(12)] + [f"rare{k}" for k in range(400)]
    pick = lambda n: list({rng.choice(words[:12]) if rng.random() < 0.6 else rng.choice(words) for _ in range(n)})
    docs = [(d, pick(rng.randint(0, 25))) for d in range(600)]
    items = [(i, pick(rng.randint(0, 9))) for i in range(40)] + [(40 + i, [*docs[rng.randrange(600)][1], "nowhere"]) for i in range(40)] + [(90, ["nowhere"]), (91, [])]
    left, right = spark.createDataFrame(items, "item_id long, bt array<string>"), spark.createDataFrame(docs, "doc_id long, dt array<string>").repartition(4)
    expected, sharing = {}, 0
    for i, b in items:
        shared = [(-len(set(b) & set(t)), d) for d, t in docs if set(b) & set(t)]
        sharing += len(shared)
        if shared:
            expected[i] = min(shared)[1], -min(shared)[0], len(set(b))
    rounds = []
    got = {r.item_id: (r.doc_id, r.shared, r.size) for r in M.best_containment(left, "item_id", "bt", right, "doc_id", "dt", rounds).collect()}
    assert got == expected and sum(rounds) < sharing
    assert M.best_containment(left.limit(0), "item_id", "bt", right, "doc_id", "dt").count() == 0 == M.best_containment(left, "item_id", "bt", right.limit(0), "doc_id", "dt").count()


def test_best_containment_meets_under_a_tenth_of_the_pairs(spark):
    """The items of the benchmark over the documents of the largest scale."""
    from tessera.functions import text as X

    sf, tokens = "/root/testdata/sf0.1", lambda c: X.match_tokens(X.fold(F.col(c)))
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", tokens("text").alias("bt"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", tokens("text").alias("dt"))
    rounds = []
    M.best_containment(items, "item_id", "bt", docs, "doc_id", "dt", rounds).collect()
    each = items.select("item_id", F.explode("bt").alias("t")).join(docs.select("doc_id", F.explode("dt").alias("t")), "t")
    assert sum(rounds) * 10 < each.select("item_id", "doc_id").distinct().count()


def test_name_linkage_equals_all_pairs(spark):
    """Thousands of names in one block, short, long, hyphenated and contained ones, and a common family name."""
    rng = random.Random(9)
    syllables = "mar tin son berg er man stein feld li wu ng o ab el ka to ri van der de la cruz smith".split()
    family = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))).capitalize()
    base = [(k, k % 2, f"Anna {rng.choice(['', 'van ', 'de ', 'Maria '])}{'Smith' if k % 3 == 0 else family()}{rng.choice(['', '-' + family(), ' ' + family()])}") for k in range(1500)] + [(1500, 0, ""), (1501, None, "Jo Li"), (1502, 0, None)]
    data = [(k, k % 2, rng.choice([f"{family()}, A.", f"{family()} AB", f"Bob {family()}", "Smith, J"])) for k in range(1200)] + [(1200, 0, ""), (1201, None, "Li, J"), (1202, 0, "O, x")]
    left = spark.createDataFrame(base, "a long, block int, full_name string").repartition(3)
    right = spark.createDataFrame(data, "b long, block int, dataset_name string").repartition(3)
    from tessera.functions import text as X

    names = left.select("a", "block", X.family_names(F.col("full_name")).alias("n")).collect()
    families = right.select("b", "block", X.dataset_family_name(F.col("dataset_name")).alias("f")).collect()
    expected = sorted((x.a, y.b) for x in names for y in families if x.block is not None and x.block == y.block and y.f and any(y.f in n for n in x.n))
    linked = M.name_linkage(left, right, ["block"], "full_name", "dataset_name")
    assert linked.columns == ["block", "a", "full_name", "b", "dataset_name"]
    assert sorted((r.a, r.b) for r in linked.collect()) == expected and len(expected) > 1000
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_better_work_outside_the_year_stands_in_the_way(spark):
    works = [(1, ["a", "b", "c", "d", "e"], [], 1990), (2, ["a", "b", "c"], ["s"], 1991), (3, ["x", "y", "z", "v", "w"], [], 1990), (4, ["x", "y"], [], None)]
    refs = [(1, 0, ["a"], ["a", "b", "c"], [1990]), (2, 0, ["x", "z"], ["x", "y", "z"], [1990]), (3, 0, ["q"], ["q"], [1990]), (3, 1, ["a"], ["a", "b", "c", "d"], [1990])]
    queries = spark.createDataFrame(refs, "ref_id long, pos int, query_tokens array<string>, ref_tokens array<string>, years array<long>")
    table = spark.createDataFrame([(*w, False) for w in works], "work_id long, title_tokens array<string>, source_tokens array<string>, year long, article boolean")
    expected = {}
    for k, pos, query, ref, years in refs:
        hit = best_work(query, ref, years, works, 0.0)
        if hit and k not in expected:
            expected[k] = pos, *hit
    assert {r.ref_id: (r.pos, r.work_id, r.score, r.confidence) for r in M.search_cascade(queries, table).collect()} == expected
    assert set(expected) == {3}
    assert M.search_cascade(queries.limit(0), table).count() == 0


def test_best_document_of_an_item_without_rare_tokens(spark, tmp_path):
    from tessera.plans import text_queries as T

    spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(k, "alpha delta") for k in range(25)] + [(30 + k, "alpha beta gamma") for k in range(25)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in T.j13_best_document(spark, str(tmp_path)).collect()] == [(1, 30, 1.0, "A")]
