"""Operators whose order or edge cases matter."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics as A
from tessera.operators import classify as C
from tessera.operators import evidence as R
from tessera.operators import extract as E
from tessera.operators import match as M
from tessera.plans import stages
from tessera.sources import readers, sinks


def test_mode_and_firsts_survive_shuffling(spark):
    rows = [(1, k, v) for k, v in enumerate(["", "b", "a", "a", "b", "c"])] + [(2, 9, " ")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "g int, at int, v string").repartition(3)
        assert [tuple(r) for r in A.mode_first(df, ["g"], "v", "at").collect()] == [(1, "b")]
        every = A.ordered_lists(df, ["g"], ["v"], "at").withColumnRenamed("v", "every")
        got = {r.g: (r.first, r.every) for r in df.groupBy("g").agg(A.first_filled("v", "at").alias("first")).join(every, "g").collect()}
        assert got == {1: ("b", ["b", "a", "c"]), 2: (None, [])}
        assert [(r.g, r.at) for r in A.first_wins(df, ["g"], ["at"]).orderBy("g").collect()] == [(1, 0), (2, 9)]


def test_coverage_edges(spark):
    nine = spark.createDataFrame([("a", k) for k in range(9)] + [("b", 0)], "g string, r int")
    got = {r.g: (r.cumulative_share, r.cumulative_records, r.in_threshold) for r in A.coverage(nine, "g", "r").collect()}
    assert got == {"a": (0.9, 9, True), "b": (1.0, 9, False)}
    one = A.coverage(nine.where("g = 'b'"), "g", "r").first()
    assert one.in_threshold and one.rank == 1
    never = A.coverage(nine, "g", "r", threshold=1.5)
    assert all(r.in_threshold for r in never.collect())


def test_lags_and_quartiles(spark):
    df = spark.createDataFrame([("x", v, k) for k, v in enumerate([1, 2, 4, 9, -3, None])], "g string, lag int, r int")
    got = A.lag_statistics(df, "g", "lag", "r", quartiles=True).first()
    assert (got.n, got.p25, got.p75, got.median_lag, got.min_lag) == (4, 1.75, 5.25, 3.0, 1)


def test_trailing_mean(spark):
    rows = [("a", y, 0.01 * (y - 2000), 0.05) for y in range(2000, 2012)] + [("b", y, 1.0, 0.05) for y in range(2000, 2004)]
    got = {r.c: r.first_year for r in A.first_year_reaching(spark.createDataFrame(rows, "c string, y int, s double, t double"), ["c"], "y", "s", "t").collect()}
    assert got == {"a": 2007, "b": None}


@pytest.mark.parametrize("n", [5, 6, 9, 23])
def test_even_spacing(spark, n):
    df = spark.range(n).withColumn("s", F.lit("x"))
    got = sorted(r.id for r in A.evenly_spaced(df, ["s"], ["id"], 5).collect())
    assert got == [round(i * (n - 1) / 4) for i in range(5)]


def test_even_spacing_needs_rows(spark):
    with pytest.raises(Exception, match="not enough rows"):
        A.evenly_spaced(spark.range(4).withColumn("s", F.lit("x")), ["s"], ["id"], 5).collect()
    assert A.evenly_spaced(spark.range(4).withColumn("s", F.lit("x")), ["s"], ["id"], 1).first().id == 2


def test_strong_candidates_have_no_route(spark):
    row = spark.createDataFrame([("t", "j", 1950, 1960, "strong_candidate_needs_final_acceptance_review", "W1", "", "A")], "title string, journal string, y int, a int, s string, w string, e string, c string")
    args = [F.col(c) for c in ("title", "journal", "y", "a", "s", "w", "e", "c")]
    assert row.select(C.analysis_inclusion(*args)[0]).first()[0] == "review_only"
    assert row.select(C.analysis_inclusion(*args, accept_strong=True)[0]).first()[0] == "main"
    gap = row.withColumn("e", F.lit("nobel_official_gap_reference_a_tier"))
    assert gap.select(C.analysis_inclusion(*args)[0]).first()[0] == "main"


def test_aggregate_and_boilerplate(spark):
    long = "Additional information: websites and books. " + "x" * 800
    many = " ".join(str(y) for y in range(1950, 1960)) + " y" * 1000
    df = spark.createDataFrame([(long,), (many,), ("A book, Oxford 1950",), ("",)], "t string").select("t", *C.reference_class(F.col("t")), C.is_boilerplate(F.col("t")).alias("b"))
    got = [(r.reference_class, r.b) for r in df.collect()]
    assert got == [("aggregate_further_reading", False), ("aggregate_further_reading", False), ("book_or_chapter", False), ("needs_manual_review", True)]


def test_clues_and_sections(spark):
    html = '<p>See doi 10.1234/abc and Nature 1950 for more on it</p><li>short</li><p>See doi 10.1234/abc and Nature 1950 for more on it</p><a href="/f.PDF">A <b>file</b></a><p>Nothing to be found in this block at all</p>'
    got = sorted((r.clue_type, r.clue_text) for r in E.page_clues(spark.createDataFrame([(1, html)], "id int, html string"), ["id"], "html").collect())
    text = "See doi 10.1234/abc and Nature 1950 for more on it"
    assert got == [("doi", "10.1234/abc"), ("pdf_link", "A file"), ("reference_like", text)]
    body = "References 1.\nold part\nFurther reading\nIntroductory note of the year 1999 here\n1. First item with enough text 1950\ncontinued\n[2] too short 1950\n3) Third without any year but it is long\n4. Fourth with doi 10.1234/zzz.yyy inside"
    items, without = E.document_references(spark.createDataFrame([(1, body), (2, "nothing")], "id int, body string"), ["id"], "body")
    assert [(r.section_marker, r.reference_text) for r in items.orderBy("item").collect()] == [
        ("Further reading", "Introductory note of the year 1999 here"),
        ("Further reading", "First item with enough text 1950 continued"),
        ("Further reading", "Fourth with doi 10.1234/zzz.yyy inside"),
    ]
    assert [r.id for r in without.collect()] == [2]


def test_targets(spark):
    html = '<a href="/l">Nobel Prize lecture</a><option value="/b">-- Biographical</option><a href="/x">other</a><a href="/l">Article</a>'
    got = E.secondary_targets(spark.createDataFrame([(1, html, "http://h/p")], "id int, html string, url string"), ["id"], "html", "url").collect()
    assert sorted((r.target_type, r.label, r.target_url) for r in got) == [("biographical", "Biographical", "http://h/b"), ("lecture", "Nobel Prize lecture", "http://h/l")]


def test_merge_order_and_upsert(spark):
    kinds = "rec int, work string, at int, title string, source string, official boolean, dataset boolean, dataset_matched boolean, dataset_unresolved boolean"
    official = spark.createDataFrame([(1, "w", 5, "", "o1", True, False, False, False), (1, "w", 7, "T", "o2", True, False, False, False)], kinds)
    dataset = spark.createDataFrame([(1, "w", 1, "D", "d", False, True, True, False), (2, "v", 1, None, "d", False, True, False, True)], kinds)
    rows = R.registry([official, dataset], ["rec", "work"], "at", ["title"], ["source"])
    got = {r.rec: (r.title, r.source, r.registry_status, r.review_priority) for r in rows.collect()}
    assert got == {1: ("T", ["o1", "o2", "d"], "strong_candidate_needs_final_acceptance_review", "P1"), 2: (None, ["d"], "metadata_unresolved_needs_manual_or_identifier_search", "P4")}
    late = spark.createDataFrame([(2, "v", 3, "L", ["g"], "C", "P2", "s2", "r2"), (2, "v", 1, "", ["g", "h"], "B", "P1", "s1", "r1"), (3, "n", 1, "N", ["g"], "A", "P1", "s", "r")], "rec int, work string, at int, title string, source array<string>, metadata_match_confidence string, review_priority string, registry_status string, analysis_readiness string")
    got = {r.rec: (r.title, r.source, r.metadata_match_confidence, r.review_priority, r.registry_status) for r in R.upsert(rows, late, ["rec", "work"], "at", ["title"], ["source"]).collect()}
    assert got[2] == ("L", ["d", "g", "h"], "B", "P1", "s1") and got[3] == ("N", ["g"], "A", "P1", "s") and got[1][3] == "P1"


def test_cascade_and_containment(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, None), (5, "z")], "id int, k string")
    first, second = (spark.createDataFrame(x, "k string, v string") for x in ([("a", "1")], [("a", "2"), ("b", "2")]))
    assert {r.id: (r.v, r.match_status) for r in M.cascade(rows, "k", first, second, ["v"]).collect()} == {1: ("1", "matched_first"), 2: ("2", "matched_second"), 3: (None, "no_match"), 4: (None, "no_match"), 5: (None, "no_match")}
    twice = spark.createDataFrame([("a", "9", 2), ("a", "8", 3), ("a", "7", 1)] * 3, "k string, v string, at int").repartition(5)
    assert {r.id: r.v for r in M.cascade(rows, "k", twice, second.withColumn("at", F.lit(0)), ["v"], ["at"]).collect()}[1] == "7" == {r.id: r.v for r in M.cascade(rows, "k", twice, second, ["v"]).collect()}[1]
    sets = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["b"])], "a array<string>, b array<string>")
    assert [r[0] for r in sets.select(M.containment(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]


def test_files(spark, tmp_path):
    (tmp_path / "a.tab").write_text('﻿Name\tNote\nA\t"say ""hi"" \\"\nB\t\n', encoding="utf-8")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "a.tab"), tab=True).collect()] == [("A", 'say "hi" \\'), ("B", None)]
    assert readers.csv_or_empty(spark, str(tmp_path / "missing.csv"), "x string").count() == 0
    sinks.write_csv(spark.createDataFrame([(1, ["a", "b"], None)], "k int, l array<string>, n string"), str(tmp_path / "out"), ["n", "l", "k"])
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "out")).collect()] == [(None, "a || b", "1")]
    for k in range(2):
        sinks.append_audit(spark, str(tmp_path / "audit"), f"q{k}", "match")
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    assert sinks.copy_if_needed(str(tmp_path / "a.tab"), str(tmp_path / "d/b.tab")) and not sinks.copy_if_needed(str(tmp_path / "a.tab"), str(tmp_path / "d/b.tab"))
    (tmp_path / "p.bin").write_bytes(b"one\fb\xffd")
    assert readers.documents(spark, [str(tmp_path / "p.bin")]).first().text == "one\fb�d"
    rng = random.Random(1)
    broken = [bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    for k, raw in enumerate(broken):
        (tmp_path / f"raw{k:03d}.bin").write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in readers.documents(spark, [f"{tmp_path}/raw*.bin"]).collect()}
    assert [got[f"raw{k:03d}.bin"] for k in range(400)] == [raw.decode("utf-8", "replace") for raw in broken]
    pages = readers.document_pages(spark, [str(tmp_path / "p.bin"), str(tmp_path / "a.tab")], lambda raw: raw.decode("ascii").split("\f") if b"Name" not in raw else 1 / 0)
    assert {r.error for r in pages.collect()} and pages.count() == 2


def test_nested_payloads(spark):
    prizes = '{"nobelPrizes":[{"awardYear":"1950","category":{"en":"Physics"},"laureates":[{"id":"1","knownName":{"en":"A B"},"links":[{"rel":"x","href":"u"},{"rel":"external","href":"v"}]}]},{"awardYear":"1950","category":{"en":"Peace"},"laureates":[{"id":"2"}]}]}'
    got = readers.prize_rows(spark.createDataFrame([(prizes,)], "value string"), ["Physics"]).collect()
    assert [(r.laureate_id, r.full_name, r.affiliation_name, r.nobel_url) for r in got] == [("1", "A B", None, "v")]
    item = '{"message":{"items":[{"DOI":"10.1/A","title":["T"],"issued":{"date-parts":[[1999,1]]},"type":"journal-article","score":2.5}]}}'
    got = spark.createDataFrame([(item,)], "v string").select(readers.cited_items(F.col("v"))).first()[0][0]
    assert (got.doi, got.title, got.journal, got.year) == ("10.1/a", "T", None, 1999)
    work = '{"results":[{"id":"W1","display_name":"D","publication_year":2001,"primary_location":{"source":{"display_name":"J"}}}]}'
    got = spark.createDataFrame([(work,)], "v string").select(readers.work_fields(F.col("v")).alias("w")).first().w
    assert (got.openalex_title, got.openalex_year, got.openalex_journal) == ("D", 2001, "J")


def test_requests_are_retried():
    import io
    import urllib.error

    waits, answers = [], [urllib.error.HTTPError("u", 429, "slow", {"Retry-After": "7"}, None), urllib.error.HTTPError("u", 503, "down", {}, None), OSError("net")]

    class Answer(io.BytesIO):
        status = 200

    def opener(url, timeout):
        if answers:
            raise answers.pop(0)
        return Answer(b"{}")

    assert readers.request("u", opener=opener, sleep=waits.append)["fetch_status"] == "ok" and waits == [7.0, 2.0, 4.0]
    answers.append(urllib.error.HTTPError("u", 404, "gone", {}, None))
    assert readers.request("u", opener=opener, sleep=waits.append)["http_status"] == 404 and len(waits) == 3


def test_fetches_use_the_cache(spark):
    kind = "url string, fetch_status string, http_status int, body string, error string"
    cache = spark.createDataFrame([("a", "ok", 200, "cached", None)], kind)
    get = lambda u: {"url": u, "fetch_status": "ok", "http_status": 200, "body": "new", "error": None}
    got = {r.url: r.body for r in readers.fetched(spark.createDataFrame([("a",), ("b",), ("b",)], "url string"), cache, get).collect()}
    assert got == {"a": "cached", "b": "new"}
    assert readers.source_registry(spark).count() == 9


def test_runner_orders_and_gates(spark, tmp_path):
    add = lambda name, src: stages.Stage(name, [src], [f"{name}_t"], lambda s, t: {f"{name}_t": t[src].withColumn(name, F.lit("C"))})
    plan = stages.Pipeline([add("b", "a_t"), add("a", "start"), add("c", "start")])
    given = {"start": spark.range(3)}
    assert plan.run(spark, given) == ["a", "c", "b"] and plan.run(spark, given, wanted="b") == ["a", "b"]
    assert plan.run(spark, given, execute=True, store=str(tmp_path))["b_t"].columns == ["id", "a", "b"]
    plan.gates.append(stages.low_confidence_gate("a_t", "a"))
    with pytest.raises(stages.GateError, match="confidence C or D"):
        plan.run(spark, given, execute=True)
    with pytest.raises(ValueError, match="nothing makes"):
        stages.Pipeline([add("x", "missing")]).order(set())
    assert stages.preflight(("json", "no_such_package")) == ["no_such_package"]


def test_streams(spark, tmp_path):
    from tessera.streaming import incremental

    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2024-01-01 00:10:00', 'a'), (1, TIMESTAMP'2024-01-01 00:20:00', 'a'), (2, TIMESTAMP'2024-01-01 03:00:00', 'b') AS t(id, ts, kind)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = incremental.arrivals(spark, str(tmp_path / "in"), "id int, ts timestamp, kind string")
    for k in range(2):  # a rerun finds nothing new
        incremental.into_table(incremental.first_arrivals(stream, ["id"], "ts"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    counts = incremental.windowed_counts(incremental.arrivals(spark, str(tmp_path / "in"), "id int, ts timestamp, kind string"), "ts", "kind")
    q = counts.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.kind, r.n) for r in spark.table("w").collect()] == [("a", 2)]
