"""Files and documents that are larger than a task: records over the borders of splits, lines over the borders of segments, groups that are not opened."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import extract as E
from tessera.plans import registry, text_queries
from tessera.sources import readers
from tessera.sources.paged_text import paged_text
from tessera.sources.split_csv import records, split_csv
from tessera.sources.yearly_counts import write_works, yearly_counts


@pytest.fixture
def small_splits(spark):
    def split(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield split
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def written(rng, rows, end="\n"):
    def field(v):
        return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n\r') or rng.random() < 0.1 else v

    return end.join(",".join(field(v) for v in r) for r in rows)


def values(rng):
    return "".join(rng.choice(["a", "é", ",", '"', "\n", " ", "\\", "x" * 30, '"\n"', "\n\n"]) for _ in range(rng.randrange(7))).strip() or "v"


@pytest.mark.parametrize("seed,size,end", [(1, 37, "\n"), (2, 64, "\n"), (3, 500, "\r\n"), (4, 10**6, "\n")])
def test_records_over_borders_of_splits(spark, tmp_path, small_splits, seed, size, end):
    rng = random.Random(seed)
    names = ["k", "first, name", 'say "x"']
    for part in range(3):
        rows = [[f"{part}-{k}", values(rng), values(rng)] for k in range(rng.choice([0, 1, 60]))]
        (tmp_path / f"{part}.csv").write_bytes(("﻿" * (part == 1) + written(rng, [names, *rows], end) + end * (part % 2)).encode())
    plain = readers.csv(spark, str(tmp_path))
    expected = sorted(map(str, map(tuple, plain.collect())))
    small_splits(size)
    got = split_csv(spark, str(tmp_path), plain.schema)
    assert sorted(map(str, map(tuple, got.collect()))) == expected
    if size < 100 and len(expected) > 50:
        assert records(spark, str(tmp_path)).rdd.getNumPartitions() > 10


def test_a_record_of_many_splits_and_an_open_quote(spark, tmp_path, small_splits):
    long = "line\n" * 400
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{long}"\n2,b\n3,"never closed\n4,c\n')
    small_splits(100)
    got = {r.k: r.v for r in split_csv(spark, str(tmp_path), readers.csv(spark, str(tmp_path), "k string, v string").schema).collect()}
    assert got["1"] == long and got["2"] == "b" and set(got) == {"1", "2", "3"}


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    rows = [f'{k},"text of {k}\nwith ""quotes"" and {"x" * (k % 400)}"' for k in range(40_000)]
    (tmp_path / "a.csv").write_text("k,v\n" + "\n".join(rows))
    small_splits(1 << 20)
    schema = readers.csv(spark, str(tmp_path), "k long, v string").schema
    got = split_csv(spark, str(tmp_path), schema)
    marks = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("k", "v")), F.sum(F.length("v"))).first()
    assert marks(got) == marks(readers.csv(spark, str(tmp_path), schema))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 8 > readers.csv(spark, str(tmp_path), schema).rdd.getNumPartitions()


def plain_chunks(text):
    kept = [(k, " ".join(x.split())) for k, x in enumerate(text.split("\n")) if len(" ".join(x.split())) >= E.LEAST_LINE]
    return [(k, n, " ".join(x for _, x in kept[i : i + n])) for i, (k, _) in enumerate(kept) for n in (1, 2, 3) if i + n <= len(kept)]


def lines_of(rng, n):
    kinds = ["a line that is long enough {}", "short", "", "{}. an item that begins here 1950", "[{}] another item of 1960 with words", "   and a line   that goes on {}"]
    return "\n".join(rng.choice(kinds).format(k) for k in range(n))


@pytest.mark.parametrize("segment", [1, 3, 7, 4096])
def test_windows_of_lines_over_borders_of_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(E, "SEGMENT_LINES", segment)
    rng = random.Random(segment)
    docs = [(k, "x", lines_of(rng, rng.randrange(40))) for k in range(25)] + [(None, "x", lines_of(rng, 9)), (50, None, ""), (51, "x", None)]
    df = spark.createDataFrame(docs, "id int, part string, text string").repartition(3)
    got = sorted((str(r.id), r.line_no, r.size, r.chunk) for r in E.line_chunks(df, ["id", "part"], "text").collect())
    assert got == sorted((str(d), k, n, c) for d, _, text in docs if text for k, n, c in plain_chunks(text))


@pytest.mark.parametrize("segment", [1, 5, 4096])
def test_items_over_borders_of_segments(spark, monkeypatch, segment):
    docs = [(k, lines_of(random.Random(k), 60)) for k in range(12)] + [(None, lines_of(random.Random(99), 20))]
    df = spark.createDataFrame(docs, "id int, text string").repartition(3)
    expected = sorted(map(str, E.numbered_items(df, ["id"], "text").collect()))
    monkeypatch.setattr(E, "SEGMENT_LINES", segment)
    assert sorted(map(str, E.numbered_items(df, ["id"], "text").collect())) == expected and len(expected) > 50


def test_a_document_of_very_many_lines(spark):
    text = "\n".join(f"line number {k} is long enough" for k in range(200_000))
    chunks = E.line_chunks(spark.createDataFrame([(1, text)], "id int, text string"), ["id"], "text")
    sums = {r.size: (r.n, r.c) for r in chunks.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("c")).collect()}
    lengths = [len(x) for x in text.split("\n")]
    assert sums == {n: (200_000 - n + 1, sum(sum(lengths[i : 200_000 - n + 1 + i]) for i in range(n)) + (n - 1) * (200_000 - n + 1)) for n in (1, 2, 3)}


def test_counts_of_groups_that_are_asked_for(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"s{rng.randrange(4)}", rng.choice(["FR", "DE", "a=b/c", None]), rng.choice([1990, 1991, 2000, None])) for _ in range(500)]
    write_works(spark.createDataFrame(rows, "source string, country string, year int"), str(tmp_path / "w"))
    counts = yearly_counts(spark, str(tmp_path / "w"))
    expected = {}
    for r in rows:
        expected[r] = expected.get(r, 0) + 1
    assert {tuple(r)[:3]: r.publication_count for r in counts.collect()} == expected
    # A folder that can't be read does no harm as long as it isn't asked for.
    for f in (tmp_path / "w" / "source=s3").glob("*/*.parquet"):
        f.write_bytes(b"no file of works")
    asked = counts.where(F.col("source").isin("s1", "s2") & (F.col("country") == "a=b/c") & (F.col("year") > 1990) & (F.col("publication_count") > 1))
    assert {tuple(r)[:3]: r.publication_count for r in asked.collect()} == {k: n for k, n in expected.items() if k[0] in ("s1", "s2") and k[1] == "a=b/c" and (k[2] or 0) > 1990 and n > 1}
    plan = asked._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BatchScan")[0]
    assert "publication_count" in above and "s1" not in above and "1990" not in above, plan
    with pytest.raises(Exception):  # noqa: B017
        counts.where("source = 's3'").collect()


def plain_pages(raw):
    return [p.decode("utf-8", "replace") for p in (raw[:-1] if raw.endswith(b"\f") else raw).split(b"\f")] if raw else []


@pytest.mark.parametrize("size", [23, 300, 10**7])
def test_pages_over_borders_of_splits(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    files = {f"{k}.txt": b"".join(rng.choice([b"", b"line\nline\r\n", "é€".encode(), b"x" * 90, b"\xff bad", b"\n"]) + b"\f" for _ in range(rng.randrange(1, 60))) for k in range(5)}
    files |= {"empty.txt": b"", "one.txt": b"no form feed", "blank.txt": b"\f", "open.txt": b"a\f\fb", "zero.txt": b"page\f" * 40 + b"\0" + b"\fpage" * 40}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    small_splits(size)
    got = paged_text(spark, str(tmp_path))
    rows = got.collect()
    expected = {(name, k + 1, t, None) for name, raw in files.items() if b"\0" not in raw for k, t in enumerate(plain_pages(raw))}
    assert {(r.path.rsplit("/", 1)[1], r.page, r.text, r.error) for r in rows} == expected | {("zero.txt", None, None, "not a text file")}
    assert len(rows) == len(expected) + 1


def test_one_paged_file_is_read_by_several_tasks(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr("tessera.sources.paged_text.BROADCAST_SPLITS", 0)  # the join beyond the size that is broadcast
    (tmp_path / "a.txt").write_bytes(b"".join(f"page {k}\nof many\f".encode() for k in range(5000)))
    small_splits(8192)
    pages = paged_text(spark, str(tmp_path))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(k + 1, f"page {k}\nof many") for k in range(5000)]
    assert spark.read.option("lineSep", "\f").text(str(tmp_path)).rdd.getNumPartitions() > 8


def test_prizes_come_in_pages_of_bounded_size(spark, tmp_path):
    """One nation with nearly all customers: pages stay short, and the rows are those of the SQL."""
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"COPY (SELECT c.* REPLACE (c_custkey + k * 1000 AS c_custkey, CASE WHEN c_custkey % 9 > 0 THEN 3 ELSE c_nationkey END AS c_nationkey) FROM '{sf}/customer.parquet' c, range(20) t(k)) TO '{tmp_path}/customer.parquet'")
    duckdb.sql(f"COPY (SELECT * FROM '{sf}/nation.parquet') TO '{tmp_path}/nation.parquet'")
    laureates = text_queries.prize_payloads(spark, str(tmp_path)).select(F.from_json("value", readers.PRIZES)["nobelPrizes"][0]["laureates"].alias("l")).select(F.size("l").alias("n"))
    most, total = laureates.agg(F.max("n"), F.sum("n")).first()
    assert most <= text_queries.PAGE_CUSTOMERS and total == 3000
    got = text_queries.src04_prize_rows(spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("customer", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    result = con.execute(registry.oracle_sql()["src04_prize_rows"])
    columns = [c[0] for c in result.description]
    assert sorted(map(str, result.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
