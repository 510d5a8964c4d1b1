"""What is written comes back: files, pages, lookups, audit rows, raw data, streams and staged runs, each through its sink and source."""

from __future__ import annotations

import io
import urllib.error

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources import readers as S
from tessera.sources import sinks
from tessera.sources.paged_text import paged_text
from tessera.sources.scratch import scratch
from tessera.streaming import incremental

from .base import query, table
from .stages import Gate, GateError, Pipeline, Stage, low_confidence_gate, preflight

NOTE_SQL = """CASE c_custkey % 4 WHEN 0 THEN 'say "' || c_name || '", please' WHEN 1 THEN c_name || chr(10) || 'second line' WHEN 2 THEN 'back\\slash, ' || c_name END"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with notes that delimited files must quote."""
    name, kind = F.col("c_name"), F.col("c_custkey") % 4
    note = F.when(kind == 0, F.concat(F.lit('say "'), name, F.lit('", please'))).when(kind == 1, F.concat(name, F.lit("\nsecond line"))).when(kind == 2, F.concat(F.lit("back\\slash, "), name))
    return table(spark, sf_dir, "customer").select("c_custkey", note.alias("note"), "c_nationkey")


@query(f"SELECT c_custkey::VARCHAR AS c_custkey, {NOTE_SQL} AS note, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def src01_csv_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01, SNK-01: delimited files with a byte order mark, read back as strings."""
    path = scratch(spark, "csv")
    sinks.write_csv(notes(spark, sf_dir), path, ["c_custkey", "note", "c_nationkey"], bom=True)
    return S.csv(spark, path).select("c_custkey", "note", "c_nationkey")


@query(f"SELECT c_nationkey, c_custkey, {NOTE_SQL} AS note FROM customer")
def src17_csv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17, SNK-02: delimited files in a given order of fields, read back with types."""
    path = scratch(spark, "csv")
    sinks.write_csv(notes(spark, sf_dir), path, ["c_nationkey", "c_custkey", "note"])
    return S.csv(spark, path, "c_nationkey int, c_custkey long, note string")


@query(f"SELECT c_custkey::VARCHAR AS c_custkey, {NOTE_SQL} AS note FROM customer")
def src03_tab_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03: tab-separated files."""
    path = scratch(spark, "tsv")
    sinks.write_csv(notes(spark, sf_dir), path, ["c_custkey", "note"], tab=True)
    return S.csv(spark, path, tab=True)


@query("SELECT 'missing' AS file, 0::BIGINT AS n UNION ALL SELECT 'present', count(*) FROM nation")
def src02_missing_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02: a missing file is an empty table."""
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "nation"), path, ["n_nationkey", "n_name"])
    counts = [S.csv_or_empty(spark, p, "n_nationkey int, n_name string").agg(F.lit(name).alias("file"), F.count("*").alias("n")) for name, p in (("missing", f"{path}-none"), ("present", path))]
    return counts[0].unionByName(counts[1])


@query("SELECT n_name || ', ' || n_regionkey AS said, n_nationkey FROM nation")
def src11_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11, SNK-06: texts written one file a nation, read back with the file's key from its path."""
    path = scratch(spark, "texts")
    said = F.concat("n_name", F.lit(", "), F.col("n_regionkey").cast("string"))
    table(spark, sf_dir, "nation").select("n_nationkey", said.alias("value")).write.partitionBy("n_nationkey").text(path)
    files = S.documents(spark, [f"{path}/*/*.txt"])
    return files.select(F.rtrim("text", F.lit("\n")).alias("said"), F.regexp_extract("path", r"n_nationkey=(\d+)/", 1).cast("int").alias("n_nationkey"))


def _form_feeds(raw: bytes) -> list[str]:
    if raw.startswith(b"0"):
        raise ValueError("not a document")
    return raw.decode().strip("\n").split("\f")


@query("""SELECT n_nationkey, 1 AS page, n_nationkey || ' ' || n_name AS text, NULL::VARCHAR AS error FROM nation WHERE n_nationkey > 0 UNION ALL SELECT n_nationkey, 2, 'page two', NULL FROM nation WHERE n_nationkey > 0
  UNION ALL SELECT n_nationkey, NULL, NULL, 'not a document' FROM nation WHERE n_nationkey = 0""")
def src12_document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12: pages of files through an extractor; a file that fails is a row with its error."""
    path = scratch(spark, "pages")
    said = F.concat(F.col("n_nationkey").cast("string"), F.lit(" "), "n_name", F.lit("\fpage two"))
    table(spark, sf_dir, "nation").select("n_nationkey", said.alias("value")).write.partitionBy("n_nationkey").text(path)
    pages = S.document_pages(spark, [f"{path}/*/*.txt"], _form_feeds)
    return pages.select(F.regexp_extract("path", r"n_nationkey=(\d+)/", 1).cast("int").alias("n_nationkey"), "page", "text", "error")


#: Documents as pages of files, two hundred ids a file; every fifth file has a zero byte in its first page.
PAGED_SQL = "SELECT doc_id, doc_id // 200 AS file, replace(coalesce(text, ''), chr(12), ' ') AS text FROM documents"


@query(f"""SELECT file, row_number() OVER (PARTITION BY file ORDER BY doc_id)::INT AS page, md5(text) AS mark, length(text) AS n_chars, NULL::VARCHAR AS error FROM ({PAGED_SQL}) WHERE file % 5 <> 4
  UNION ALL SELECT DISTINCT file, NULL, NULL, NULL, 'not a text file' FROM ({PAGED_SQL}) WHERE file % 5 = 4""")
def src12_paged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12: documents written as the pages of large files, and read back page by page; files that are no text are one row each."""
    path = scratch(spark, "paged")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\f"), F.lit(" "))
    paged = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 200).cast("long").alias("file"), text.alias("text"))
    # One shuffle brings a file's documents together, in order.
    first = F.row_number().over(Window.partitionBy("file").orderBy("doc_id")) == 1
    value = F.when(first & (F.col("file") % 5 == 4), F.concat(F.lit("\0"), "text")).otherwise(F.col("text"))
    paged.withColumn("value", value).select("file", "value").write.partitionBy("file").option("lineSep", "\f").text(path)
    pages = paged_text(spark, f"{path}/*/*.txt")
    file = F.regexp_extract("path", r"/file=(-?\d+)/", 1).cast("long").alias("file")
    return pages.select(file, "page", F.md5(F.col("text").cast("binary")).alias("mark"), F.length("text").cast("long").alias("n_chars"), "error")


class _Answer(io.BytesIO):
    status = 200


def _opener(tries: dict[str, int]):
    """Answers by the last digit of an address: 0 is not found, 1 to 4 are busy so many times, the others are there."""

    def opener(url: str, timeout: float) -> _Answer:
        kind, tries[url] = int(url[-1]), tries.get(url, 0) + 1
        if kind == 0:
            raise urllib.error.HTTPError(url, 404, "gone", {}, None)
        if kind <= 4 and tries[url] <= kind:
            raise urllib.error.HTTPError(url, 503, "busy", {"Retry-After": "1"}, None)
        return _Answer(f'{{"tries": {tries[url]}}}'.encode())

    return opener


def _lookup(url: str) -> dict:
    return S.request(url, tries=4, opener=_opener({}), sleep=lambda s: None)


@query("""SELECT 'https://x.example/' || c_custkey AS url, CASE WHEN c_custkey % 10 IN (0, 4) AND c_nationkey > 0 THEN 'http_error' ELSE 'ok' END AS fetch_status, CASE WHEN c_nationkey = 0 THEN 200 WHEN c_custkey % 10 = 0 THEN 404 WHEN c_custkey % 10 = 4 THEN 503 ELSE 200 END AS http_status,
  CASE WHEN c_nationkey = 0 THEN 'cached' WHEN c_custkey % 10 IN (0, 4) THEN NULL WHEN c_custkey % 10 < 4 THEN '{"tries": ' || (c_custkey % 10 + 1) || '}' ELSE '{"tries": 1}' END AS body FROM customer""")
def src05_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05, SRC-06, SRC-09, SRC-10: lookups of four tries each, errors as rows, cached addresses not asked; the answers are made up by the address."""
    url = F.concat(F.lit("https://x.example/"), F.col("c_custkey").cast("string"))
    customers = table(spark, sf_dir, "customer")
    cache = customers.where("c_nationkey = 0").select(url.alias("url"), F.lit("ok").alias("fetch_status"), F.lit(200).alias("http_status"), F.lit("cached").alias("body"), F.lit(None).cast("string").alias("error"))
    asked = customers.select(url.alias("url"))
    return S.fetched(asked.unionByName(asked), cache, _lookup).select("url", "fetch_status", "http_status", "body")


@query("SELECT * FROM (VALUES " + ", ".join(str(r) for r in S.SOURCES) + ") AS t(source, access, use)")
def src18_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18: the declared sources."""
    return S.source_registry(spark)


@query("SELECT * FROM (VALUES ('q1', 'match', 'crossref', 'ok'), ('q2', 'match', 'openalex', 'failed'), ('q1', 'merge', 'crossref', 'ok')) AS t(query_id, phase, source, status)")
def snk04_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04: rows appended to an audit table that the first one makes."""
    path = scratch(spark, "audit")
    for query_id, phase, source, status in (("q1", "match", "crossref", "ok"), ("q2", "match", "openalex", "failed"), ("q1", "merge", "crossref", "ok")):
        sinks.append_audit(spark, path, query_id, phase, source, status=status)
    return spark.read.parquet(path).where("run_at > '2020'").select("query_id", "phase", "source", "status")


@query("SELECT count(*) AS n, sum(length(props))::BIGINT AS chars, bit_xor(hash(props)) IS NOT NULL AS some, min(props) AS least, max(props) AS most FROM events")
def snk06_raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06: raw payloads written as they are, read back."""
    path = scratch(spark, "raw")
    table(spark, sf_dir, "events").select(F.col("props").alias("value")).write.text(path)
    back = spark.read.text(path)
    return back.agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"), (F.count("value") > 0).alias("some"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT event_id, event_type, value FROM events")
def snk05_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05: rows taken over file by file with a checkpoint after each; a run goes on where the last one stopped, and a third finds nothing new."""
    source, target, done = (scratch(spark, n) for n in ("arrivals", "taken", "progress"))
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts")
    for part in (0, 1):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).write.mode("append").parquet(source)
        stream = incremental.arrivals(spark, source, events.schema.simpleString()[7:-1].replace(":", " "), files=4)
        for _ in range(1 + part):
            incremental.into_table(stream, target, done).awaitTermination()
    return spark.read.parquet(target).select("event_id", "event_type", "value")


@query("""SELECT r_name, count(*) AS customers, count(*) FILTER (WHERE c_acctbal < 0) AS owing FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def g01_staged_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-01: three stages in the order of their tables, each kept as a table."""
    c = F.col
    stages = [
        Stage("report", ["placed"], ["report"], lambda s, t: {"report": t["placed"].groupBy("r_name").agg(F.count("*").alias("customers"), F.count_if(c("c_acctbal") < 0).alias("owing"))}),
        Stage("place", ["customer", "areas"], ["placed"], lambda s, t: {"placed": t["customer"].join(t["areas"], c("c_nationkey") == c("n_nationkey")).select("c_custkey", "c_acctbal", "r_name")}),
        Stage("areas", ["nation", "region"], ["areas"], lambda s, t: {"areas": t["nation"].join(t["region"], c("n_regionkey") == c("r_regionkey")).select("n_nationkey", "r_name")}),
    ]
    given = {n: table(spark, sf_dir, n) for n in ("customer", "nation", "region")}
    gate = Gate("placed", "customers without a name of a region", F.count_if(c("r_name").isNull()) == 0)
    return Pipeline(stages, [gate]).run(spark, given, execute=True, store=scratch(spark, "stages"))["report"]


@query("SELECT * FROM (VALUES ('pyspark', true), ('pandas', true), ('pyarrow', true), ('no_such_package', false)) AS t(package, present)")
def g02_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-02: which packages are there."""
    names = ("pyspark", "pandas", "pyarrow", "no_such_package")
    missing = preflight(names)
    return spark.createDataFrame([(n, n not in missing) for n in names], "package string, present boolean")


@query("""SELECT kind, CASE WHEN avg((grade IN ('C', 'D'))::INT) <= 0.2 THEN 'passed' ELSE 'stopped' END AS outcome FROM (
  SELECT 'few' AS kind, CASE WHEN c_custkey % 10 = 0 THEN 'D' ELSE 'A' END AS grade FROM customer UNION ALL SELECT 'many', CASE WHEN c_custkey % 3 = 0 THEN 'C' ELSE 'B' END FROM customer) GROUP BY 1""")
def g03_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-03: a run is stopped where more than a fifth of the rows is of low confidence."""
    customers, key, outcomes = table(spark, sf_dir, "customer"), F.col("c_custkey"), []
    for kind, grade in (("few", F.when(key % 10 == 0, "D").otherwise("A")), ("many", F.when(key % 3 == 0, "C").otherwise("B"))):
        stage = Stage("grade", ["customer"], ["graded"], lambda s, t, grade=grade: {"graded": t["customer"].select(grade.alias("confidence"))})
        try:
            Pipeline([stage], [low_confidence_gate("graded")]).run(spark, {"customer": customers}, execute=True)
            outcomes.append((kind, "passed"))
        except GateError:
            outcomes.append((kind, "stopped"))
    return spark.createDataFrame(outcomes, "kind string, outcome string")
