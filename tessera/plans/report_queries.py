"""Reports for people: workbooks, documents and Markdown, written and read again. Their tables are aggregates, of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import sinks
from tessera.sources.scratch import get, put, scratch

from .base import query, table


def by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.min("c_custkey").alias("first")).orderBy("c_mktsegment")


@query("""SELECT 'nations' AS sheet, n AS row, list_value(a, b) AS cells FROM (SELECT 0 AS n, 'n_nationkey' AS a, 'n_name' AS b UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey), n_nationkey::VARCHAR, n_name FROM nation)
  UNION ALL SELECT 'segments & counts', n, list_value(a, b, c) FROM (SELECT 0 AS n, 'c_mktsegment' AS a, 'customers' AS b, 'first' AS c UNION ALL SELECT row_number() OVER (ORDER BY c_mktsegment), c_mktsegment, count(*)::VARCHAR, min(c_custkey)::VARCHAR FROM customer GROUP BY c_mktsegment)""")
def snk08_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-08, SNK-13: report tables as sheets of a workbook, read again cell by cell."""
    path = scratch(spark, "report") + ".xlsx"
    put(spark, path, sinks.workbook({"nations": table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), "segments & counts": by_segment(spark, sf_dir)}))
    return spark.createDataFrame(sinks.sheet_rows(get(spark, path)), "sheet string, row long, cells array<string>")


@query("""SELECT n, said FROM (SELECT 0 AS n, 'Customers < & >' AS said UNION ALL SELECT row_number() OVER (ORDER BY c_mktsegment), c_mktsegment || ': ' || count(*) || ' customers, the first is ' || min(c_custkey) FROM customer GROUP BY c_mktsegment)""")
def snk11_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-11: a document with a heading and one paragraph a segment, read again."""
    path = scratch(spark, "report") + ".docx"
    rows = sinks.report_rows(by_segment(spark, sf_dir), 1000)
    put(spark, path, sinks.document("Customers < & >", [f"{name}: {n} customers, the first is {first}" for name, n, first in rows]))
    return spark.createDataFrame(list(enumerate(sinks.document_paragraphs(get(spark, path)))), "n long, said string")


@query("""SELECT '# Customers' || chr(10) || chr(10) || '- customers: ' || (SELECT count(*) FROM customer) || chr(10) || '- segments: ' || count(*) || chr(10) || chr(10) || '## By segment' || chr(10) || chr(10) || '| c_mktsegment | customers | first |' || chr(10) || '|---|---|---|' || chr(10)
  || string_agg('| ' || c_mktsegment || ' | ' || n || ' | ' || first || ' |', chr(10) ORDER BY c_mktsegment) || chr(10) AS report FROM (SELECT c_mktsegment, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1)""")
def snk12_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12: a Markdown report with metrics and a table, read again."""
    path, segments = scratch(spark, "report") + ".md", by_segment(spark, sf_dir)
    metrics = segments.agg(F.sum("customers").alias("customers"), F.count("*").alias("segments")).first().asDict()
    put(spark, path, sinks.markdown("Customers", metrics, {"By segment": segments}).encode())
    return spark.createDataFrame([(get(spark, path).decode(),)], "report string")


@query("SELECT nth - 1 AS bar, n * 200 // max(n) OVER () AS height FROM (SELECT row_number() OVER (ORDER BY year(o_orderdate)) AS nth, count(*) AS n FROM orders GROUP BY year(o_orderdate))")
def snk10_figure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10: orders by year as a bar chart, its bars read off the image."""
    path = scratch(spark, "figure") + ".png"
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n")).orderBy("yr")
    put(spark, path, sinks.bar_chart([n for _, n in sinks.report_rows(years, 1000)]))
    return spark.createDataFrame(list(enumerate(sinks.bar_heights(get(spark, path)))), "bar long, height long")


@query("SELECT * FROM (VALUES (1, true, 5), (2, false, 5), (3, true, 9)) AS t(attempt, copied, size)")
def snk07_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07: a file is copied where it is missing or its size differs."""
    source, target = scratch(spark, "source"), scratch(spark, "target")
    out = []
    for attempt, body in enumerate((b"first", b"other", b"nine more"), 1):
        put(spark, source, body)
        out.append((attempt, sinks.copy_between(spark, source, target), len(get(spark, target))))
    return spark.createDataFrame(out, "attempt int, copied boolean, size int")
