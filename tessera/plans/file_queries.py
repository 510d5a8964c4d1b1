"""Large delimited files by several tasks, and counts that are asked of where the works are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import sinks
from tessera.sources import readers as S
from tessera.sources.scratch import scratch
from tessera.sources.split_csv import split_csv
from tessera.sources.yearly_counts import write_works, yearly_counts

from .base import query, table

#: Texts with line breaks, quotes, separators and backslashes.
SAID_SQL = """'"' || doc_id || '", she said,' || chr(10) || replace(text, '. ', '."' || chr(10) || '\\')"""


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('", she said,\n'), F.replace("text", F.lit(". "), F.lit('."\n\\')))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("said"), "lang")


@query(f"SELECT doc_id, md5({SAID_SQL}) AS mark, lang FROM documents")
def src01_split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01, SRC-17, SNK-02: whole texts with line breaks in quotes, written as delimited files and read back by as many tasks as the files have splits."""
    path = scratch(spark, "split-csv")
    rows = said(spark, sf_dir)
    sinks.write_csv(rows, path, ["doc_id", "said", "lang"])
    return split_csv(spark, path, rows.schema).select("doc_id", F.md5(F.col("said").cast("binary")).alias("mark"), "lang")


@query(f"SELECT doc_id::VARCHAR AS doc_id, md5({SAID_SQL}) AS mark FROM documents")
def src03_split_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03: the same with tabs; names come from the header."""
    path = scratch(spark, "split-tsv")
    sinks.write_csv(said(spark, sf_dir), path, ["said", "doc_id"], tab=True)
    return split_csv(spark, path, S.csv(spark, path, tab=True).schema, tab=True).select("doc_id", F.md5(F.col("said").cast("binary")).alias("mark"))


@query("""SELECT o_orderpriority AS source, n_name AS country, year(o_orderdate)::INT AS year, count(*) AS publication_count FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority < '3') AND n_nationkey IN (1, 2, 5, 24) AND year(o_orderdate) >= 1994 GROUP BY ALL""")
def src15_pushed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15: yearly counts of two sources and four countries from a year on; the filters go to the data source, other groups are not opened."""
    c = F.col
    nations = table(spark, sf_dir, "nation")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("c_custkey") == c("o_custkey")).join(nations, c("n_nationkey") == c("c_nationkey"))
    path = scratch(spark, "works")
    write_works(orders.select(c("o_orderpriority").alias("source"), c("n_name").alias("country"), F.year("o_orderdate").alias("year")), path)
    # Two of five kinds, four of 25 nations.
    kinds = [r[0] for r in orders.select("o_orderpriority").where("o_orderpriority < '3'").distinct().collect()]
    names = [r[0] for r in nations.where(c("n_nationkey").isin(1, 2, 5, 24)).select("n_name").collect()]
    return yearly_counts(spark, path).where(c("source").isin(kinds) & c("country").isin(names) & (c("year") >= 1994))
