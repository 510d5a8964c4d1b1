"""Source and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import readers as S
from tessera.sources import sinks

from .base import query, table


@query("""SELECT p_brand, country, yr, count(*) AS publication_count FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, p_brand, year(l_shipdate) AS yr, unnest(list_distinct([c_nationkey, s_nationkey])) AS country
   FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2, 3""".replace("SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, p_brand", "SELECT p_brand"))
def src15_country_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15: yearly counts by country, a row once for each distinct country it involves."""
    t = lambda n: table(spark, sf_dir, n)
    c = F.col
    rows = t("lineitem").join(t("part"), c("l_partkey") == c("p_partkey")).join(t("supplier"), c("l_suppkey") == c("s_suppkey")).join(t("orders"), c("l_orderkey") == c("o_orderkey")).join(t("customer"), c("o_custkey") == c("c_custkey"))
    works = rows.select("p_brand", F.year("l_shipdate").alias("yr"), F.array("c_nationkey", "s_nationkey").alias("countries"))
    return S.publication_counts(works, "yr", "countries", ["p_brand"])


@query("SELECT p_partkey, 'https://api.crossref.org/works/' || url_encode('10.1/' || p_name) AS url, substr(sha256('https://api.crossref.org/works/' || url_encode('10.1/' || p_name)), 1, 24) AS cache_key FROM part WHERE NOT contains(p_name, ' ') UNION ALL SELECT p_partkey, 'https://api.crossref.org/works/' || replace(url_encode('10.1/' || p_name), '%20', '+'), substr(sha256('https://api.crossref.org/works/' || replace(url_encode('10.1/' || p_name), '%20', '+')), 1, 24) FROM part WHERE contains(p_name, ' ')")
def src16_lookup_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16, SRC-07: lookup addresses and their cache keys."""
    rows = table(spark, sf_dir, "part").select("p_partkey", S.lookup_url("crossref_doi", F.concat(F.lit("10.1/"), "p_name")).alias("url"))
    return rows.withColumn("cache_key", S.cache_key(F.col("url")))


@query("SELECT to_json({'rows': count(*), 'urgent': count(*) FILTER (WHERE o_orderpriority = '1-URGENT')})::VARCHAR AS summary FROM orders")
def snk03_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03: counters as one JSON row."""
    return sinks.summary(table(spark, sf_dir, "orders"), {"rows": F.count("*"), "urgent": F.count_if(F.col("o_orderpriority") == "1-URGENT")})


@query("SELECT DISTINCT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def str01_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the hourly counts of the stream operator, over the whole table as a batch."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
