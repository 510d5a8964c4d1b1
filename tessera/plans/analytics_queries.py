"""Aggregation, window, set and sort queries over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import analytics as A

from .base import query, table

LAGS_SQL = """SELECT o_orderkey, o_custkey, year(o_orderdate) AS yr, (year(o_orderdate) // 10 * 10)::BIGINT || 's' AS decade,
  date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS lag, c_mktsegment
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""


def lags(spark: SparkSession, sf_dir: str, customer: bool = True) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if customer:
        rows = rows.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.withColumn("yr", F.year("o_orderdate")).withColumn("decade", A.decade(F.col("yr"))).withColumn("lag", F.datediff("l_shipdate", "o_orderdate"))


@query(f"SELECT yr, count(*) AS n, count(DISTINCT o_orderkey) AS records, avg(lag) AS mean_lag, median(lag) AS median_lag, min(lag) AS min_lag, max(lag) AS max_lag FROM ({LAGS_SQL}) WHERE lag >= 0 GROUP BY yr")
def a03_lag_stats_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-03, F-05, P-03: lag statistics by year."""
    return A.lag_statistics(lags(spark, sf_dir, customer=False), "yr", "lag", "o_orderkey")


@query(f"""SELECT decade, count(*) AS n, count(DISTINCT o_orderkey) AS records, avg(lag) AS mean_lag, median(lag) AS median_lag, min(lag) AS min_lag, max(lag) AS max_lag,
  quantile_cont(lag, 0.25) AS p25, quantile_cont(lag, 0.75) AS p75 FROM ({LAGS_SQL}) WHERE lag >= 0 GROUP BY decade""")
def a04_lag_stats_by_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-04: the same by decade, with interpolated quartiles."""
    return A.lag_statistics(lags(spark, sf_dir, customer=False), "decade", "lag", "o_orderkey", quartiles=True)


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(f"SELECT yr, {', '.join(f"median(lag) FILTER (WHERE c_mktsegment = '{s}') AS {s.lower()}" for s in SEGMENTS)}, median(lag) AS overall FROM ({LAGS_SQL}) WHERE lag >= 0 GROUP BY yr")
def a05_median_lag_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-05: medians by year and category, with an overall column."""
    cells = [F.median(F.when(F.col("c_mktsegment") == s, F.col("lag"))).alias(s.lower()) for s in SEGMENTS]
    return lags(spark, sf_dir).where("lag >= 0").groupBy("yr").agg(*cells, F.median("lag").alias("overall"))


@query(f"SELECT avg(lag) AS mean_lag, median(lag) AS median_lag, max(lag) AS max_lag FROM ({LAGS_SQL})")
def a06_overall_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-06: mean, median and maximum of all lags, negative ones included."""
    return lags(spark, sf_dir, customer=False).agg(F.avg("lag").alias("mean_lag"), F.median("lag").alias("median_lag"), F.max("lag").alias("max_lag"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a01_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-01, SNK-03: frequencies of a column."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2")
def a02_composite_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-02: frequencies of a pair of columns."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def a07_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-07: exact distinct counts."""
    return table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


BRANDS_SQL = "SELECT p_brand, l_orderkey, l_suppkey, (l_orderkey * 10000000 + l_partkey * 1000 + l_linenumber) AS seq FROM lineitem JOIN part ON l_partkey = p_partkey"


def brand_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select("p_brand", "l_orderkey", "l_suppkey", (F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("seq"))


@query(f"""SELECT p_brand, arg_max(l_suppkey, (n, -place)) AS supplier FROM (SELECT p_brand, l_suppkey, count(*) AS n, min(seq) AS place FROM ({BRANDS_SQL}) GROUP BY 1, 2) GROUP BY 1""")
def a08_mode_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-08: the most frequent supplier of each brand, ties to the one met first."""
    return A.mode_first(brand_lines(spark, sf_dir).withColumn("supplier", F.col("l_suppkey")), ["p_brand"], "supplier", "seq")


@query("""SELECT user_id, string_agg(event_type, ' || ' ORDER BY place) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS place FROM events GROUP BY 1, 2) GROUP BY 1""")
def a09_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-09: distinct event types of each user in order of appearance, joined."""
    return A.ordered_lists(table(spark, sf_dir, "events"), ["user_id"], ["event_type"], "event_id").select("user_id", F.array_join("event_type", " || ").alias("kinds"))


@query("""SELECT o_custkey, arg_min(o_orderpriority, seq) FILTER (WHERE o_orderpriority <> '1-URGENT') AS priority, arg_min(o_orderstatus, seq) AS status
  FROM (SELECT *, o_orderkey AS seq FROM orders) GROUP BY 1""")
def a10_first_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-10: first non-blank value of each customer in row order (urgent priorities count as blank here)."""
    rows = table(spark, sf_dir, "orders").withColumn("priority", F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.col("o_orderpriority")))
    return rows.groupBy("o_custkey").agg(A.first_filled("priority", "o_orderkey").alias("priority"), A.first_filled("o_orderstatus", "o_orderkey").alias("status"))


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_f, bool_or(o_orderpriority = '1-URGENT') AS any_urgent FROM orders GROUP BY 1")
def a11_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-11: whether any row of a group has a property."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def a12_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-12: counts under conditions."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""SELECT items, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM
  (SELECT o_orderkey, count(DISTINCT l_partkey) AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY 1""")
def a13_count_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-13: orders by their number of distinct parts, those without lines included."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return A.count_of_counts(table(spark, sf_dir, "orders"), lines, "o_orderkey", "l_partkey")


@query("""SELECT unnest(['rows', 'orders', 'parts']) AS metric, unnest([rows, orders, parts]) AS value FROM
  (SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem)""")
def a14_long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-14: metrics of one pass as rows."""
    wide = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("rows"), F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"))
    return wide.unpivot([], ["rows", "orders", "parts"], "metric", "value")


NATION_MONTHS_SQL = "SELECT c_nationkey, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS orders, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"


@query(f"""SELECT n_nationkey AS nation, m::DATE AS month, coalesce(orders, 0) AS orders FROM nation, generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH) AS g(m)
  LEFT JOIN ({NATION_MONTHS_SQL}) f ON f.c_nationkey = n_nationkey AND f.month = m::DATE""")
def j17_nation_month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-17: a dense panel of nations and months, zero where there are no orders."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    facts = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("orders"))
    months = F.explode(F.expr("sequence(DATE'1995-01-01', DATE'2001-08-01', INTERVAL 1 MONTH)"))
    return A.panel(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), months.alias("month")), facts, ["nation", "month"], ["orders"])


@query("""SELECT n_regionkey AS region, y::INT AS yr, coalesce(sum(k), 0)::BIGINT AS n FROM nation, generate_series(1995, 2002) AS g(y)
  LEFT JOIN (SELECT c_nationkey, year(o_orderdate) AS oy, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) ON c_nationkey = n_nationkey AND oy = y GROUP BY 1, 2""")
def a15_zero_filled_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-15: sums by region and year over the dense panel."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    facts = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"))
    spine = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"), F.explode(F.sequence(F.lit(1995), F.lit(2002))).alias("yr"))
    return A.panel(spine, facts, ["c_nationkey", "yr"], ["n"]).groupBy("region", "yr").agg(F.sum("n").alias("n"))


@query("""SELECT p_brand, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(l_partkey) AS sold,
  CASE WHEN count(l_partkey) <> 0 THEN count(*) FILTER (WHERE l_returnflag = 'R') / count(l_partkey) ELSE 0.0 END AS share,
  CASE WHEN count(l_partkey) <> 0 THEN 1000000.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(l_partkey) ELSE 0.0 END AS per_million
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def a16_guarded_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-16: shares that are 0 where nothing is below the line."""
    rows = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left")
    sums = rows.groupBy("p_brand").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count("l_partkey").alias("sold"))
    return sums.withColumn("share", A.guarded_ratio(F.col("returned"), F.col("sold"))).withColumn("per_million", A.guarded_ratio(F.col("returned") * 1000000.0, F.col("sold")))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(f"SELECT year(o_orderdate) AS yr, {', '.join(f"count(*) FILTER (WHERE o_orderpriority = '{p}') AS p{p[0]}" for p in PRIORITIES)} FROM orders GROUP BY 1")
def a17_pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-17: a pivot with its column values given."""
    wide = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("yr")).pivot("o_orderpriority", list(PRIORITIES)).agg(F.count("o_orderkey"))
    return wide.select("yr", *[F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(f"p{p[0]}") for p in PRIORITIES])


@query(f"SELECT decade, {', '.join(f"avg(lag) FILTER (WHERE c_mktsegment = '{s}') AS {s.lower()}" for s in SEGMENTS)} FROM ({LAGS_SQL}) GROUP BY 1")
def a17_pivot_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-17: mean lag by decade and category as a pivot."""
    wide = lags(spark, sf_dir).groupBy("decade").pivot("c_mktsegment", list(SEGMENTS)).agg(F.avg("lag"))
    return wide.select("decade", *[F.col(s).alias(s.lower()) for s in SEGMENTS])


@query("""SELECT (y // 10 * 10)::BIGINT || 's' AS decade, sum(n)::BIGINT AS n, CASE WHEN y // 10 * 10 = 2000 THEN 'partial' ELSE '' END AS note FROM
  (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1, 3""")
def a18_decade_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-18: annual counts rolled up to decades, the unfinished one marked."""
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    note = F.when(F.floor(F.col("y") / 10) * 10 == 2000, "partial").otherwise("").alias("note")
    return years.groupBy(A.decade(F.col("y")).alias("decade"), note).agg(F.sum("n").alias("n"))


@query(f"""WITH lines AS ({BRANDS_SQL}), top AS (SELECT p_brand FROM (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, lower(p_brand)) AS rank FROM lines GROUP BY 1) WHERE rank <= 20),
  both_sums AS (SELECT l_suppkey, count(*) AS everything, count(*) FILTER (WHERE p_brand IN (SELECT p_brand FROM top)) AS of_top FROM lines GROUP BY 1)
  SELECT l_suppkey, of_top, everything, of_top / everything AS share FROM both_sums""")
def a19_top_subset_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-19, F-06: what the twenty first brands make up of each supplier's lines."""
    lines = brand_lines(spark, sf_dir)
    top = A.ranked(lines.groupBy("p_brand").agg(F.count("*").alias("n")), "n", "p_brand").where("rank <= 20").select("p_brand", F.lit(1).alias("top"))
    sums = lines.join(top, "p_brand", "left").groupBy("l_suppkey").agg(F.count("top").alias("of_top"), F.count("*").alias("everything"))
    return sums.withColumn("share", A.guarded_ratio(F.col("of_top"), F.col("everything")))


@query("""SELECT decade, count(*) AS parts, count(*) FILTER (WHERE flag = 'R') AS first_returned FROM (SELECT DISTINCT ON (l_partkey) l_partkey, (year(l_shipdate) // 10 * 10)::BIGINT || 's' AS decade, l_returnflag AS flag
  FROM lineitem ORDER BY l_partkey, l_shipdate, l_orderkey, l_linenumber, l_returnflag) GROUP BY 1""")
def a20_unique_by_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-20, W-09: each part once, by the decade of its first line; all, and those of one kind."""
    first = A.first_wins(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag"])
    return first.groupBy(A.decade(F.year("l_shipdate")).alias("decade")).agg(F.count("*").alias("parts"), F.count_if(F.col("l_returnflag") == "R").alias("first_returned"))


@query("SELECT min(strftime(o_orderdate, '%Y')) AS first_year, max(strftime(o_orderdate, '%Y')) AS last_year FROM orders")
def a21_text_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-21: extremes of years kept as text."""
    year = F.date_format("o_orderdate", "yyyy")
    return table(spark, sf_dir, "orders").agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"))


@query("SELECT count(*) AS baseline, count(*) FILTER (WHERE n > 0) AS covered, avg((n > 0)::INT) AS rate FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def a22_coverage_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-22: the share of baseline rows with a candidate."""
    per = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return per.agg(F.count("*").alias("baseline"), F.count_if(F.col("n") > 0).alias("covered"), F.avg((F.col("n") > 0).cast("int")).alias("rate"))


@query("SELECT o_custkey, array_to_string(list(substr(o_orderpriority, 1, 6) ORDER BY o_orderkey)[1:4], '; ') AS listed FROM orders GROUP BY 1")
def a23_capped_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-23: the first four clipped values of each group, joined."""
    first = A.first_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 6).alias("p")), ["o_custkey"], ["o_orderkey"], 4)
    pairs = F.array_sort(F.collect_list(F.struct("place", "p")))
    return first.groupBy("o_custkey").agg(F.array_join(F.transform(pairs, lambda p: p["p"]), "; ").alias("listed"))


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '; ') AS statuses FROM orders GROUP BY 1")
def a24_status_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-24: the sorted set of a group's statuses, joined."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "; ").alias("statuses"))


@query("SELECT 'CUST_' || lpad((row_number() OVER (ORDER BY c_nationkey, c_mktsegment, c_custkey))::VARCHAR, 6, '0') AS record_id, c_custkey FROM customer")
def w01_surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-01, O-01: ids by sorted position."""
    return A.surrogate_ids(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment", "c_custkey"], "CUST_", "record_id").select("record_id", "c_custkey")


@query(f"SELECT row_number() OVER (ORDER BY n DESC, lower(p_brand)) AS rank, p_brand, n, orders FROM (SELECT p_brand, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM ({BRANDS_SQL}) GROUP BY 1) ORDER BY rank LIMIT 10")
def w02_top_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-02, O-08: the ten first groups by count, then name."""
    counts = brand_lines(spark, sf_dir).groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"))
    return A.ranked(counts, "n", "p_brand").where("rank <= 10")


@query("""WITH lines AS (SELECT s_name, o_custkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey),
  counts AS (SELECT s_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lower(s_name)) AS rank FROM lines GROUP BY 1),
  firsts AS (SELECT rank, count(*) AS k FROM (SELECT o_custkey, min(rank) AS rank FROM lines JOIN counts USING (s_name) GROUP BY 1) GROUP BY 1),
  cum AS (SELECT c.rank, s_name, n, sum(n) OVER (ORDER BY c.rank)::BIGINT AS cumulative_rows, (sum(coalesce(k, 0)) OVER (ORDER BY c.rank))::BIGINT AS cumulative_records,
    sum(n) OVER (ORDER BY c.rank) / sum(n) OVER () AS cumulative_share FROM counts c LEFT JOIN firsts f ON f.rank = c.rank)
  SELECT *, coalesce(rank <= (SELECT min(rank) FROM cum WHERE cumulative_share >= 0.9), true) AS in_threshold FROM cum""")
def w03_cumulative_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-03, W-04, W-05: suppliers by rank, with cumulative lines, share and distinct customers, and those needed for 90 %."""
    orders, suppliers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    lines = table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return A.coverage(lines.select("s_name", "o_custkey"), "s_name", "o_custkey")


@query("""WITH lines AS (SELECT year(o_orderdate) AS yr, p_type, p_brand, (o_orderkey * 10000000 + l_partkey * 1000 + l_linenumber) AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
  c AS (SELECT yr, p_brand, count(*) AS n, min(seq) AS place FROM lines GROUP BY 1, 2)
  SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY n DESC, place) AS rank, sum(n) OVER (PARTITION BY yr ORDER BY n DESC, place ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY yr) AS cumulative_share FROM c) WHERE rank <= 15""")
def w06_top_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-06: the fifteen first brands of each year, ties by first appearance."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.select(F.year("o_orderdate").alias("yr"), "p_brand", (F.col("o_orderkey") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("seq"))
    return A.top_by_period(rows, "yr", "p_brand", "seq")


@query("""WITH daily AS (SELECT event_type, d::DATE AS day, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM events), generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) AS g(d)
    LEFT JOIN (SELECT event_type AS t, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2) f ON f.t = event_type AND f.day = d::DATE),
  thresholds AS (SELECT unnest([10, 65, 70]) AS threshold),
  means AS (SELECT *, avg(n) OVER w AS mean, count(*) OVER w AS k FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  SELECT event_type, threshold, min(day) FILTER (WHERE k = 5 AND mean >= threshold) AS first_year FROM means, thresholds GROUP BY 1, 2""")
def w07_trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-07: the first day whose trailing five-day mean reaches each threshold, by event type."""
    events = table(spark, sf_dir, "events")
    days = F.explode(F.expr("sequence(DATE'2024-01-01', DATE'2024-01-30', INTERVAL 1 DAY)"))
    spine = events.select("event_type").distinct().withColumn("day", days).withColumn("threshold", F.explode(F.array(F.lit(10), F.lit(65), F.lit(70))))
    facts = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return A.first_year_reaching(A.panel(spine, facts, ["event_type", "day"], ["n"]), ["event_type", "threshold"], "day", "n", "threshold")


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders) WHERE nth = 1".replace("SELECT * FROM", "SELECT o_custkey, o_orderkey, o_orderpriority FROM"))
def w09_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-09: the first order of each customer."""
    return A.first_wins(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""SELECT c_mktsegment, band, c_custkey FROM (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY c_mktsegment, band) AS n
    FROM (SELECT *, CASE WHEN c_acctbal < 2000 THEN 'low' WHEN c_acctbal < 6000 THEN 'middle' ELSE 'high' END AS band FROM customer) WINDOW w AS (PARTITION BY c_mktsegment, band ORDER BY c_custkey))
  WHERE list_contains(list_transform(range(0, 5), lambda i: round_even(i * (n - 1) / 4, 0)::BIGINT), place)""")
def w13_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-13: five evenly spaced customers of each segment and balance band."""
    band = F.when(F.col("c_acctbal") < 2000, "low").when(F.col("c_acctbal") < 6000, "middle").otherwise("high")
    return A.evenly_spaced(table(spark, sf_dir, "customer").withColumn("band", band), ["c_mktsegment", "band"], ["c_custkey"], 5).select("c_mktsegment", "band", "c_custkey")


@query("""WITH s AS (SELECT year(l_shipdate) AS yr, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT year(o_orderdate) AS yr, count(*) AS n FROM orders GROUP BY 1)
  SELECT y::INT AS yr, coalesce(o.n, 0) AS ordered, coalesce(s.n, 0) AS shipped FROM generate_series(1994, 2003) AS g(y) LEFT JOIN o ON o.yr = y LEFT JOIN s ON s.yr = y""")
def j19_two_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-19: two annual series on one spine."""
    spine = spark.range(1994, 2004).select(F.col("id").cast("int").alias("yr"))
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("yr")).agg(F.count("*").alias("shipped"))
    ordered = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("ordered"))
    return spine.join(ordered, "yr", "left").join(shipped, "yr", "left").fillna(0).select("yr", "ordered", "shipped")


@query(f"""WITH lagged AS (SELECT yr, median(lag) AS mid FROM ({LAGS_SQL}) WHERE lag >= 0 GROUP BY 1), share AS (SELECT year(o_orderdate) AS yr, avg((o_orderstatus = 'F')::INT) AS share FROM orders GROUP BY 1)
  SELECT l.yr, l.mid AS lag_days, floor(l.yr - l.mid / 365)::INT AS source_year, s.share AS source_share FROM lagged l LEFT JOIN share s ON s.yr = floor(l.yr - l.mid / 365)::INT""")
def j18_lag_shifted_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-18: a series looked up at the year that the median lag points back to."""
    mid = lags(spark, sf_dir, customer=False).where("lag >= 0").groupBy("yr").agg(F.median("lag").alias("lag_days"))
    share = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("source_year")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("source_share"))
    return mid.withColumn("source_year", F.floor(F.col("yr") - F.col("lag_days") / 365).cast("int")).join(share, "source_year", "left").select("yr", "lag_days", "source_year", "source_share")


@query(f"""SELECT CASE WHEN yr < 1996 THEN 'early' WHEN yr < 1999 THEN 'middle' ELSE 'late' END AS period, regr_slope(mean, yr) AS slope, regr_intercept(mean, yr) AS intercept
  FROM (SELECT yr, avg(lag) AS mean FROM ({LAGS_SQL}) GROUP BY 1) GROUP BY 1 HAVING count(*) > 1""")
def snk10_trend_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10: the linear trend behind a chart, by period."""
    means = lags(spark, sf_dir, customer=False).groupBy("yr").agg(F.avg("lag").alias("mean"))
    period = F.when(F.col("yr") < 1996, "early").when(F.col("yr") < 1999, "middle").otherwise("late").alias("period")
    return means.groupBy(period).agg(F.regr_slope("mean", "yr").alias("slope"), F.regr_intercept("mean", "yr").alias("intercept"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("""SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_custkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE strftime(o_orderdate, '%Y') END, lower(o_orderstatus), o_orderkey) AS place FROM orders QUALIFY place BETWEEN 101 AND 300""")
def f11_review_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-11: rows 101 to 300 of a review queue (an offset and a limit); blank years sort first, as text. o03_review_order has all."""
    year = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.date_format("o_orderdate", "yyyy"))
    first = table(spark, sf_dir, "orders").withColumn("_year", year).orderBy("o_orderpriority", "o_custkey", "_year", F.lower("o_orderstatus"), "o_orderkey").limit(300)
    order = Window.orderBy("o_orderpriority", "o_custkey", "_year", F.lower("o_orderstatus"), "o_orderkey")
    return first.withColumn("place", F.row_number().over(order)).where("place > 100").select("o_orderkey", "o_orderpriority", "place")


@query("""SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_custkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE strftime(o_orderdate, '%Y') END, lower(o_orderstatus), o_orderkey) AS place FROM orders""")
def o03_review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-03, O-04, O-06: every row of a review queue with its place; blank years sort first, as text. Places come from sorted ranges, so that no priority or customer is one task."""
    year = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.date_format("o_orderdate", "yyyy"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", year.alias("_year"), F.lower("o_orderstatus").alias("_status"))
    return A.placed(rows, [], ["o_orderpriority", "o_custkey", "_year", "_status", "o_orderkey"]).select("o_orderkey", "o_orderpriority", (F.col("_at") + 1).alias("place"))


@query(f"SELECT decade, row_number() OVER (ORDER BY substr(decade, 1, 4)::INT) AS place FROM (SELECT DISTINCT decade FROM ({LAGS_SQL}))")
def o07_decade_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-07: decade labels by their year."""
    labels = lags(spark, sf_dir, customer=False).select("decade").distinct()
    return labels.withColumn("place", F.row_number().over(Window.orderBy(F.substring("decade", 1, 4).cast("int"))))


@query("SELECT o_custkey AS id FROM orders UNION ALL SELECT c_custkey FROM customer")
def u01_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-01, SRC-13: rows of several inputs."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def u02_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-02, J-06: ids without candidates."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 AND o_orderstatus <> 'P' THEN 'main' ELSE 'excluded' END AS side FROM orders")
def u05_partition_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-05: one table split into two by a rule."""
    rows = table(spark, sf_dir, "orders")
    main = (F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") != "P")
    return rows.where(main).select("o_orderkey", F.lit("main").alias("side")).unionByName(rows.where(~main).select("o_orderkey", F.lit("excluded").alias("side")))
