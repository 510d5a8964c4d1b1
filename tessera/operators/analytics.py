"""Aggregates and ordered analytics that do not depend on row order by accident: wherever the first row counts, an ordinal column says which it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.scratch import scratch


def lag_statistics(rows: DataFrame, group: str, lag: str, record: str, quartiles: bool = False) -> DataFrame:
    """Rows, distinct records, mean, median, extremes and, if asked, linearly interpolated quartiles of the valid lags (not negative) of each group."""
    aggs = [F.count("*").alias("n"), F.countDistinct(record).alias("records"), F.avg(lag).alias("mean_lag"), F.median(lag).alias("median_lag"), F.min(lag).alias("min_lag"), F.max(lag).alias("max_lag")]
    if quartiles:
        aggs += [F.percentile(lag, 0.25).alias("p25"), F.percentile(lag, 0.75).alias("p75")]
    return rows.where(F.col(lag) >= 0).groupBy(group).agg(*aggs)


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def award_period(year: Column) -> Column:
    """Four periods, cut at 1940, 1970 and 2000."""
    return F.when(year < 1940, "before 1940").when(year < 1970, "1940-1969").when(year < 2000, "1970-1999").otherwise("2000 on")


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0 or missing."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def ranked(groups: DataFrame, count: str, name: str) -> DataFrame:
    """Unique ranks by falling count, then by name in lower case. One row a group: the window is over groups, not rows."""
    return groups.withColumn("rank", F.row_number().over(Window.orderBy(F.col(count).desc(), F.lower(name), name)))


def mode_first(rows: DataFrame, group: list[str], value: str, ordinal: str) -> DataFrame:
    """The most frequent non-blank value of each group; of equals, the one met first."""
    counts = rows.where(F.trim(value) != "").groupBy(*group, value).agg(F.count("*").alias("_n"), F.min(ordinal).alias("_at"))
    return counts.groupBy(*group).agg(F.max_by(value, F.struct("_n", (-F.col("_at")).alias("_at"))).alias(value))


def ordered_lists(rows: DataFrame, key: list[str], values: list[str], ordinal: str) -> DataFrame:
    """Distinct non-blank values of each column and key, in the order of their first appearance; keys without any have empty lists.

    First the least ordinal of every distinct (key, column, value), then lists of these: a key with many rows and few values is summed up where its rows are,
    and what is gathered for a key is its distinct values."""
    fields = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.when(F.trim(v) != "", F.col(v)).cast("string").alias("value")) for k, v in enumerate(values)]))
    each = rows.select(*key, F.col(ordinal).alias("_at"), fields.alias("_f")).select(*key, "_at", F.col("_f.field").alias("_field"), F.col("_f.value").alias("_value"))
    firsts = each.groupBy(*key, "_field", "_value").agg(F.min("_at").alias("_at"))
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when((F.col("_field") == k) & F.col("_value").isNotNull(), F.struct("_at", "_value")))), lambda p: p["_value"])
    return firsts.groupBy(*key).agg(*[listed(k).alias(v) for k, v in enumerate(values)])


def first_rows(rows: DataFrame, key: list[str], order: list[str | Column], k: int) -> DataFrame:
    """The first k rows of each key by an order, with their place from 1. Spark keeps k rows of a key in each task before the shuffle (WindowGroupLimit)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= k)


def first_filled(value: str, ordinal: str) -> Column:
    """The first non-blank value of a group."""
    filled = F.when(F.trim(value) != "", F.col(value))
    return F.min_by(filled, F.when(filled.isNotNull(), F.col(ordinal)))


def coverage(rows: DataFrame, group: str, record: str, threshold: float = 0.9) -> DataFrame:
    """Groups by rank with cumulative rows, share and distinct records, and whether the group is needed to reach the threshold (all are, if it is never reached)."""
    counts = ranked(rows.groupBy(group).agg(F.count("*").alias("n")), "n", group)
    first = rows.join(counts.select(group, "rank"), group).groupBy(record).agg(F.min("rank").alias("rank")).groupBy("rank").agg(F.count("*").alias("new_records"))
    up_to = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    out = counts.join(first, "rank", "left").withColumn("cumulative_rows", F.sum("n").over(up_to)).withColumn("cumulative_records", F.sum(F.coalesce("new_records", F.lit(0))).over(up_to))
    out = out.withColumn("cumulative_share", F.col("cumulative_rows") / F.sum("n").over(every))
    last = F.min(F.when(F.col("cumulative_share") >= threshold, F.col("rank"))).over(every)
    return out.withColumn("in_threshold", F.coalesce(F.col("rank") <= last, F.lit(True))).drop("new_records")


def top_by_period(rows: DataFrame, period: str, group: str, ordinal: str, k: int = 15) -> DataFrame:
    """The k most frequent groups of each period, ties by first appearance, with the share of the period's rows so far."""
    counts = rows.groupBy(period, group).agg(F.count("*").alias("n"), F.min(ordinal).alias("_at"))
    order = Window.partitionBy(period).orderBy(F.col("n").desc(), "_at")
    share = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy(period))
    return counts.withColumn("rank", F.row_number().over(order)).withColumn("cumulative_share", share).where(F.col("rank") <= k).drop("_at")


def count_of_counts(baseline: DataFrame, links: DataFrame, key: str, item: str) -> DataFrame:
    """How many baseline rows have 0, 1, 2, ... distinct items, with shares."""
    per = baseline.select(key).join(links.select(key, item), key, "left").groupBy(key).agg(F.countDistinct(item).alias("items"))
    return per.groupBy("items").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def first_wins(rows: DataFrame, key: list[str], ordinal: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*ordinal))).where("_nth = 1").drop("_nth")


def first_year_reaching(series: DataFrame, group: list[str], year: str, share: str, threshold: str, width: int = 5) -> DataFrame:
    """The first year whose trailing mean over width years reaches a threshold column."""
    trail = Window.partitionBy(*group).orderBy(year).rowsBetween(1 - width, 0)
    means = series.withColumn("_mean", F.avg(share).over(trail)).withColumn("_rows", F.count("*").over(trail))
    return means.groupBy(*group).agg(F.min(F.when((F.col("_rows") == width) & (F.col("_mean") >= F.col(threshold)), F.col(year))).alias("first_year"))


def panel(spine: DataFrame, facts: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Facts on a dense spine (made by exploding literal sets and sequences), zero where there are none."""
    return spine.join(facts, keys, "left").fillna(0, measures)


def placed(rows: DataFrame, strata: list[str], order: list[str | Column]) -> DataFrame:
    """Adds _at, the position of a row in its stratum (from 0), and _n, the rows of the stratum. Rows are sorted by ranges, and a range goes on from
    the counts of those before it, so that no stratum, however large, is one task; only counts by range and stratum are ranked."""
    path = scratch(rows.sparkSession, "ranges")
    rows.repartitionByRange(*strata, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = rows.sparkSession.read.parquet(path)
    keys = [F.col(c).alias(f"_{k}") for k, c in enumerate(strata)]
    names = [f"_{k}" for k in range(len(strata))]
    sums = ranged.groupBy(*keys, F.col("_range").alias("_of")).agg(F.count("*").alias("_rows"))
    within = Window.partitionBy(*names)
    before = F.coalesce(F.sum("_rows").over(within.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*names, "_of", before.alias("_before"), F.sum("_rows").over(within).alias("_n"))
    numbered = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_range", *strata).orderBy(*order)))
    same = F.col("_range") == F.col("_of")
    for c, name in zip(strata, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(name))
    return numbered.join(offsets, same).withColumn("_at", F.col("_before") + F.col("_nth") - 1).drop("_range", "_of", "_nth", "_before", *names)


def evenly_spaced(rows: DataFrame, strata: list[str], order: list[str], k: int) -> DataFrame:
    """k rows of each stratum at even distances (ends included), half positions to the even row; the middle row if k is 1.

    A stratum with fewer than k rows stops the run. With at least k rows two positions never meet."""
    counted = placed(rows, strata, order)
    enough = F.when(F.col("_n") < k, F.raise_error(F.concat(F.lit(f"not enough rows to sample {k}: only "), F.col("_n").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    if k == 1:
        picked = F.array(F.floor(F.col("_n") / 2).cast("long"))
    else:
        picked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (k - 1)).cast("long"))
    return counted.where(enough & F.array_contains(picked, F.col("_at").cast("long"))).drop("_at", "_n")


def surrogate_ids(rows: DataFrame, order: list[str], prefix: str, name: str) -> DataFrame:
    """Ids by sorted position."""
    return placed(rows, [], order).withColumn(name, F.format_string(prefix + "%06d", F.col("_at") + 1)).drop("_at", "_n")
