"""Positions inside a key, and running totals along them, without a task that holds a whole key.

placed() sorts by ranges, so a key of any size, and any number of equal rows, is dealt over many tasks; running() adds up inside
segments of bounded length and carries each segment's total on. What is joined back is one row a key and range, or a key and segment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Rows of a segment that are added up in one window.
SEGMENT = 4096
#: monotonically_increasing_id() counts the rows of a partition in its lower bits.
ROW_BITS = 33


def placed(rows: DataFrame, key: str, order: list[Column], kept: list[str], label: str) -> DataFrame:
    """The kept columns with `place`, each row's position in its key from 0, by the order columns; equal rows stand in any order.

    Nulls are not looked for in the key: it must have none. The scan's row number comes last in the order, so that equal rows can be split."""
    ordered = rows.withColumn("_scan", F.monotonically_increasing_id())
    by = [F.col(key), *order, F.col("_scan")]
    at = F.monotonically_increasing_id()
    ranged = stored(ordered.repartitionByRange(*by).sortWithinPartitions(*by).select(*dict.fromkeys([key, *kept])).withColumn("_at", at), label)
    ranged = ranged.withColumn("_range", F.shiftright("_at", ROW_BITS))
    counts = ranged.groupBy(F.col(key).alias("_of"), F.col("_range").alias("_in")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_of").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("_of", "_in", (before - F.col("_first")).alias("_shift"))
    joined = ranged.join(shifts, (F.col(key) == F.col("_of")) & (F.col("_range") == F.col("_in")))
    return joined.select(*dict.fromkeys([key, *kept]), (F.col("_at") + F.col("_shift")).alias("place"))


def running(rows: DataFrame, key: str, at: str, values: list[str], total: Callable[[str], Column], plus: Callable[[Column, Column], Column], falling: bool = False) -> DataFrame:
    """The rows with each value replaced by its total up to there: along rising positions, or falling ones. total aggregates, plus adds two totals."""
    segmented = rows.withColumn("_segment", F.floor(F.col(at) / SEGMENT))
    order = lambda c: F.col(c).desc() if falling else F.col(c)
    inside = Window.partitionBy(key, "_segment").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    within = segmented.select("*", *[total(v).over(inside).alias(f"_{v}") for v in values])
    # Keys of one segment carry nothing, so only longer ones have rows here.
    sums = segmented.groupBy(F.col(key).alias("_of"), F.col("_segment").alias("_in")).agg(*[total(v).alias(v) for v in values])
    earlier = Window.partitionBy("_of").orderBy(order("_in")).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_of", "_in", *[total(v).over(earlier).alias(f"_before_{v}") for v in values]).where(F.col(f"_before_{values[0]}").isNotNull())
    joined = within.join(carried, (F.col(key) == F.col("_of")) & (F.col("_segment") == F.col("_in")), "left")
    others = [c for c in rows.columns if c not in values]
    return joined.select(*others, *[F.when(F.col("_of").isNull(), F.col(f"_{v}")).otherwise(plus(F.col(f"_{v}"), F.col(f"_before_{v}"))).alias(v) for v in values])
