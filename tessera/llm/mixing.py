"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Every source gets weight x level words, but never more than `epochs` times its own size; what a clamped source leaves over goes
to the others by weight until no source is above its cap. Level and targets are solved in closed form: with sources in order
of cap / weight, the first one whose share of what is left does not exceed its cap fixes the level.

A source's repetitions split into whole passes, which take every row, and one fractional pass, which takes the first rows of
a seeded order until the target is reached. That order is cut into hash buckets: whole buckets are decided by running sums over
bucket totals, so that only the one bucket at the border is ordered row by row, and a hot source is never in one task.

Cases: null and empty texts have size 0 and a null source is a source of its own, last in order; sources without words get a
target of 0; an empty table gives an empty result; rows with equal ids are rows of their own; rows without an id are placed by
their size; very long texts count whole; further columns are kept, but columns named like an output give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import unused, without

#: Words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, EPOCHS, SHARE, SEED = (5, 2, 1), 2, 1.5, "mix-1"
#: Buckets of the seeded order are 2^-12 of it.
HASH_DIGITS, BUCKET_BITS = 8, 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_order(row_id: Column, size: Column, seed: str) -> Column:
    """A 32-bit position from the id, or from the size where there is none, alike in every run."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(row_id.cast("string"), F.concat(F.lit("n"), size.cast("string")), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")


def targets(sized: DataFrame, source: str = "source", size: str = "size", weights: tuple = WEIGHTS, epochs: float = EPOCHS, share: float = SHARE) -> DataFrame:
    """One row for each source: source, source_size, target. The windows below run over one row a source."""
    totals = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    caps = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    share_of_rest = (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = caps.withColumn("level", share_of_rest).withColumn("rank", F.row_number().over(by_ratio))
    level = F.min_by(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("rank"))).over(every)
    return levels.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def mix(df: DataFrame, row_id: str = "doc_id", source: str = "source", size: str = "size", weights: tuple = WEIGHTS, epochs: float = EPOCHS, share: float = SHARE, seed: str = SEED) -> DataFrame:
    """Adds source_size, target and repeats (times the mix takes the row) to a frame with a size column."""
    kept = without(df, "source_size", "target", "repeats")
    at, bucket, of, part, plan = unused(df, "_mix_at", "_mix_bucket", "_mix_source", "_mix_part", "_mix_plan")
    keyed = df.withColumn(at, seeded_order(F.col(row_id), F.col(size), seed))
    keyed = keyed.withColumn(bucket, F.shiftright(at, BUCKET_BITS))
    sums = keyed.groupBy(F.col(source).alias("of"), F.col(bucket).alias("part")).agg(F.sum(size).alias("sum"))
    goal = targets(df, source, size, weights, epochs, share)
    running = F.sum("sum").over(Window.partitionBy("of").orderBy("part"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    planned = (
        sums.withColumn("end", running)
        .join(goal, F.col("of").eqNullSafe(F.col("source")))
        .withColumn("whole", whole)
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("start", F.col("end") - F.col("sum"))
        .select(F.col("of").alias(of), F.col("part").alias(part), F.struct("source_size", "target", "whole", "need", "start", "end").alias(plan))
    )
    joined = keyed.join(planned, F.col(source).eqNullSafe(F.col(of)) & (F.col(bucket) == F.col(part)))
    its = F.col(plan)
    inside = its["end"] <= its["need"]
    border = ~inside & (its["start"] < its["need"])
    in_order = Window.partitionBy(of, part).orderBy(at, row_id, size)
    up_to = its["start"] + F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    outputs = lambda taken: [*kept, its["source_size"].alias("source_size"), its["target"].alias("target"), (its["whole"] + taken.cast("long")).alias("repeats")]
    at_border = joined.where(border).select(*outputs(up_to - F.col(size) / 2 <= its["need"]))
    return joined.where(~border).select(*outputs(inside)).unionByName(at_border)


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it."""
    copies, copy = F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int"))), unused(mixed, "_mix_copy")[0]
    return mixed.where("repeats > 0").withColumn(copy, copies).drop(copy, "source_size", "target", "repeats")


#: The same mix in DuckDB SQL.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'n' || len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))), 1, {HASH_DIGITS}) AS BIGINT) AS place
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
caps AS (
  SELECT source, source_size, source_size * {float(EPOCHS)}::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]}::DOUBLE WHEN 1 THEN {WEIGHTS[1]}::DOUBLE ELSE {WEIGHTS[2]}::DOUBLE END AS weight
  FROM totals),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM totals)::DOUBLE * {SHARE}::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
     row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS rank
  FROM caps),
goal AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(level, rank) FROM levels WHERE level * weight <= cap) * weight, cap)) AS target FROM levels),
need AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goal),
placed AS (
  SELECT s.*, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
         sum(size) OVER (PARTITION BY s.source ORDER BY place >> {BUCKET_BITS} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bucket_end,
         sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to
  FROM sized s JOIN need n ON s.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN bucket_end <= need OR up_to - size / 2.0 <= need THEN 1 ELSE 0 END)::BIGINT AS taken
FROM placed"""
