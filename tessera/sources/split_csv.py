"""Delimited files with line breaks in quotes, read by as many tasks as any text.

A line break ends a record where an even number of quotes stands before it in the file. So each split of a file counts its quotes, the splits' parities
are summed in their order, and then every split knows whether it begins inside quotes and where records begin in it. Records of one line, most as a rule, are parsed
where they are; only the lines of longer ones are brought together, over the borders of splits as well. A record is bounded by what stands between two of its
quotes: a file that never closes one is one record from there on, as it is for any reader.

Quotes must follow the rule that a field with a quote in it is quoted, and a quote in it doubled; for other files read by csv()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import materialised


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order, of one split after the other, with the number of their record in the split (0: one that began before it)."""
    split, inside, record, nth = None, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, begins = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "block", "inside"))
        quotes = pc.count_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False)
        change = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        records, places, alone = np.empty(len(file), "int64"), np.empty(len(file), "int64"), np.empty(len(file), bool)
        for a, b in zip([0, *change], [*change, len(file)], strict=True):
            if (file[a], block[a]) != split:
                split, inside, record, nth = (file[a], block[a]), int(begins[a]), 0, 0
            upto = inside + np.cumsum(quotes[a:b])
            starts = (upto - quotes[a:b]) % 2 == 0
            records[a:b], places[a:b], alone[a:b] = record + np.cumsum(starts), nth + np.arange(b - a), starts & (quotes[a:b] % 2 == 0)
            inside, record, nth = int(upto[-1] % 2), int(records[b - 1]), nth + b - a
        columns = [batch.column("value"), batch.column("file"), batch.column("block"), pa.array(records), pa.array(places), pa.array(alone)]
        yield pa.RecordBatch.from_arrays(columns, names=["value", "file", "block", "record", "place", "alone"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """file (a digest of its path), first (whether it is the file's first), record: the text of each record that isn't empty."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = odd.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("inside"))
    # One row of some 20 bytes a split; a shuffle would mix up the lines.
    scanned = lines.join(F.broadcast(begins), ["file", "block"]).select("value", "file", "block", "inside").mapInArrow(_scanned, "value string, file long, block long, record long, place long, alone boolean")
    whole = scanned.where("alone").select("file", ((F.col("block") == 0) & (F.col("record") == 1)).alias("first"), F.col("value").alias("record"))

    parts = materialised(scanned.where("not alone").drop("alone"), "record-parts")
    # The last record that begins in a split is the one that goes on in the next, where it is in more than one.
    last = parts.groupBy("file", "block").agg(F.max("record").alias("last"))
    open_ = F.last(F.when(F.col("last") > 0, F.struct(F.col("block").alias("block"), F.col("last").alias("record"))), ignorenulls=True)
    owners = last.select(F.col("file").alias("of"), F.col("block").alias("at"), open_.over(before).alias("owner"))
    goes_on = F.col("record") == 0
    joined = parts.join(owners, (F.col("file") == F.col("of")) & (F.col("block") == F.col("at")), "left")
    owned = joined.select("value", "file", "block", "place", F.when(goes_on, F.col("owner.block")).otherwise(F.col("block")).alias("own_block"), F.when(goes_on, F.col("owner.record")).otherwise(F.col("record")).alias("own_record"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "place", "value")))
    longer = owned.groupBy("file", "own_block", "own_record").agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("record"))
    both = whole.unionByName(longer.select("file", ((F.col("own_block") == 0) & (F.col("own_record") == 1)).alias("first"), "record"))
    plain = F.replace(F.regexp_replace("record", "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    return both.select("file", "first", plain.alias("record")).where(F.length("record") > 0)


def split_csv(spark: SparkSession, path: str, schema: T.StructType, tab: bool = False) -> DataFrame:
    """SRC-01, SRC-03, SRC-17: the rows of csv(), of files of any size: each has a header, which names nothing here."""
    names = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    parsed = F.from_csv("record", F.lit(names), {"sep": "\t" if tab else ",", "escape": '"'})
    rows = records(spark, path).where("not first").select(parsed.alias("row"))
    return rows.select(*[F.col("row").getField(f.name).alias(f.name) for f in schema])
