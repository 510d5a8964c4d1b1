"""Text files of many pages, each ended by a form feed as page extractors write them, read by as many tasks as any text.

The text reader takes the form feed as its line separator, so a split of a file is a run of whole pages, whatever line breaks they have. Pages are numbered in two
passes: the first counts each split's pages (and finds what is no text), the counts are summed in the order of the splits, and the second pass goes on counting
from there. No page is shuffled, and a file of any size is work for many tasks; a page has to fit into memory, a file has not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialised

#: Splits, one row of some 100 bytes each, whose counts are broadcast; more are joined by a shuffle.
BROADCAST_SPLITS = 500_000


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in order, of one split after the other, with their number in the split."""
    split, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("path", "block"))
        change = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        numbers = np.empty(len(file), "int64")
        for a, b in zip([0, *change], [*change, len(file)], strict=True):
            if (file[a], block[a]) != split:
                split, seen = (file[a], block[a]), 0
            numbers[a:b] = seen + np.arange(1, b - a + 1)
            seen += b - a
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], names=[*batch.schema.names, "nth"])


def paged_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC-12: path, page (from 1), text, error: one row a page; a file with a zero byte is no text and gives one row with an error, however many pages it has.

    A form feed ends a page, so nothing behind the last one is no page, and nothing between two is an empty one. Bytes that are not UTF-8 become replacement
    characters. Files without a byte give no row."""
    where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    found = spark.read.option("lineSep", "\f").text(path).select("value", *where)
    counts = found.groupBy("path", "block").agg(F.count("*").alias("n"), F.bool_or(F.contains("value", F.lit("\0"))).alias("bad"))
    every = Window.partitionBy("path")
    before = every.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.bool_or("bad").over(every).alias("bad"))
    splits = materialised(summed, "page-splits")  # the files are read twice, not once for each use of the counts
    small = splits.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    failed = splits.where("bad").select("path", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"), F.lit("not a text file").alias("error")).distinct()
    # Counted before anything is joined: a shuffle would mix up the pages.
    numbered = found.mapInArrow(_numbered, "value string, path string, block long, nth long")
    read = splits.where("not bad").drop("bad")
    pages = numbered.join(F.broadcast(read) if small else read, ["path", "block"])
    return pages.select("path", (F.col("before") + F.col("nth")).cast("int").alias("page"), F.make_valid_utf8("value").alias("text"), F.lit(None).cast("string").alias("error")).unionByName(failed)
