"""Removal of lines that many documents share, as one keep bitmap for each document.

Every long enough line gives a digest of its key. Digests are dealt by ranges and sorted by digest, then by document from the
largest id down, then by position, so that the first occurrence in a run of equal digests stands in the document that keeps the line. Each range is read as a
stream that remembers one open digest: runs that begin and end in the range are settled there, with the rows of at most four documents held back
until a fifth shows up. Runs that reach the edge of a range may go on in the next, so that a line of a third of all documents is in many tasks; their rows
are handed on, and settled by the counts of at most two digests a range.

What comes back are positions of lines that go, gathered by document into a bitmap (one bit a line, zlib). Texts aren't moved until kept_text() puts the
bitmaps to the documents.

Cases: null and empty texts are one empty line; a document is told by its id and its text, so rows of one id and other texts have bitmaps of their own but count
as one document; repeated rows share a bitmap; null ids are one document, smaller than any; lines that repeat inside one document don't make a key frequent, and
stay or go together; documents may lose all lines, and are empty then; an empty table gives no rows; very long texts are
split whole; columns named like an output give way, others are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, stored, unused, without

#: What is stripped at both ends of a line.
WHITE = " \t\n\x0b\x0c\r"
#: Keys of so many code points or more, in so many documents or more, keep their lines in one document only.
LEAST_LENGTH, LEAST_DOCS = 40, 5
#: What a row of the stream is: a line that goes, one of a run that may go on elsewhere, or a document that such a run was seen in.
GOES, OPEN, SEEN = 0, 1, 2
OUTPUTS = ("n_lines", "n_dropped", "keep")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case; lower() does that for a line of ASCII alone, and is faster."""
    bare = F.trim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def n_lines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def _named(docs: DataFrame, id: str, text: str) -> dict[str, Column]:
    """What tells a document: whether it has an id, the id, and digests of its text."""
    said = F.coalesce(text, F.lit(""))
    return {"known": F.col(id).isNotNull().cast("int"), "doc": F.coalesce(F.col(id), F.lit(0).cast(docs.schema[id].dataType)), "mark": F.xxhash64(said), "mark2": F.xxhash64(F.lit(1), said)}


def keyed_lines(docs: DataFrame, id: str, text: str, least_length: int) -> DataFrame:
    """k1, k2 (digest of a line's key), the document's names, lines (its number of lines), pos for every line with a long enough key."""
    said = F.coalesce(text, F.lit(""))
    named = docs.select(*[c.alias(n) for n, c in _named(docs, id, text).items()], n_lines(said).cast("int").alias("lines"), F.split(said, "\n").alias("each"))
    lines = named.select("known", "doc", "mark", "mark2", "lines", F.posexplode("each").alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    long = (F.length("line") >= least_length) & (F.length(F.trim("line", F.lit(WHITE))) >= least_length)
    return lines.where(long).select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"), "known", "doc", "mark", "mark2", "lines", "pos")


def _changes(rows: pd.DataFrame, *columns: str) -> np.ndarray:
    """Where a row differs from the one before; the first row does."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in columns:
        values = rows[c].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


class OpenRun:
    """The last run of equal digests that a stream has seen: its first documents, and its rows as long as they are too few documents'."""

    def __init__(self, key: tuple, first: bool, least_docs: int):
        self.key, self.first, self.least, self.docs, self.held = key, first, least_docs, [], []

    def add(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if self.first:
            yield rows.assign(kind=OPEN)
            return
        for doc in rows.loc[_changes(rows, "known", "doc"), ["known", "doc"]].head(self.least + 1).itertuples(index=False, name=None):
            if len(self.docs) < self.least and doc not in self.docs[-1:]:
                self.docs.append(doc)
        self.held.append(rows)
        if len(self.docs) == self.least:
            known, doc = self.docs[0]
            for part in self.held:
                yield part[(part["known"] != known) | (part["doc"] != doc)].assign(kind=GOES)
            self.held = []

    def at_edge(self) -> Iterator[pd.DataFrame]:
        """The range ends, the run may not."""
        if len(self.docs) == self.least:
            known, doc = zip(*self.docs, strict=True)
            blank = np.zeros(len(known), "int64")
            yield pd.DataFrame({"k1": blank + self.key[0], "k2": blank + self.key[1], "known": known, "doc": doc, "mark": blank, "mark2": blank, "lines": blank, "pos": blank, "kind": SEEN})
        for part in self.held:
            yield part.assign(kind=OPEN)


def streamed(batches: Iterator[pd.DataFrame], least_docs: int) -> Iterator[pd.DataFrame]:
    """The rows of one sorted range that go, and those of its first and last run that can't be told yet."""
    run = None
    for rows in batches:
        if rows.empty:
            continue
        starts = np.flatnonzero(_changes(rows, "k1", "k2"))
        ends = [*starts[1:], len(rows)]
        heads = [(int(a), int(b)) for a, b in zip(rows["k1"].iloc[starts], rows["k2"].iloc[starts], strict=True)]
        # The first run may be the open one; the last one stays open; those between are settled here.
        if run is None or heads[0] != run.key:
            run = OpenRun(heads[0], run is None, least_docs)
        yield from run.add(rows.iloc[: ends[0]])
        if len(starts) > 2:
            middle = rows.iloc[ends[0] : starts[-1]]
            new, docs = _changes(middle, "k1", "k2"), _changes(middle, "k1", "k2", "known", "doc")
            nth = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            many = np.add.reduceat(docs, at) >= least_docs
            known, doc = middle["known"].to_numpy(), middle["doc"].to_numpy()
            yield middle[many[nth] & ((known != known[at][nth]) | (doc != doc[at][nth]))].assign(kind=GOES)
        if len(starts) > 1:
            run = OpenRun(heads[-1], False, least_docs)
            yield from run.add(rows.iloc[starts[-1] :])
    if run is not None:
        yield from run.at_edge()


@F.pandas_udf(T.BinaryType())
def bitmap(lines: pd.Series, gone: pd.Series) -> pd.Series:
    """One bit a line, set where it stays, compressed."""

    def made(n: int, positions: np.ndarray) -> bytes:
        bits = np.ones(n, "uint8")
        bits[positions] = 0
        return zlib.compress(np.packbits(bits, bitorder="little").tobytes())

    return pd.Series([made(n, p) for n, p in zip(lines, gone, strict=True)])


@F.pandas_udf(T.StringType())
def kept_lines(text: pd.Series, keep: pd.Series) -> pd.Series:
    """The lines whose bits are set; null without a bitmap."""

    def left(said: str, packed: bytes) -> str:
        lines = said.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), "uint8"), count=len(lines), bitorder="little")
        return "\n".join(line for line, bit in zip(lines, bits, strict=True) if bit)

    return pd.Series([None if p is None else left(t, p) for t, p in zip(text, keep, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """known, doc, mark, mark2 (a document's names), n_dropped, keep: a row for each document that loses lines."""
    bound_batches(docs.sparkSession)
    lines = keyed_lines(docs, id, text, least_length)
    order = [F.col("k1"), F.col("k2"), F.col("known").desc(), F.col("doc").desc(), F.col("mark"), F.col("mark2"), F.col("pos")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema) + ", kind int"
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    told = stored(ranged.mapInPandas(lambda batches: streamed(batches, least_docs), kinds), "line-runs")

    # At most two digests a range.
    edges = told.where(F.col("kind") != GOES)
    seen = edges.select("k1", "k2", "known", "doc").distinct()
    counts = seen.groupBy(F.col("k1").alias("of1"), F.col("k2").alias("of2")).agg(F.count("*").alias("docs"), F.max(F.struct("known", "doc")).alias("owner")).where(F.col("docs") >= least_docs)
    opened = told.where(F.col("kind") == OPEN).join(F.broadcast(counts), (F.col("k1") == F.col("of1")) & (F.col("k2") == F.col("of2")))
    late = opened.where(F.struct("known", "doc") != F.col("owner"))
    names = ["known", "doc", "mark", "mark2", "lines"]
    gone = told.where(F.col("kind") == GOES).select(*names, "pos").unionByName(late.select(*names, "pos")).distinct()
    by_doc = gone.groupBy(*names).agg(F.collect_list("pos").alias("positions"))
    return by_doc.select("known", "doc", "mark", "mark2", F.size("positions").cast("long").alias("n_dropped"), bitmap("lines", "positions").alias("keep"))


def deduped(docs: DataFrame, id: str = "doc_id", text: str = "text", **bounds: int) -> DataFrame:
    """The documents with their bitmaps: n_lines, n_dropped, keep (null if all lines stay)."""
    docs = docs.select(*without(docs, *OUTPUTS))
    bitmaps = stored(keep_bitmaps(docs, id, text, **bounds), "line-bitmaps")
    names = _named(docs, id, text)
    here = dict(zip(names, unused(docs, *(f"_{n}" for n in names)), strict=True))
    there = dict(zip(names, unused(docs, *(f"_of_{n}" for n in names)), strict=True))
    named = docs.withColumns({here[n]: c for n, c in names.items()})
    joined = named.join(bitmaps.withColumnsRenamed(there), [F.col(here[n]) == F.col(there[n]) for n in names], "left")
    return joined.select(*docs.columns, n_lines(F.coalesce(text, F.lit(""))).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep")


def kept_text(text: Column, keep: Column) -> Column:
    """The text that a bitmap leaves; texts without one aren't sent to Python."""
    said = F.coalesce(text, F.lit(""))
    return F.coalesce(kept_lines(F.when(keep.isNotNull(), said), keep), said)


#: The query's rows in DuckDB SQL.
ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(generate_series(1, len(each))) AS pos, unnest(each) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS each FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT k.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed k LEFT JOIN frequent USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id"""
