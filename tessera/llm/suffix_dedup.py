"""Removal of long repeats: suffixes sorted one bucket at a time, long ties resolved by ranks of a difference-cover sample.

A byte goes when it lies in a string of LENGTH bytes that also starts anywhere else in the corpus. In a suffix array of all texts
these are the suffixes whose neighbour shares LENGTH bytes. The array is never held as a whole. Suffixes are dealt into buckets by
content: the bucket of a suffix is the least of the hashed strings of gram_of(LENGTH) bytes in its first LENGTH bytes, so equal beginnings always meet and no
order over the whole corpus is needed. Neighbouring suffixes of a text mostly share a bucket; such a run travels as one block.

1. Runs whose bucket string occurs once are dropped: their suffixes have no equal. 2. Runs that occur twice as a whole (by a
128-bit digest of their bytes) are repeats as a whole, however many copies there are: only counts travel. 3. The rest, with one of each copied
run of the same buckets, is cut into pieces of
STEP suffixes, dealt by the bytes that all suffixes of the piece share, made distinct, and sorted one bucket at a time: ranks
of the sample positions (a difference cover modulo CYCLE) over TIE bytes are computed first; then the suffixes of each offset are sorted by the
bytes before their first sample position, its rank, and the bytes after: equal neighbours are repeats. Memory is bounded by one
bucket's pieces: hot groups of copies collapse before they meet, and the pieces of a bucket of more than HOT_PIECES are cut again
into pieces of FINE_STEP suffixes, which are dealt by more bytes and so apart wherever they differ.

Cases: null and empty texts, and texts shorter than LENGTH, lose nothing; strings that overlap themselves count; a repeated row
counts as elsewhere; null ids are rows of their own; long texts are taken whole; cuts inside a character are made, since the work is on bytes;
an empty table gives an empty result; other columns are kept, but columns named like an output give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, discard, stored, unused, without, worker
from .ngram_join import mixed, powers

LENGTH, STEP = 400, 32
#: Distinct pieces above which a bucket is cut again, and suffixes of such a piece.
HOT_PIECES, FINE_STEP = 512, 4
#: A difference cover: every distance modulo CYCLE is a difference of two of its members.
CYCLE, COVER = 7, (1, 2, 4)
TIE = LENGTH - CYCLE + 1
#: Runs for each file of the tables made of them, at least: small inputs in many partitions are kept in few files.
PART_RUNS = 50_000
PLACE_BITS = 24
CHUNK = 1 << 22
U64 = np.uint64
_VALUES = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def gram_of(length: int) -> int:
    """Bytes of a bucket string: long enough to be rare, short enough for runs that are long."""
    return max(1, length * 8 // 25)


def runs(raw: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, place, bucket): suffixes first..last have their bucket string, of hash bucket, at place."""
    gram = gram_of(length)
    for begin in range(0, max(0, len(raw) - length + 1), CHUNK):
        part = np.frombuffer(raw, np.uint8)[begin : begin + CHUNK + length - 1]
        n, width = len(part) - gram + 1, length - gram + 1
        up, down = powers(len(part) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_VALUES[part] * up[: len(part)], out=sums[1:])
            hashes = mixed((sums[gram:] - sums[:n]) * down[:n])
        keys = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
        keys[:n] = (hashes >> U64(PLACE_BITS) << U64(PLACE_BITS)) | np.arange(n, dtype=np.uint64)
        table = keys.reshape(-1, width)
        head = np.minimum.accumulate(table, 1).ravel()
        tail = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
        windows = n - width + 1
        place = (np.minimum(tail[:windows], head[width - 1 : width - 1 + windows]) & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
        firsts = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        lasts = np.concatenate((firsts[1:] - 1, [windows - 1]))
        at = place[firsts]
        yield from zip((firsts + begin).tolist(), (lasts + begin).tolist(), (at + begin).tolist(), hashes[at].view(np.int64).tolist(), strict=True)


def _two(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def run_table(docs: DataFrame, length: int) -> DataFrame:
    """One row a run: d, h (its text's key), first, last, place, bucket, b1, b2 (digest of the run's bytes)."""
    names = ("d", "h", "first", "last", "place", "bucket", "b1", "b2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                rows = []
                for d, h, text in zip(part.column("d").to_pylist(), part.column("h").to_pylist(), part.column("text"), strict=True):
                    raw = (text.as_py() or "").encode()
                    for first, last, place, bucket in runs(raw, length):
                        rows.append((d, h, first, last, place, bucket, *_two(hashlib.blake2b(raw[first : last + length], digest_size=16).digest())))
                columns = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.mapInArrow(worker(run), ", ".join(f"{n} long" for n in names))


def pieces(raw: bytes, first: int, last: int, place: int, length: int) -> Iterator[tuple[int, int, bytes, int]]:
    """(shared key, start, bytes, offset): the run's suffixes in groups whose distances to place fall in one step."""
    for group in range((place - last) // STEP, (place - first) // STEP + 1):
        low = place - group * STEP - STEP + 1  # the earliest suffix of the group, whether or not it is in the run
        a, b = max(first, low), min(last, low + STEP - 1)
        if a <= b:
            shared = raw[low + STEP - 1 : low + length]
            key = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=group.to_bytes(8, "little")).digest(), "little", signed=True)
            yield key, a, raw[a : b + length], a - low


def sorted_bucket(members: list[tuple[int, bytes, int, int]], length: int) -> list[int]:
    """For each member (offset, bytes, count, ...) of a bucket: a bit for each of its suffixes that has an equal."""
    if len(members) == 1:  # nothing to sort: its suffixes equal only those of its own copies
        _, raw, count, *_ = members[0]
        return [(1 << (len(raw) - length + 1)) - 1 if count > 1 else 0]
    tie = length - CYCLE + 1
    ranks: dict[int, list[int | None]] = {}
    span = STEP + CYCLE
    # Ranks of the sample, one position of the cover at a time.
    for x in range(span):
        if x % CYCLE in COVER:
            strings = [m[1][x - m[0] : x - m[0] + tie] if m[0] <= x <= m[0] + len(m[1]) - tie else None for m in members]
            order = sorted((k for k, s in enumerate(strings) if s is not None), key=strings.__getitem__)
            rank: list[int | None] = [None] * len(members)
            for n, k in enumerate(order):
                rank[k] = rank[order[n - 1]] if n and strings[order[n - 1]] == strings[k] else n
            ranks[x] = rank
    masks = [0] * len(members)
    for x in range(STEP):
        lead = next(k for k in range(CYCLE) if (x + k) % CYCLE in COVER)
        rank = ranks[x + lead]
        bucket = []
        for k, (offset, raw, count, *_) in enumerate(members):
            at = x - offset
            if 0 <= at <= len(raw) - length:
                bucket.append((rank[k], raw[at : at + lead], raw[at + lead + tie : at + length], k))
                if count > 1:
                    masks[k] |= 1 << at
        bucket.sort()
        for one, two in zip(bucket, bucket[1:], strict=False):
            if one[:3] == two[:3]:
                masks[one[3]] |= 1 << (x - members[one[3]][0])
                masks[two[3]] |= 1 << (x - members[two[3]][0])
    return masks


PIECE = ("d", "h", "start", "offset", "bucket", "id")
PIECE_SCHEMA = ", ".join(f"{n} long" for n in PIECE) + ", bytes binary"


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], names=[*PIECE, "bytes"])


def _id(body: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)


def piece_table(docs: DataFrame, open_runs: DataFrame, length: int) -> DataFrame:
    """One row a piece: d, h, start, offset, bucket (shared key), id, bytes."""
    per_text = open_runs.groupBy("d", "h").agg(F.collect_list(F.struct("first", "last", "place")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                rows = []
                for d, h, text, found in zip(*(part.column(c).to_pylist() for c in ("d", "h", "text", "runs")), strict=True):
                    raw = text.encode()
                    for r in found:
                        for key, start, body, offset in pieces(raw, r["first"], r["last"], r["place"], length):
                            if start + len(body) <= len(raw):
                                rows.append((d, h, start, offset, key, _id(body), body))
                yield _piece_batch(rows)

    return docs.join(per_text, ["d", "h"]).select("d", "h", "text", "runs").mapInArrow(worker(run), PIECE_SCHEMA)


def cut_again(table: DataFrame, length: int) -> DataFrame:
    """Pieces of hot buckets in pieces of FINE_STEP suffixes, dealt by the bytes that all of these share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, h, start, offset, body in zip(*(batch.column(c).to_pylist() for c in ("d", "h", "start", "offset", "bytes")), strict=True):
                last = offset + len(body) - length
                for low in range(offset // FINE_STEP * FINE_STEP, last + 1, FINE_STEP):
                    a, b = max(offset, low), min(last, low + FINE_STEP - 1)
                    shared = body[low + FINE_STEP - 1 - offset : low + length - offset]
                    part = body[a - offset : b - offset + length]
                    key = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=b"fine%d" % low).digest(), "little", signed=True)
                    rows.append((d, h, start + a - offset, a - low, key, _id(part), part))
            yield _piece_batch(rows)

    return table.mapInArrow(worker(run), PIECE_SCHEMA)


def bucket_masks(table: DataFrame, length: int) -> DataFrame:
    """bucket, offset, id, mask: suffixes of each distinct piece that have an equal, one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, out = None, [], []

        def close() -> None:
            if members:
                out.extend((key, m[0], m[3], mask) for m, mask in zip(members, sorted_bucket(members, length), strict=True) if mask)
                members.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["bucket", "offset", "id", "mask"])

        for batch in batches:
            for bucket, offset, one, count, body in zip(*(batch.column(c).to_pylist() for c in ("bucket", "offset", "id", "count", "bytes")), strict=True):
                if bucket != key:
                    close()
                    key = bucket
                members.append((offset, body, count, one))
            yield made()
        close()
        yield made()

    distinct = table.groupBy("bucket", "offset", "id", "bytes").count()
    return distinct.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(worker(run), "bucket long, offset long, id long, mask long")


def repeats(df: DataFrame, text: str = "text", row_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """By d and h, the keys of a row's id and text, the covered byte ranges of the texts (not yet merged)."""
    bound_batches(df.sparkSession)
    docs = df.select(*keys(row_id, text), F.col(text).alias("text")).where(F.octet_length("text") >= length)
    table = stored(run_table(docs, length), "suffix-runs")
    parts = 1 + table.count() // PART_RUNS
    # Counts are stored before they are joined: a join on its own exchanges can split a hot bucket, one behind an aggregate cannot.
    twice = stored(table.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "suffix-twice", parts)
    near = stored(table.join(twice, "bucket", "left_semi"), "suffix-near", parts)
    discard(table, twice)
    copied = stored(near.groupBy("b1", "b2").agg(F.count("*").alias("n")).where("n > 1").select("b1", "b2", F.lit(True).alias("whole")), "suffix-copied", parts)
    marked = stored(near.join(copied, ["b1", "b2"], "left"), "suffix-marked", parts)
    discard(near, copied)
    whole = marked.where("whole").select("d", "h", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    # The rest may also equal parts of runs that are copied as a whole: one of each such run joins in.
    rest = marked.where("whole is null")
    opened = stored(rest.select("bucket").distinct(), "suffix-open", parts)
    copies = marked.where("whole").join(opened, "bucket", "left_semi")
    one = copies.groupBy("b1", "b2").agg(F.min(F.struct("d", "h", "first", "last", "place")).alias("one")).select("one.*")
    first = stored(piece_table(docs, rest.select("d", "h", "first", "last", "place").unionByName(one), length), "suffix-pieces", parts)
    discard(opened)
    hot = stored(first.select("bucket", "offset", "id").distinct().groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT_PIECES).select("bucket"), "suffix-hot", parts)
    fine = stored(cut_again(first.join(hot, "bucket", "left_semi").select(*PIECE, "bytes"), length), "suffix-fine", parts)
    table = first.join(hot, "bucket", "left_anti").select(*PIECE, "bytes").unionByName(fine)
    masks = bucket_masks(table.select("bucket", "offset", "id", "bytes"), length)
    hit = table.select("d", "h", "start", "bucket", "offset", "id").join(masks, ["bucket", "offset", "id"])
    bits = F.filter(F.sequence(F.lit(0), F.lit(STEP - 1)), lambda k: F.getbit("mask", k) == 1)
    # Suffixes of one piece lie less than its STEP apart: what they cover is one range, unless strings are shorter than that.
    if length >= STEP:
        hit = hit.withColumn("bits", bits).select("d", "h", (F.col("start") + F.array_min("bits")).alias("start"), (F.col("start") + F.array_max("bits") + length).alias("end"))
    else:
        hit = hit.withColumn("k", F.explode(bits)).select("d", "h", (F.col("start") + F.col("k")).alias("start"), (F.col("start") + F.col("k") + length).alias("end"))
    found = stored(whole.unionByName(hit).groupBy("d", "h").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "suffix-ranges", parts)
    discard(marked, first, hot, fine)
    return found


def keys(row_id: str, text: str, names: tuple[str, str] = ("d", "h")) -> list[Column]:
    """What stands for a row: its id and a hash of its text."""
    return [F.coalesce(F.col(row_id).cast("long"), F.lit(-1)).alias(names[0]), F.xxhash64(text).alias(names[1])]


def merged_ranges(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges."""
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(df: DataFrame, text: str = "text", row_id: str = "doc_id", length: int = LENGTH, as_text: bool = False, words: int = 0) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, spans and kept: the bytes that stay or, as text, their whole characters.

    words: a maximal span of fewer words stays, unless it is of LENGTH bytes or more."""
    fields = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    fields += [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType() if as_text else T.BinaryType())]
    kept_columns = without(df, *(f.name for f in fields))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    own_d, own_h, own_text, found = unused(df, "_d", "_h", "_text", "_ranges")
    ranges = repeats(df, text, row_id, length).select(F.col("d").alias(own_d), F.col("h").alias(own_h), F.col("ranges").alias(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for said, held in zip(batch.column(own_text), batch.column(found), strict=True):
                raw = (said.as_py() or "").encode()
                spans = [(a, b) for a, b in merged_ranges(held.as_py()) if b - a >= LENGTH or len(raw[a:b].split()) >= words]
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else raw
                rows.append((len(raw), len(raw) - len(kept), len(spans), [{"start": a, "end": b} for a, b in spans], kept.decode(errors="ignore") if as_text else kept))
            n, removed, n_spans, spans, kept = list(zip(*rows, strict=True)) or [()] * 5
            made = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept_columns), *made], names=[*kept_columns, *(f.name for f in fields)])

    keyed = df.select(*kept_columns, F.col(text).alias(own_text), *keys(row_id, text, (own_d, own_h)))
    return keyed.join(ranges, [own_d, own_h], "left").select(*kept_columns, own_text, found).mapInArrow(worker(run), T.StructType([*(df.schema[c] for c in kept_columns), *fields]))
