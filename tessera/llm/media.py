"""A media column: payloads kept as 8-bit images in archives, read back by a custom Spark data source.

Each payload is stored losslessly as a grey PNG of 64 columns, one byte a sample, as an uncompressed member of a ZIP archive. Every write
task fills archives of its own; only archives named in the commit messages of successful tasks enter the manifest, so a lost
executor leaves nothing that is ever read. Every write adds a manifest of its own, which appears whole or not at all, so that writes
into one folder add up. Member names have a fixed width, so the entries of an archive's directory do too:
the reader plans partitions as byte ranges over archive directories from the manifest alone (one row an archive). A reading
task fetches its range of the directory, then streams members by offset, in Arrow batches of bounded size; each member that
fails its checksum or its read is read again from its own offset, without touching the others.

Cases: null and empty texts become one block of 64 zero bytes; any length is taken whole; null ids and repeated rows are members
of their own; an empty table gives an archive set without members, which reads as no rows; other columns are not stored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import bound_batches, fresh_dir

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: A member's name: sign of a known id, id, bytes of the text, row within its task.
NAME = "{known}{row_id:+020d}-{n_bytes:015d}-{nth:012d}.png"
NAME_BYTES = len(NAME.format(known="k", row_id=0, n_bytes=0, nth=0))
ENTRY = 46 + NAME_BYTES
#: Bytes after which an archive is closed, bytes of members planned for a reading task, bytes of a batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 256 << 20, 32 << 20, 4 << 20
TRIES = 4
#: Folder of the manifests, beside the archives.
MANIFESTS = "_manifests"
SCHEMA = "doc_id long, n_bytes long, media binary"


def padded(raw: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of the width."""
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit image of WIDTH columns."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image of to_png()."""
    if image[:8] != SIGNATURE:
        raise ValueError("not an image")
    at, data = 8, []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + size])
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean and deviation of the samples, mean step between neighbours, and shares of eight equal bands, as text."""
    x = np.frombuffer(payload, np.uint8)
    bands = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
    steps = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"mean={x.mean():.3f};dev={x.std():.3f};step={steps:.3f};bands={'.'.join(map(str, bands))}"


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class Archives(WriterCommitMessage):
    #: file name, offset of the directory, members, bytes of members
    files: list[tuple[str, int, int, int]] = field(default_factory=list)


class ArchiveWriter(DataSourceArrowWriter):
    """Writes members (doc_id, n_bytes, media) into ZIP archives, one set for each task attempt."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        done, out, entries, name, at, nth = Archives(), None, [], "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                directory = b"".join(entries)
                out.write(directory)
                # Sizes and counts beyond the classic record's fields are written as their marks; the manifest holds them.
                out.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(len(entries), 0xFFFF), min(len(entries), 0xFFFF), len(directory), at, 0))
                out.close()
                done.files.append((name, at, len(entries), at))
                out = None
                entries.clear()

        for batch in iterator:
            for row_id, n_bytes, media in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "media")), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.zip", 0
                    out = fs.open_output_stream(f"{root}/{name}")
                body, row = media.as_py(), row_id.as_py()
                label = NAME.format(known="n" if row is None else "k", row_id=row or 0, n_bytes=n_bytes.as_py(), nth=nth).encode()
                crc, nth = zlib.crc32(body), nth + 1
                common = struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 0x21, crc, len(body), len(body), len(label), 0)
                out.write(struct.pack("<I", 0x04034B50) + common + label)
                out.write(body)
                entries.append(struct.pack("<IH", 0x02014B50, 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, at) + label)
                at += 30 + len(label) + len(body)
                if at >= ARCHIVE_BYTES:
                    close()
        close()
        return done

    def commit(self, messages: list[Archives | None]) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        name = f"{root}/{MANIFESTS}/{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{name}.tmp") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())
        fs.move(f"{name}.tmp", f"{name}.json")

    def abort(self, messages: list[Archives | None]) -> None:
        fs, root = _filesystem(self.path)
        for m in messages:
            for x in m.files if m is not None else ():
                fs.delete_file(f"{root}/{x[0]}")


class DirectoryRange(InputPartition):
    def __init__(self, name: str, directory: int, first: int, last: int):
        self.name, self.directory, self.first, self.last = name, directory, first, last


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        """Ranges of directory entries whose members come to about RANGE_BYTES."""
        fs, root = _filesystem(self.path)
        parts, archives = [], []
        for found in sorted(x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/{MANIFESTS}")) if x.path.endswith(".json")):
            with fs.open_input_stream(found) as f:
                archives += json.loads(f.read())
        for name, directory, members, size in archives:
            cuts = min(members, -(-size // RANGE_BYTES))
            parts += [DirectoryRange(name, directory, members * k // cuts, members * (k + 1) // cuts) for k in range(cuts)]
        return parts

    def read(self, partition: DirectoryRange) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, root = _filesystem(self.path)
        with fs.open_input_file(f"{root}/{partition.name}") as archive:
            entries = again(lambda: exactly(archive, partition.directory + partition.first * ENTRY, (partition.last - partition.first) * ENTRY))
            rows, held = [], 0
            for k in range(0, len(entries), ENTRY):
                entry = entries[k : k + ENTRY]
                crc, size = struct.unpack("<II", entry[16:24])
                (offset,) = struct.unpack("<I", entry[42:46])
                name = entry[46:].decode()
                media = again(lambda offset=offset, size=size, crc=crc: member(archive, offset, size, crc))
                rows.append((int(name[1:21]) if name[0] == "k" else None, int(name[22:37]), media))
                held += size
                if held >= BATCH_BYTES:
                    yield as_batch(rows)
                    rows, held = [], 0
            if rows:
                yield as_batch(rows)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, sizes, media = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def exactly(archive, offset: int, size: int) -> bytes:
    got = archive.read_at(size, offset)
    if len(got) != size:
        raise OSError(f"{len(got)} of {size} bytes at {offset}")
    return got


def member(archive, offset: int, size: int, crc: int) -> bytes:
    """One member by its offset, checked against the directory's checksum."""
    body = exactly(archive, offset + 30 + NAME_BYTES, size)
    if zlib.crc32(body) != crc:
        raise OSError(f"checksum differs at {offset}")
    return body


def again(read, tries: int = TRIES, wait: float = 0.05):
    """Tries one read on its own, with growing pauses; the last failure is raised and fails the task, which Spark reruns."""
    for k in range(tries):
        try:
            return read()
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(wait * 2**k)


class MediaArchives(DataSource):
    """Format "media_archives" over a folder of ZIP archives: doc_id, n_bytes, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"])


def store(df: DataFrame, path: str, row_id: str = "doc_id", text: str = "text") -> None:
    """Writes each text's payload as an image into archives under path."""

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [(t.as_py() or "").encode() for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([batch.column(row_id).cast(pa.int64()), pa.array(map(len, raws), pa.int64()), pa.array([to_png(padded(r)) for r in raws], pa.binary())], names=["doc_id", "n_bytes", "media"])

    bound_batches(df.sparkSession)
    df.sparkSession.dataSource.register(MediaArchives)
    df.select(row_id, text).mapInArrow(images, SCHEMA).write.format("media_archives").mode("append").save(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").load(path)


def described(media: DataFrame) -> DataFrame:
    """Payload digests and features of stored members."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image in batch.column("media"):
                image = image.as_py()
                payload = from_png(image)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), features(payload)))
            made = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return media.mapInArrow(run, schema)


def media_column(df: DataFrame) -> DataFrame:
    """Stores all texts in fresh archives of the shared folder and describes what is read back."""
    spark = df.sparkSession
    path = fresh_dir(spark, "media")
    store(df, path)
    return described(load(spark, path))
