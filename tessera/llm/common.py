"""What the operators of this package share: table access, durable cuts of the lineage, Arrow batch bounds."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch handed to Python: whole documents can be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small input, of fewer partitions than cores, dealt over all cores; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for internal columns that no column of the frame has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> list[str]:
    """The frame's columns but those that outputs of these names replace, whatever their case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Arrow batches of at most this many rows, and of not much more than this many bytes, for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


#: By name, the caches of models that operators keep from task to task in a Python worker.
CACHES: dict[str, Callable] = {}


def let_go(keep: str | None = None) -> None:
    """Empties the caches of this Python worker but one, and returns memory that is free to the system.

    Workers serve one operator after the other: what each of them keeps would add up."""
    filled = [c for name, c in CACHES.items() if name != keep and c.cache_info().currsize]
    for cache in filled:
        cache.cache_clear()
    if filled:
        gc.unfreeze()  # models may be frozen, and have cycles
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
    if trim:
        trim(0)


def worker(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that begins without what other operators left in the worker, and leaves nothing but its own cache."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keep)
        yield from run(batches)
        let_go(keep)

    return alone


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); where none is set, one of this machine, if it is all there is."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        named = "file://" + os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


#: Paths in the shared folder that this process has made.
MADE: list[str] = []


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    MADE.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return MADE[-1]


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_stored(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this process; frames that read them are lost."""
    while MADE:
        _delete(spark, MADE.pop())


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more: what was made of them is stored itself."""
    for made in tables:
        MADE.remove(made.stored_at)
        _delete(made.sparkSession, made.stored_at)


def discard_since(spark: SparkSession, mark: int, kept: DataFrame) -> None:
    """Deletes the intermediate tables made since MADE had `mark` entries, but one."""
    for path in [p for p in MADE[mark:] if p != kept.stored_at]:
        MADE.remove(path)
        _delete(spark, path)


def stored(df: DataFrame, label: str, parts: int | None = None) -> DataFrame:
    """Writes a frame as a Parquet table in the shared folder and reads it back: lineage ends here, lost executors cost nothing above it.

    parts: the most files it is written in, for tables whose size is known not to need more.
    The write's shuffle files go as soon as it ends, where this Spark can do that."""
    spark = df.sparkSession
    path, cleanup = fresh_dir(spark, label), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def checkpointed(df: DataFrame, parts: int | None = None) -> DataFrame:
    """A reliable checkpoint in the shared folder, for slim frames, in at most so many files."""
    shared_dir(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint()
