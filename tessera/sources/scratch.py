"""Folders for what a query writes and reads again."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths that this process has made.
MADE: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """An unused path in the folder that the cluster shares (spark.checkpoint.dir); one of this machine only where it is all there is."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        shared = "file://" + os.path.join(tempfile.gettempdir(), "tessera-scratch")
    MADE.append(f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return MADE[-1]


def materialised(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: what was needed to make it isn't planned or run again."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what stands in the paths that this process has made; frames that read them are lost."""
    while MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, by the file system that its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def get(spark: SparkSession, path: str) -> bytes:
    """The bytes of one small file."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
