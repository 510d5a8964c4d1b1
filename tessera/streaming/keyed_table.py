"""A table in key buckets that evidence is merged into as it arrives: only buckets that a batch touches are written again.

Every merge writes new files beside the old ones and then one small commit file, which names the folder of each bucket, so readers see a merge
whole or not at all, and a merge that dies leaves only files that no commit names. A commit also holds the last batch of each stream that fed it: a batch that
comes again after a restart is known by its number and left out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.scratch import get, materialised, put

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """path: a folder of any file system; key: the columns that rows are merged by; buckets: what a merge rewrites at least is one of them."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _file_system(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def state(self) -> dict:
        """The last commit: version, the folder of each bucket that has rows, the last batch of each stream."""
        fs, at = self._file_system()
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        done = sorted(n for n in names if n.endswith(".json"))
        return json.loads(get(self.spark, f"{self.path}/commits/{done[-1]}")) if done else {"version": 0, "folders": {}, "batches": {}}

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(list(self.state()["folders"].values()))

    def files(self) -> dict[str, str]:
        """The folder of each bucket."""
        return dict(self.state()["folders"])

    def merge(self, rows: DataFrame, merge: Merge, stream: str = "", batch: int | None = None) -> bool:
        """Puts merge(rows of the touched buckets, incoming rows) in place of these buckets. False for a batch of a stream that is in the table already."""
        state = self.state()
        if batch is not None and state["batches"].get(stream, -1) >= batch:
            return False
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        incoming = materialised(rows.withColumn("_bucket", bucket), "incoming")
        # At most as many numbers as there are buckets.
        touched = sorted(str(r[0]) for r in incoming.select("_bucket").distinct().collect())
        old = self._rows([state["folders"][b] for b in touched if b in state["folders"]])
        folder = f"data/{state['version'] + 1:08d}-{uuid.uuid4().hex}"
        made = merge(old, incoming.drop("_bucket")).select(*self.schema.names).withColumn("_bucket", bucket)
        made.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, _ = self._file_system()
        written = [f.getPath().getName() for f in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")) if f.isDirectory()]
        state["folders"] = {b: f for b, f in state["folders"].items() if b not in touched} | {n.split("=")[1]: f"{folder}/{n}" for n in written if n.startswith("_bucket=")}
        if batch is not None:
            state["batches"][stream] = batch
        self._commit(state | {"version": state["version"] + 1})
        return True

    def _commit(self, state: dict) -> None:
        """Names the new state; fails if another merge has taken the version in the meantime."""
        fs, at = self._file_system()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        target, made = path(at, f"{state['version']:08d}.json"), f"{self.path}/commits/{uuid.uuid4().hex}.tmp"
        put(self.spark, made, json.dumps(state).encode())
        if fs.exists(target) or not fs.rename(path(made), target):
            raise RuntimeError(f"another merge made version {state['version']} of {self.path}")

    def follow(self, stream: DataFrame, merge: Merge, name: str, checkpoint: str) -> StreamingQuery:
        """J-09, SNK-05: merges what has arrived, batch by batch, and ends; a rerun goes on where the last one stopped."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.merge(rows, merge, name, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
