"""Yearly numbers of works by source and country, counted where the works are: a Spark data source that is asked for groups and gives counts.

Works lie in folders source=.../country=... of Parquet files. What a query asks of source, country and year goes to the data source as filters: folders that
are not asked for are neither listed nor opened, and no work is read beyond its year."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "source string, country string, year int, publication_count long"
#: What Hive folders call a missing value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
BOUNDS = {GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal, EqualTo: pc.equal}


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pyarrow.fs.LocalFileSystem(), path)


class Group(InputPartition):
    def __init__(self, source: str, country: str, folder: str):
        self.source, self.country, self.folder = source, country, folder


class CountsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.asked, self.bounds = path, {}, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equalities and lists of source and country, and bounds of the year; gives the others back."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if name in ("source", "country") and isinstance(f, (EqualTo, In)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.asked[name] = self.asked.get(name, values) & values
            elif name == "year" and type(f) in BOUNDS:
                self.bounds.append((type(f).__name__, f.value))
            else:
                yield f

    def _groups(self, folder: str, name: str) -> Iterator[tuple[str | None, str]]:
        """Value and path of each folder name=value that is asked for."""
        fs, root = _open(self.path)
        for found in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}{folder}")):
            key, _, value = found.base_name.partition("=")
            value = None if value == NO_VALUE else unquote(value)
            if key == name and (name not in self.asked or value in self.asked[name]):
                yield value, f"{folder}/{found.base_name}"

    def partitions(self) -> list[InputPartition]:
        return [Group(source, country, folder) for source, outer in sorted(self._groups("", "source"), key=str) for country, folder in sorted(self._groups(outer, "country"), key=str)]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, root = _open(self.path)
        counts: dict[int | None, int] = {}
        for found in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}{partition.folder}")):
            if not found.base_name.endswith(".parquet"):
                continue
            with fs.open_input_file(found.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=["year"]):
                    years = batch.column("year").cast(pa.int32())
                    for name, value in self.bounds:
                        years = years.filter(next(test for kind, test in BOUNDS.items() if kind.__name__ == name)(years, value))
                    for each in years.value_counts():
                        counts[each["values"].as_py()] = counts.get(each["values"].as_py(), 0) + each["counts"].as_py()
        n = len(counts)
        columns = [pa.array([partition.source] * n, pa.string()), pa.array([partition.country] * n, pa.string()), pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["source", "country", "year", "publication_count"])


class YearlyCounts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "yearly_counts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CountsReader:
        return CountsReader(self.options["path"].rstrip("/"))


def yearly_counts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: source, country, year, publication_count of the works in a folder. Turns on filters of Python data sources for the session, which Spark leaves off."""
    spark.dataSource.register(YearlyCounts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("yearly_counts").load(path)


def write_works(works: DataFrame, path: str) -> None:
    """Works (source, country, year) as the folders that are counted."""
    works.select("source", "country", "year").repartition("source", "country").write.partitionBy("source", "country").parquet(path)
