"""A staged runner over tables (G-01), its preflight (G-02) and its gates (G-03)."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


@dataclass
class Stage:
    """Reads named tables, makes named tables."""

    name: str
    needs: list[str]
    makes: list[str]
    run: Callable[[SparkSession, Tables], Tables]


class GateError(RuntimeError):
    """A quality gate stopped the run."""


@dataclass
class Gate:
    """A condition over a stage's table: an aggregate that must be true."""

    table: str
    name: str
    condition: object


@dataclass
class Pipeline:
    stages: list[Stage]
    gates: list[Gate] = field(default_factory=list)

    def order(self, given: set[str], wanted: str = "all") -> list[Stage]:
        """Stages by data dependency; of one stage, what it needs comes along."""
        done, out, left = set(given), [], list(self.stages)
        while left:
            ready = [s for s in left if set(s.needs) <= done]
            if not ready:
                raise ValueError(f"nothing makes what these need: {[s.name for s in left]}")
            for s in ready:
                out.append(s)
                done |= set(s.makes)
                left.remove(s)
        if wanted == "all":
            return out
        target = next(s for s in out if s.name == wanted)
        names, chosen = set(target.needs), [target]
        for s in reversed(out[: out.index(target)]):
            if names & set(s.makes):
                chosen.append(s)
                names |= set(s.needs)
        return chosen[::-1]

    def run(self, spark: SparkSession, given: Tables, wanted: str = "all", execute: bool = False, store: str | None = None) -> Tables | list[str]:
        """The plan's names unless execute; else all tables. With store, each table is written as Parquet and read again."""
        plan = self.order(set(given), wanted)
        if not execute:
            return [s.name for s in plan]
        tables = dict(given)
        for stage in plan:
            made = stage.run(spark, {n: tables[n] for n in stage.needs})
            for name in stage.makes:
                if store:
                    made[name].write.mode("overwrite").parquet(f"{store}/{name}")
                    made[name] = spark.read.parquet(f"{store}/{name}")
                tables[name] = made[name]
                for gate in self.gates:
                    if gate.table == name and not made[name].agg(F.coalesce(gate.condition, F.lit(True)).alias("ok")).first()["ok"]:
                        raise GateError(f"{stage.name}: {gate.name}")
        return tables


def low_confidence_gate(table: str, column: str = "confidence", most: float = 0.2) -> Gate:
    """Stops where more than a share of rows is of confidence C or D."""
    return Gate(table, f"more than {most:.0%} of {table} at confidence C or D", F.avg(F.col(column).isin("C", "D").cast("double")) <= most)


def preflight(packages: tuple[str, ...] = ("pyspark", "pandas", "pyarrow")) -> list[str]:
    """Names of packages that are missing."""
    return [p for p in packages if importlib.util.find_spec(p) is None]
