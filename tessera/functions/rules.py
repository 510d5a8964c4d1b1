"""Ordered rule tables as column expressions: the first rule that holds names all outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: list[tuple[Column | None, tuple]], names: tuple[str, ...]) -> list[Column]:
    """One column for each name; a rule without condition is the default."""
    out = []
    for k, name in enumerate(names):
        column = None
        for condition, values in rules:
            value = values[k] if isinstance(values[k], Column) else F.lit(values[k])
            if condition is None:
                column = value if column is None else column.otherwise(value)
            else:
                column = F.when(condition, value) if column is None else column.when(condition, value)
        out.append(column.alias(name))
    return out


def hits(x: Column, phrases: list[str]) -> Column:
    """How many of the phrases a text contains."""
    total = F.lit(0)
    for p in phrases:
        total = total + F.contains(x, F.lit(p)).cast("int")
    return total


def contains_any(x: Column, phrases: list[str]) -> Column:
    return hits(x, phrases) > 0


def joined_reasons(*pairs: tuple[Column, str]) -> Column:
    """The reasons whose conditions hold, joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs])), " | ")
