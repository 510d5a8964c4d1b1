"""All queries of the library by name, with their DuckDB twins."""

from __future__ import annotations

from . import analytics_queries, evidence_queries, file_queries, gap_queries, report_queries, source_queries, text_queries, transfer_queries  # noqa: F401
from .base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
