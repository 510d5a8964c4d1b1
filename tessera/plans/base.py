"""Registration of queries with their DuckDB twins, and the inputs that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; sql is the same query for DuckDB."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Citation-like strings made of part names, in eight shapes; the same text for both engines.
CITATIONS = """
SELECT p_partkey AS ref_id, p_partkey % 97 AS record_id, 1900 + p_partkey % 125 AS cited_year,
  CASE p_partkey % 8
    WHEN 0 THEN '[' || p_size || '] Smith J, ' || p_name || ', Physical Review ' || p_size || ', ' || (1900 + p_partkey % 125) || '. doi 10.' || (1000 + p_partkey) || '/ABC.' || p_partkey || ').'
    WHEN 1 THEN p_size || '. Meyer K. et al. ' || p_name || '. Nature ' || p_size || ':' || p_partkey || ' (' || (1900 + p_partkey % 125) || ')'
    WHEN 2 THEN p_name || ', Cambridge University Press, ' || (1900 + p_partkey % 125)
    WHEN 3 THEN 'Additional information on ' || p_name || ' websites and books and videos'
    WHEN 4 THEN 'The ' || p_brand || ' exhibition, www.' || p_partkey || '.example'
    WHEN 5 THEN 'Zeitschrift fuer ' || p_name || ' 12, ' || p_size || ' (' || (1880 + p_partkey % 70) || '), see also ' || (1900 + p_partkey % 125)
    WHEN 6 THEN 'https://doi.org/10.' || (1000 + p_partkey) || '/x-' || p_size || ';'
    ELSE 'Delivered in Stockholm: ' || p_name END AS reference_text,
  CASE p_partkey % 5 WHEN 0 THEN 'scientific_background' WHEN 1 THEN 'nobel_lecture' ELSE 'other_pdf' END AS pdf_type,
  p_name AS title, p_brand AS source
FROM {part}"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CITATIONS, part=table(spark, sf_dir, "part"))


def with_inputs(sql: str, **inputs: str) -> str:
    """A DuckDB query over named inputs (WITH clauses)."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in inputs.items()) + " " + sql


CITATIONS_SQL = CITATIONS.format(part="part")
