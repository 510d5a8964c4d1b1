"""The queries of this package against their DuckDB twins."""

import duckdb
import pytest

from tessera.llm import registry
from tests.test_oracles import plain

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in rows)
    theirs = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    assert mine == theirs
