"""Queries with SQL against DuckDB, columns and types included."""

import duckdb
import pytest

from quillspark.llm import queries as Q
from tests.oracle_check import TABLES, canon, type_mismatches

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(Q.ORACLES[name])
    columns, types, rows = rel.columns, rel.types, rel.fetchall()
    df = Q.QUERIES[name](spark, SF)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(columns, rows)
    assert type_mismatches(df.schema, columns, types) == []
