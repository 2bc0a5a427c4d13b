"""Corpus queries whose whole result SQL can express, against DuckDB."""

import duckdb
import pytest

from talentmesh.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op6_jaccard_join", "op7_suffix_dedup", "op9_decontamination"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    cols = ", ".join(got.columns)
    want = con.execute(f"SELECT {cols} FROM ({ORACLE_SQL[name]})").fetchall()
    assert len(want) > 0 and sorted(map(tuple, got.collect())) == sorted(want)
