"""The text operators that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

from quillspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns == columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str)
