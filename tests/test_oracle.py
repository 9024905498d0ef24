"""Every query with SQL, against DuckDB on the same tables."""

import math

import duckdb
import pytest

from quillspark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return repr(x)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalog.ORACLE[name])
    columns = [c[0] for c in want.description]
    kinds = {c[0]: str(c[1]) for c in want.description}
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    rows = sorted([plain(r[columns.index(c)]) for c in order] for r in want.fetchall())
    got = sorted([plain(r[c]) for c in order] for r in df.collect())
    assert len(got) == len(rows)
    assert [(a, b) for a, b in zip(got, rows) if a != b][:3] == []
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds


def test_every_query_runs(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name in set(catalog.QUERIES) - set(catalog.ORACLE):
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0
