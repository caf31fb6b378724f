"""Every registered analytics query that has SQL gives what DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__  # noqa: F401 (registers the queries)
from strandworks.plans import registry

SMALL = Path("/root/testdata/sf0.001")


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else v if isinstance(v, (str, bool)) else float(v)

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, str(SMALL))
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    result = duck.execute(registry.SQL[name])
    columns = [d[0] for d in result.description]
    want = _rows(result.fetchall(), columns)
    assert sorted(columns) == sorted(df.columns) and len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)) for x, y in zip(a, b)), (a, b)
