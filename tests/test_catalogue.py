"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quadrille.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def key(row):
    return tuple((x is None, round(x, 6) if isinstance(x, float) else str(x)) for x in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    answer = con.execute(catalogue.SQL[name])
    names = [d[0] for d in answer.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted((tuple(r[i] for i in order) for r in answer.fetchall()), key=key)
    assert cols == sorted(names)
    assert len(got) == len(want)
    assert all(same(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))
