"""Every query of the engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from tidemark.plans.registry import QUERIES, SQL


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows):
    return sorted(repr([round(x, 4) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, duck, sf_dir):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(tuple(r) for r in got.select(*(f"`{c}`" for c in columns)).collect()) == plain(want.fetchall())
