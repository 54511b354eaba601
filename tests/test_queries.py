"""Every registered query of the core library against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value if isinstance(value, (int, str, bool)) else str(value)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    found = catalogue.QUERIES[name](spark, sf)
    columns, rows = sorted(found.columns), found.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    reply = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in reply.description]
    assert sorted(names) == columns
    wanted = [repr([plain(r[names.index(c)]) for c in columns]) for r in reply.fetchall()]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in rows) == sorted(wanted)
