"""Every query with SQL, side by side with it; every other one, that it runs."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from quirework import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    found = registry.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
