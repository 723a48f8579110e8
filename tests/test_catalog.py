"""Every registered query of the engine against its SQL."""

import os

import duckdb
import pytest

from foliant.plans import catalog


def connect(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        path = f"{sf}/{t}/*.parquet" if os.path.isdir(f"{sf}/{t}") else f"{sf}/{t}"
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    norm = lambda v: round(float(v), 9) if isinstance(v, float) else v
    return sorted((tuple(map(norm, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = connect(sf).sql(catalog.oracles()[name])
    assert columns == sorted(want.columns)
    assert plain(got.select(columns).collect()) == plain(want.select(*columns).fetchall())


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 112
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
