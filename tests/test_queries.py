"""Every registered query of the evidence operators against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from asofly.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    got = sorted((str([plain(v) for v in r]) for r in df.select(*columns).collect()))
    sql = registry.oracle_sql().get(name)
    if sql:
        want = db.sql(f"SELECT {quoted} FROM ({sql})").fetchall()
        assert got == sorted(str([plain(v) for v in r]) for r in want)
    else:
        assert got
