"""Every query with SQL against DuckDB, on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from tidemill.queries import ORACLES, QUERIES


def shown(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return f"{float(v):.6g}" if isinstance(v, float | decimal.Decimal) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, duck, name):
    ours = QUERIES[name](spark, sf)
    theirs = duck.sql(ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda found: sorted(tuple(map(shown, r)) for r in found)
    assert rows(ours.select(*columns).collect()) == rows(theirs.select(*[f'"{c}"' for c in columns]).fetchall())
