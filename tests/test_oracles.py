"""Every registered query with SQL gives DuckDB's rows on the small tables; the others give rows, and are compared with plain versions elsewhere."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tesserae.plans import registry

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"
#: Queries on calls between chunks, of which the smaller tables have none.
RARE = ("idx_05_call_edges", "ret_13_symbol_neighbours")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return float(value)
    try:
        return round(float(value), 5)
    except (TypeError, ValueError):
        return str(value)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, con, name):
    rows = registry.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=str)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    rows = registry.queries()[name](spark, SF if name not in RARE else LARGER)
    assert rows.count() > 0
