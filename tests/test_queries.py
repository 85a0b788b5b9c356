"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from quarry import queries as own

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = own.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    cursor = duck.execute(own.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(own.queries()) - set(own.oracle_sql())))
def test_has_rows(spark, name):
    assert own.queries()[name](spark, SF).limit(1).count() == 1
