"""Every registered query runs on the smallest tables and gives the rows of its SQL."""

import collections
import datetime
import decimal
import math
import os

import duckdb
import pytest

from loomframe import registry
from loomframe.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime | datetime.date):
        return v.isoformat()[:19]
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    assert sql is not None or rows
    if sql is not None:
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == collections.Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_entry_without_session_or_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['loomframe.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'q1' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
