import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def value(x):
    if x is None or x != x:
        return None
    return round(float(x), 9) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    rows = [tuple(value(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    if name in entry.oracle_sql():
        want = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        expected = [tuple(value(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall()]
        assert sorted(map(repr, rows)) == sorted(map(repr, expected))
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
