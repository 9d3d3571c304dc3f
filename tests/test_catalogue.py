"""Every query outside llm against its SQL on the smallest tables, if they are there."""

import os
from collections import Counter

import duckdb
import pytest

from colloquy.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def shown(v):
    return round(v, 9) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = Counter(tuple(shown(r[c]) for c in cols) for r in df.collect())
    if name in catalogue.SQL:
        cur = con.execute(catalogue.SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert rows == Counter(tuple(shown(r[names.index(c)]) for c in cols) for r in cur.fetchall())
