"""Every audit query runs, gives rows, and agrees with its SQL."""

import math
import os

import duckdb
import pytest

from riskweave import queries

#: The smallest tables have no row for these; sf0.01 has.
EMPTY_HERE = {"pii_pages", "pii_toxic_pairs"}
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RUN, SQL = queries.queries(), queries.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(RUN))
def test_query(spark, con, name):
    df = RUN[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want and (got or name in EMPTY_HERE)


def test_entry_point():
    import __spark_entry__ as e

    assert set(RUN) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
