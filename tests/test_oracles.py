"""Every query that SQL can say, against an independent engine on the same tables."""

import math

import duckdb
import pytest

from lodeworks.plans import load

from .conftest import DATA

QUERIES, ORACLES = load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(map(plain, r)) for r in got.select(*names).collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
