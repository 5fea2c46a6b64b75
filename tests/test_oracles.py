"""Each query with SQL gives the rows of its SQL on the smallest tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def canon(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) else str(v)


def same(spark, con, frame, sql):
    cur = con.execute(sql)
    names, want = [c[0] for c in cur.description], cur.fetchall()
    cols = sorted(frame.columns)
    assert cols == sorted(names)
    at = [names.index(c) for c in cols]
    assert sorted([canon(r[c]) for c in cols] for r in frame.collect()) == sorted([canon(r[i]) for i in at] for r in want)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _names():
    from weftline.plans import registry

    return sorted(registry.ORACLES)


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, con, name):
    from weftline.plans import registry

    same(spark, con, registry.QUERIES[name](spark, DATA), registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
