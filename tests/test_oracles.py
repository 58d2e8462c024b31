"""Every query with SQL must equal it, on whole tables of the smallest data set."""

import math

import duckdb
import pytest

from stratalith.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0) if v else "0.0"
    return [shown(x) for x in v] if isinstance(v, (list, tuple)) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(str([shown(r[c]) for c in cols]) for r in df.collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in sorted(names)]
    assert sorted(names) == cols
    assert got == sorted(str([shown(r[i]) for i in at]) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["label", "sample_name"]


def test_keys():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
