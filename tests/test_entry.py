import duckdb
import pytest

import __spark_entry__ as entry
from quillseek.plans import oracle
from quillseek.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(oracle.SQL) == set(REGISTRY) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_sql_agrees(spark, duck, name):
    got, want = REGISTRY[name](spark, SF).toPandas(), duck.sql(oracle.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert plain(got).equals(plain(want))
