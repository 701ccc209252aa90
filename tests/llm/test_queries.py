import duckdb
import pytest

import __spark_entry__ as entry
from quillseek.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(Q.queries()) <= set(entry.queries()) and set(Q.oracle_sql()) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries() if n != "pipeline") == list(range(1, 11)) and "pipeline" in Q.queries()


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = Q.queries()[name](spark, SF).toPandas(), con.sql(Q.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert plain(got).equals(plain(want))


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql()) - {"pipeline"}))
def test_others_run(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0
