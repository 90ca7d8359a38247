"""Every SQL-expressible registered query equals its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.harness import compare, duck_conn

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_conn(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL).toPandas()
    ddf = con.execute(ORACLE[name]).df()
    ok, msg = compare(sdf, ddf)
    assert ok, msg


def test_every_query_has_a_callable():
    q = E.queries()
    assert set(ORACLE) <= set(q)
    assert len(q) >= 100


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3
    assert set(df.columns) == {"model_id", "qhat", "n_cal", "winkler", "coverage", "n"}
