"""Every query with a SQL oracle must equal the DuckDB result exactly (sf0.001)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from moodweave.plans.queries import REGISTRY
from oracle_harness import compare, duck

QUERIES = {k: v for k, v in E.queries().items() if k in REGISTRY}
ORACLES = {k: v for k, v in E.oracle_sql().items() if k in REGISTRY}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) == set(REGISTRY)
    assert len(QUERIES) == 75


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF_SMALL, QUERIES, ORACLES, con)
    assert "error" not in r, r
    assert r["match"], r
    assert "type_mismatch" not in r, r


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["trait", "e_from", "e_to", "n", "ratio"]
    assert df.count() == 5 * 6 * 6
