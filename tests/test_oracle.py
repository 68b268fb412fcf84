"""Every registered query against its DuckDB oracle (sf0.001), a run of the
queries without an oracle, and a look at each physical plan."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.compare import compare, duck

QUERIES = E.queries()
ORACLE = E.oracle_sql()
# Physical operators that would mean a cross product somewhere in the plan.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = _plan(df)
    assert not any(op in plan for op in FORBIDDEN), plan
    result = compare(spark, con, SF_SMALL, name, lambda s, d: df, ORACLE[name])
    assert result["status"] == "OK", result


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_oracle(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert not any(op in _plan(df) for op in FORBIDDEN)
    assert len(df.collect()) > 0


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["auc", "n_valid", "n_pos"]
    assert len(rows) == 1
