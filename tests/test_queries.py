"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, connect

from lodeglass.workload import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BatchEvalPython" not in plan
    verdict = compare(df, duck.sql(ORACLE[name]))
    assert verdict.startswith("ok ") and "but" not in verdict, verdict


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert {r["kind"] for r in rows} == {"shape", "schema", "missing", "numeric", "string", "temporal"}
    assert entry.queries().keys() >= entry.oracle_sql().keys()
