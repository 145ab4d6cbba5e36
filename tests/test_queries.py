"""Every registered query against its SQL, and its plan against what must not appear."""

import pytest

from checks import oracle
from checks.queries import QUERIES
from checks.runall import compare

from conftest import SF_DIR

SQLS = oracle.all_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQLS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython") if bad in plan]
    ok, note = compare(df, con, SQLS[name])
    assert ok, note
