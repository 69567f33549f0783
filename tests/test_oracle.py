"""Every registered query beside its SQL, on the smallest tables; and what plans must not contain."""

import pytest

import __spark_entry__ as E
from decklens import plans
from check import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(E.queries()))
def test_query(spark, con, name):
    df = E.queries()[name](spark, SF)
    if name in ORACLES:
        assert compare(con, ORACLES[name], df).startswith("ok")
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = E.entry(spark).collect()
    scores = [r.deck_score for r in rows]
    assert len(rows) > 0 and scores == sorted(scores, reverse=True)


PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if not n.startswith(("I1_slide_dwell_stream", "I2_page_change_stream", "I4_merge_from_stream", "A15", "A16"))])
def test_plans_stay_in_the_jvm(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [n for n in PYTHON_NODES if n in plan]
