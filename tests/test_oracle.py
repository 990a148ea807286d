"""Every registered query against its SQL twin."""

import pytest
from conftest import DATA, plan_of

import __spark_entry__ as contract
from eventlift.sources.workspace import Workspace

# The training-data operators have tests of their own.
QUERIES = {k: v for k, v in contract.queries().items() if k not in contract.LLM_QUERIES}
ORACLE = {k: v for k, v in contract.oracle_sql().items() if k not in contract.LLM_ORACLES}


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.fixture()
def plans(monkeypatch):
    """The plans of all steps that are written during the test."""
    written, stage = [], Workspace.stage

    def recorded(self, df, name):
        written.append(plan_of(df))
        return stage(self, df, name)

    monkeypatch.setattr(Workspace, "stage", recorded)
    return written


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, plans, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.01")
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    places = [names.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in places) for r in result.fetchall()), key=repr)
    assert found == expected
    for plan in [*plans, plan_of(df)]:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_order_of_reports(spark):
    paths = QUERIES["membership_transitions"](spark, f"{DATA}/sf0.01").collect()
    assert [p.user_count for p in paths] == sorted((p.user_count for p in paths), reverse=True)


def test_entry(spark):
    assert contract.entry(spark).count() == 2
