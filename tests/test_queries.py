"""Every registered query against its SQL on the smallest tables."""

import pytest

from stepweave.plans import queries as Q
from stepweave.plans import round_trips


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(name, same_rows):
    same_rows(Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(name, spark):
    assert Q.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_round_trips_are_registered():
    assert {"compiled_index", "record_round_trip", "streamed_validation"} <= {n for n, f in vars(round_trips).items() if n in Q.QUERIES}


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["robot_id", "split", "episodes", "mean_steps"]


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize(("name", "filters", "without"), [
    ("selector_slice", ["GreaterThanOrEqual(l_orderkey,100)", "LessThan(l_orderkey,200)"], ["l_returnflag", "o_totalprice"]),
    ("eval_metrics", [], ["o_orderdate"]), ("json_properties", [], ["user_id", "value"]), ("conversation_episodes", [], []),
])
def test_filters_and_columns_reach_the_scan(spark, name, filters, without):
    text = plan(Q.QUERIES[name](spark, "/root/testdata/sf0.001")).split("== Physical Plan ==")[1]
    scans = [x for x in text.splitlines() if "FileScan parquet" in x]
    assert scans and all(f in "".join(scans) for f in filters) and not any(f"{c}:" in x.split("ReadSchema")[1] for c in without for x in scans)
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text


def test_one_sort_for_rules_in_order(spark):
    from stepweave.operators import validators as V
    from stepweave.sources import adapters as S

    steps = S.conversation_steps(spark, "/root/testdata/sf0.001")
    text = plan(V.in_order(steps, {"rlds_invariants", "episode_length", "timestamps"})).split("== Physical Plan ==")[1]
    assert text.count("Exchange hashpartitioning") <= 2 and text.count("FileScan") == 1
