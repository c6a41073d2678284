"""Physical plans: the catalog is broadcast, filters reach the scan."""

import re

import pytest

from conftest import SMALL
from liftlake.operators import history
from liftlake.plans import registry
from liftlake.sources.tables import Tables, dimension

BY_CATALOG = ["set_label", "split_focus_rpc", "entry_preview", "validate_log", "today_overview", "attach_workouts", "structured_log",
              "muscle_session_overview", "no_history_exercises", "allowed_catalog", "log_join", "log_summary_text"]


@pytest.fixture
def no_size_estimate(spark):
    """As if the files were so large that no join side looks small."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "1")
    yield
    for n in names:
        spark.conf.unset(n)


@pytest.mark.parametrize("name", BY_CATALOG)
def test_facts_are_not_shuffled_on_the_catalog(spark, no_size_estimate, name):
    df = registry.run(name, spark, SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((exercise_id|slug|muscle_group|exercise_id#\d+L?|slug#\d+|muscle_group#\d+), ", plan)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_a_large_dimension_is_left_alone(spark):
    df = spark.range(20)
    assert dimension(df, 10) is df
    assert dimension(df, 30).count() == 20


def test_date_filter_reaches_the_scan(spark):
    plan = history.scan_log(Tables(spark, SMALL), start="1996-01-01")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(o_orderdate,1996-01-01", plan), re.findall("PushedFilters: [^]]*]", plan)


@pytest.mark.parametrize("name", ["today_overview", "muscle_session_overview", "last_log_capped"])
def test_sets_are_restricted_before_they_are_aggregated(spark, name):
    plan = registry.run(name, spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # In a printed plan a node's children follow it, deeper: below the aggregate of sets stands a semi join.
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if "Aggregate [workout_id" in x and "exercise_id" in x)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    below = []
    for x in lines[at + 1:]:
        if len(x) - len(x.lstrip(" :+-")) <= depth:
            break
        below.append(x)
    assert any("Join LeftSemi" in x for x in below)


def test_shuffle_partitions_follow_the_input(spark):
    from liftlake.sources.tables import SOURCE_SCHEMAS, size_shuffles

    keys = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(k, None) for k in keys]
    try:
        size_shuffles(spark, ["/root/testdata/sf0.001/lineitem.parquet"])
        assert spark.conf.get(keys[0], None) == before[0]  # small input leaves the session as it is
        size_shuffles(spark, [f"/root/testdata/sf0.001/{name}.parquet" for name in SOURCE_SCHEMAS], each=4096)
        assert int(spark.conf.get(keys[0])) > 4
    finally:
        for k, v in zip(keys, before):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
