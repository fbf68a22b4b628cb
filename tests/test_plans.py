"""Plan shape guards: the scale properties the design relies on."""

import re

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
HEADLINE = ["delivery_plan", "relay_step", "jobs_with_blocks", "build_payload", "put_blocks", "tiered_get_blocks",
            "tiered_latest_blocks", "latest_n_per_chain", "webhook_pages", "check_ascending", "height_gaps",
            "attempt_number", "consume_billing_events", "entitlement", "get_blocks", "current_failures"]


def _final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]


@pytest.mark.parametrize("key", HEADLINE)
def test_no_nested_loops_or_python(spark, small_dir, key):
    plan = _final_plan(QUERIES[key](spark, small_dir))
    assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", plan)
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas", plan)


@pytest.mark.parametrize("key", ["latest_n_per_chain", "tiered_latest_blocks", "webhook_pages"])
def test_top_n_is_a_group_limit(spark, small_dir, key):
    assert "WindowGroupLimit" in _final_plan(QUERIES[key](spark, small_dir))


def test_range_read_is_bucketed_equi_join(spark, small_dir):
    plan = _final_plan(QUERIES["get_blocks"](spark, small_dir))
    assert re.search(r"HashJoin .*_rb", plan) or "_rb" in plan
