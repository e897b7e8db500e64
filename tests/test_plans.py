"""What the physical plans must not contain, and what the scans must."""

import re

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
BANNED = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
          "FlatMapGroupsInPandas", "Scan ExistingRDD", "rand("]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_bottleneck(spark, small, name):
    text = physical(QUERIES[name](spark, small))
    found = [b for b in BANNED if b in text]
    assert not found
    # a window over one single partition would put a whole table into one task
    assert not re.search(r"Window \[.*\n.*Sort .*\n[^\n]*Exchange SinglePartition", text)


def scan_of(text: str, table: str) -> str:
    return next(line for line in text.splitlines() if "FileScan" in line and table in line)


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = QUERIES["agg8_variant_spread"](spark, small)._jdf.queryExecution().executedPlan().toString()
    line = scan_of(plan, "lineitem")
    assert "GreaterThanOrEqual(l_shipdate" in line
    assert "l_comment" not in line and "l_tax" not in line and "l_discount" not in line
    plan = QUERIES["win13_exposure"](spark, small)._jdf.queryExecution().executedPlan().toString()
    views = [l for l in plan.splitlines() if "FileScan" in l and "EqualTo(event_type,view)" in l]
    assert views and all("GreaterThanOrEqual(ts" in l for l in views)


def test_top_rows_are_cut_before_the_shuffle(spark, small):
    for name in ("top2_top_k_per", "win5_latest", "win6_latest_ties", "win7_last_n_stats", "win8_regressions"):
        assert "WindowGroupLimit" in physical(QUERIES[name](spark, small)), name


def test_ordered_scan_needs_one_shuffle_of_the_table(spark, small):
    df = QUERIES["win1_gaps"](spark, small)
    df.collect()
    final = physical(df).split("+- == Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1
