"""Registered queries: oracle agreement, entry smoke check, plan shape."""

import re

import pytest

import __spark_entry__ as E
from oracle_compare import compare

SF = "/root/testdata/sf0.001"

# the training-data queries have tests of their own
LLM = {n for n in E.queries() if n == "pipeline" or re.match(r"op\d+_", n)}
CORE = sorted(set(E.queries()) - LLM)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 1 and sum(r["state"] == "Total" for r in rows) == 1
    total = [r for r in rows if r["state"] == "Total"][0]
    assert total["n_orders"] == sum(r["n_orders"] for r in rows if r["state"] != "Total")


def test_every_query_has_an_oracle():
    assert set(CORE) == set(E.oracle_sql()) - set(LLM)


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF, CORE)


@pytest.mark.parametrize("name", CORE)
def test_matches_oracle(results, name):
    r = results[name]
    assert "error" not in r and "sql_error" not in r, r
    assert r["rows"] == r["oracle_rows"], r
    assert r["cols"], (r["s_cols"], r["d_cols"])
    assert r["values"], r.get("first_diff")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CORE)
def test_no_python_or_nested_loop(spark, name):
    p = plan(E.queries()[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, (name, bad)


def test_dedupe_uses_group_limit(spark):
    p = plan(E.queries()["dedupe_first_then_filter"](spark, SF))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_filter_reaches_scan(spark):
    p = plan(E.queries()["dedupe_count"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,F))]" in p


def test_first_appearance_uses_hash_aggregate(spark):
    p = plan(E.queries()["ordered_distinct_concat"](spark, SF))
    assert "SortAggregate" not in p and "partial_min_by" in p


def test_column_pruning(spark):
    p = plan(E.queries()["regex_search"](spark, SF))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string,p_type:string,p_size:int>" in p


def test_ordered_queries_are_ordered(spark):
    # the driver compares results without order, so order is checked here
    states = [r["s"] for r in E.queries()["distinct_sorted"](spark, SF).collect()]
    assert states == sorted(states) and len(states) == len(set(states))
    ranked = [r["contam_close"] for r in E.queries()["ranked_sum"](spark, SF).collect()]
    assert ranked == sorted(ranked, reverse=True)
    ranked = [r["contamclose"] for r in E.queries()["beach_states_by_contamination"](spark, SF).collect()]
    assert ranked == sorted(ranked, reverse=True)
    for name, key in (("beach_reason_frequency", "n"), ("share_of_total", "n"), ("token_share", "n"), ("beach_reason_shares", "n")):
        counts = [r[key] for r in E.queries()[name](spark, SF).collect()]
        assert counts == sorted(counts, reverse=True), name


def _jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("built"))


@pytest.mark.parametrize("name", ["share_of_total", "token_share", "beach_reason_shares", "beach_reason_token_shares", "beach_state_sums"])
def test_building_runs_no_job(spark, name):
    spark.sparkContext.setJobGroup("built", name)
    before = _jobs(spark)
    try:
        E.queries()[name](spark, SF)
        assert _jobs(spark) == before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["beach_state_sums", "beach_state_counts", "beach_status_counts", "beach_state_list"])
def test_counting_queries_build_no_lists(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert "Generate" not in p and "collect_list" not in p


def test_orders_are_summed_before_the_customer_join(spark):
    p = plan(E.queries()["year_state_summary"](spark, SF))
    assert p.count("partial_sum(") >= 8  # four sums by customer, four by state
