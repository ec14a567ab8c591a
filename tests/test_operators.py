"""Operator behaviour on small frames: joins, dedupe, lists, skew-shaped plans."""

import pytest
from pyspark.sql import functions as F

from shoreline.operators import (
    dim_lookup, first_by, null_safe_join, ordered_distinct_concat, split_rows, token_frequency,
    with_total_row,
)
from shoreline.operators.aggregate import site_lists_with_counts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def lr(spark):
    left = spark.createDataFrame([("a", None, 1), ("b", "x", 2), (None, None, 3)],
                                 "k1 string, k2 string, v long")
    right = spark.createDataFrame([("a", None, 10), (None, None, 30), ("c", "y", 40)],
                                  "k1 string, k2 string, v long")
    return left, right


def test_null_safe_left(lr):
    left, right = lr
    out = null_safe_join(left, right, ["k1", "k2"], "left")
    assert out.columns == ["k1", "k2", "v_x", "v_y"]
    assert rows(out) == rows(out.sparkSession.createDataFrame(
        [("a", None, 1, 10), ("b", "x", 2, None), (None, None, 3, 30)], "a string, b string, c long, d long"))


def test_null_safe_full_coalesces_keys(lr):
    left, right = lr
    got = {(r["k1"], r["k2"]): (r["v_x"], r["v_y"])
           for r in null_safe_join(left, right, ["k1", "k2"], "full").collect()}
    assert got == {("a", None): (1, 10), ("b", "x"): (2, None), (None, None): (3, 30),
                   ("c", "y"): (None, 40)}


def test_null_safe_inner_and_right(lr):
    left, right = lr
    assert len(null_safe_join(left, right, ["k1", "k2"], "inner").collect()) == 2
    right_keys = {(r["k1"], r["k2"]) for r in null_safe_join(left, right, ["k1", "k2"], "right").collect()}
    assert right_keys == {("a", None), (None, None), ("c", "y")}
    with pytest.raises(ValueError):
        null_safe_join(left, right, ["k1"], "cross")


def test_dim_lookup_missing_code_is_null(spark):
    df = spark.createDataFrame([("WI", 1), ("ZZ", 2), (None, 3)], "state string, n long")
    dim = spark.sql("SELECT * FROM VALUES ('WI', 'Wisconsin') AS t(code, name)")
    got = {r["n"]: r["state"] for r in dim_lookup(df, dim, "state", "code", "name", bounded=True).collect()}
    assert got == {1: "Wisconsin", 2: None, 3: None}


def test_first_by_keeps_first_in_order(spark):
    df = spark.createDataFrame([("a", 3, "late"), ("a", 1, "early"), ("b", 2, "only")],
                               "k string, o long, v string")
    assert rows(first_by(df, ["k"], "o").select("k", "v")) == [("a", "early"), ("b", "only")]


def test_ordered_lists_first_appearance_and_na(spark):
    df = spark.createDataFrame([("s", 2, "b, a"), ("s", 1, "c,b,c"), ("s", 3, None), ("t", 1, "x,")],
                               "k string, o long, l string")
    got = {r["k"]: r["l"] for r in ordered_distinct_concat(df, ["k"], {"l": "l"}, "o").collect()}
    assert got == {"s": "c, b, a, NA", "t": "x, "}


def test_ordered_lists_with_struct_order(spark):
    df = spark.createDataFrame([("s", "f2", 0, "b"), ("s", "f1", 5, "a,b")],
                               "k string, file string, row long, l string")
    order = F.struct("file", "row")
    got = ordered_distinct_concat(df, ["k"], {"l": "l"}, order).first()["l"]
    assert got == "a, b"


def test_raw_variants_merge_after_normalising(spark):
    df = spark.createDataFrame([("s", 1, "CSO , SSO"), ("s", 2, "SSO,CSO")], "k string, o long, l string")
    norm = {"l": lambda c: F.upper(c)}
    assert ordered_distinct_concat(df, ["k"], {"l": "l"}, "o", normalize=norm).first()["l"] == "CSO, SSO"
    freq = {r["l"]: r["n"] for r in token_frequency(df, "l").collect()}
    assert freq == {"CSO": 2, "SSO": 2}


def test_split_rows_positions(spark):
    df = spark.createDataFrame([("a", "x, y"), ("b", None)], "id string, l string")
    got = rows(split_rows(df, "l", trim=True, position_col="pos"))
    assert got == [("a", "x", 0), ("a", "y", 1), ("b", None, 0)]


def test_total_row_fills_text(spark):
    df = spark.createDataFrame([("x", "p", 1, 0.5), ("y", "q", 2, None)], "s string, t string, n long, r double")
    total = [r for r in with_total_row(df, "s").collect() if r["s"] == "Total"][0]
    assert (total["t"], total["n"], total["r"]) == ("-", 3, 0.5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_combined_before_the_shuffle(spark):
    # one site holds a third of the rows
    hot = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("s"), (F.col("id") % 500).cast("string"))).alias("site"),
        F.col("id").alias("o"), F.lit("a,b").alias("l"), (F.col("id") % 7).alias("d"))
    out = site_lists_with_counts(hot, ["site"], "site", {"l": "l"}, "o", "n", {"days": "d"})
    p = plan(out)
    # map-side partial aggregates under the shuffles of the rows, for lists and for counts
    assert "partial_min(" in p and "partial_count" in p[p.rfind("Exchange"):]
    got = {r["site"]: r["n"] for r in out.collect()}
    assert got["HOT"] == 1000 and sum(got.values()) == 3000
    freq = token_frequency(hot, "site")
    assert "partial_sum" in plan(freq)
    assert "WindowGroupLimit" in plan(first_by(hot, ["site"], "o"))


def test_first_by_limits_before_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    p = plan(first_by(df, ["k"], "o"))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_long_form_with_map_column(spark):
    from shoreline.operators import long_form

    df = spark.createDataFrame([("a,b", "x", {"k": 1})], "l1 string, l2 string, m map<string,int>")
    assert long_form(df, ["l1", "l2"]).count() == 2


def test_bounded_broadcast_checks_size(spark, monkeypatch):
    import shoreline.operators.joins as J

    df = spark.createDataFrame([("WI", 1)], "state string, n long")
    dim = spark.sql("SELECT * FROM VALUES ('WI', 'Wisconsin') AS t(code, name)")
    assert "BroadcastHashJoin" in plan(dim_lookup(df, dim, "state", "code", "name", bounded=True))
    unknown = spark.createDataFrame([("WI", "Wisconsin")], "code string, name string")
    assert rows(dim_lookup(df, unknown, "state", "code", "name", bounded=True)) == rows(
        dim_lookup(df, dim, "state", "code", "name", bounded=True))
    monkeypatch.setattr(J, "MAX_BROADCAST_BYTES", 1)  # beyond it there is no hint: the planner decides
    hinted = dim_lookup(df, dim, "state", "code", "name", bounded=True)
    assert "ResolvedHint" not in hinted._jdf.queryExecution().analyzed().toString()
    assert hinted.first()["state"] == "Wisconsin"


def test_site_table_without_measures(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, None)], "k string, o long, l string")
    got = {r["k"]: (r["l"], r["n"]) for r in site_lists_with_counts(df, ["k"], "k", {"l": "l"}, "o", "n").collect()}
    assert got == {"a": ("x, y", 2), "b": ("NA", 1)}


def test_total_row_with_dates_and_ints(spark):
    import datetime

    df = spark.createDataFrame([("x", datetime.date(2018, 1, 1), 2147483647, True)],
                               "s string, d date, i int, b boolean")
    total = [r for r in with_total_row(df, "s").collect() if r["s"] == "Total"][0]
    assert (total["d"], total["i"], total["b"]) == (None, 2147483647, None)
    with pytest.raises(ValueError):
        with_total_row(spark.createDataFrame([(1, 2)], "k int, v int"), "k")
