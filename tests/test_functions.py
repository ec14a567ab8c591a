import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoreline.functions import (
    count_equal, ieee_divide, na_sum, na_text, recode_chain, replace_first, split_tokens,
    sum_or_zero, trim_unicode,
)


def one(spark, expr, value, dtype=T.StringType()):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("x", dtype)]))
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value,expected", [
    ("BRBR", "WIBR"), ("a\nBR BR", "a\nWI BR"), ("zz", "zz"), (None, None), ("xBR", "xWI"),
])
def test_replace_first_literal(spark, value, expected):
    assert one(spark, lambda c: replace_first(c, "BR", "WI"), value) == expected


def test_replace_first_quotes_literals(spark):
    got = one(spark, lambda c: replace_first(c, "a.b", "$1\\", literal=True), "axb a.b a.b")
    assert got == "axb $1\\ a.b"


def test_replace_first_regex_groups(spark):
    # groups in pattern and replacement refer to the caller's pattern
    assert one(spark, lambda c: replace_first(c, "(\\d)(\\d)", "$2$1"), "a12b34") == "a21b34"
    assert one(spark, lambda c: replace_first(c, "(o)\\1", "0"), "foo boo") == "f0 boo"
    assert one(spark, lambda c: replace_first(c, "[AEIOU]", "*"), "ECONOMY") == "*CONOMY"


def test_recode_chain_applies_once_in_order(spark):
    pairs = [("ENTERO", "ENTEROCOCCI")]
    assert one(spark, lambda c: recode_chain(c, pairs), "ENTERO") == "ENTEROCOCCI"
    # applying the chain twice is not the same (not idempotent)
    assert one(spark, lambda c: recode_chain(recode_chain(c, pairs), pairs), "ENTERO") == "ENTEROCOCCICOCCI"
    assert one(spark, lambda c: recode_chain(c, [("e", "E"), ("E", "3")]), "red e") == "r3d e"


def test_replace_first_empty_pattern_rejected():
    with pytest.raises(ValueError):
        replace_first(F.col("x"), "", "a")


def test_trim_unicode(spark):
    assert one(spark, trim_unicode, "\t a  ") == "a"
    assert one(spark, trim_unicode, " a b ") == "a b"
    assert one(spark, trim_unicode, " x\n") == "x"
    assert one(spark, trim_unicode, None) is None


@pytest.mark.parametrize("value,expected", [
    ("a,", ["a", ""]), (",a", ["", "a"]), (None, [None]), ("a", ["a"]), ("", [""]),
])
def test_split_tokens_keeps_empty_and_null(spark, value, expected):
    assert one(spark, split_tokens, value) == expected


def test_na_text(spark):
    assert one(spark, na_text, None) == "NA"
    assert one(spark, na_text, 5, T.LongType()) == "5"


@pytest.mark.parametrize("n,d,expected", [
    (1.0, 2.0, 0.5), (1.0, 0.0, math.inf), (-1.0, 0.0, -math.inf), (0.0, 0.0, "nan"),
    (None, 0.0, None), (1.0, None, None),
])
def test_ieee_divide(spark, n, d, expected):
    df = spark.createDataFrame([(n, d)], "n double, d double")
    got = df.select(ieee_divide("n", "d").alias("r")).first()["r"]
    if expected == "nan":
        assert math.isnan(got)
    else:
        assert got == expected


def test_na_sum_and_sum_or_zero(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3), ("c", None)],
                               "k string, v long")
    got = {r["k"]: (r["s"], r["z"]) for r in
           df.groupBy("k").agg(na_sum("v").alias("s"), sum_or_zero("v").alias("z")).collect()}
    assert got == {"a": (None, 1), "b": (5, 5), "c": (None, 0)}


def test_count_equal_propagates_na(spark):
    df = spark.createDataFrame([("a", "Closure"), ("a", None), ("b", "Closure"), ("b", "Rain")],
                               "k string, t string")
    got = {r["k"]: r["n"] for r in df.groupBy("k").agg(count_equal("t", "Closure").alias("n")).collect()}
    assert got == {"a": None, "b": 1}


def test_replace_first_whole_match_reference(spark):
    assert one(spark, lambda c: replace_first(c, "(b)c", "[$0]"), "abcabc") == "a[bc]abc"
    assert one(spark, lambda c: replace_first(c, "(b)(c)", "$2$1"), "abcabc") == "acbabc"


@pytest.mark.parametrize("n,d,expected", [
    (float("nan"), 0.0, "nan"), (1.0, -0.0, -math.inf), (-1.0, -0.0, math.inf),
    (float("inf"), 0.0, math.inf), (0.0, -0.0, "nan"), (2.0, float("nan"), "nan"),
])
def test_ieee_divide_signed_zero_and_nan(spark, n, d, expected):
    df = spark.createDataFrame([(n, d)], "n double, d double")
    got = df.select(ieee_divide("n", "d").alias("r")).first()["r"]
    assert math.isnan(got) if expected == "nan" else got == expected


def test_replace_first_replacement_starting_with_digit(spark):
    pattern = "(a)(b)(c)(d)(e)(f)(g)(h)"
    assert one(spark, lambda c: replace_first(c, pattern, "0-$1"), "xabcdefghy") == "x0-ay"
