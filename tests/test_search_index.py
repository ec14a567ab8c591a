"""The page's patterns, the index of text pieces, and pruning by state."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shoreline.functions.pattern import END, START, needed_grams, parse, to_java
from shoreline.operators.search import distinct_sorted, lookup
from shoreline.operators.search_index import build, candidates, find

# pattern, texts that the page finds it in, texts that it does not
DIALECT = [
    ("Virginia", ["Virginia", "West Virginia"], ["virginia", ""]),
    (r"a\sb", ["a b", "a b", "a b", "a﻿b", "a\tb"], ["ab"]),
    (r"a\Sb", ["axb"], ["a b", "a b"]),
    (r"[\s]x", [" x"], ["ax"]),
    (r"[^\s]x", ["ax"], [" x", "x"]),
    (r"[\S]x", ["ax"], [" x"]),
    ("a$", ["ba"], ["a\n", "ab"]),
    ("^a", ["ab"], ["b\na", "ba"]),
    ("a.b", ["axb", "a\u0085b"], ["a\nb", "a b"]),
    ("[[]", ["x[y"], ["x]y"]),
    ("[a&&b]", ["&", "a", "b"], ["c"]),
    ("[]", [], ["", "a"]),
    ("[^]", ["\n", "a"], [""]),
    (r"\bcat\b", ["a cat.", "cat"], ["cats", "cat_"]),
    (r"\Bat", ["cat"], ["at"]),
    (r"[\b]", ["a\bc"], ["abc"]),
    ("x{,2}", ["x{,2}"], ["xx"]),
    ("x{", ["x{"], ["x"]),
    ("x{2}y", ["axxy"], ["xy"]),
    ("a{0}b", ["b"], ["a"]),
    (r"\x41B", ["AB"], ["x41u0042"]),
    (r"\xZ\u{2}", ["xZuu"], ["xZu"]),
    (r"\a\e\z\Q\G\h\R\p", ["aezQGhRp"], ["\x07"]),
    (r"\0", ["a\x00"], ["a0"]),
    (r"\cJ", ["a\nb"], ["cJ"]),
    (r"[\c]", ["\\", "c"], ["d"]),
    (r"[\w-a]+$", ["x-a_9"], ["x+"]),
    ("]}", ["a]}"], ["]"]),
    (r"\/", ["a/b"], ["ab"]),
    ("(?<n>ab)+c", ["ababc"], ["ab"]),
    ("a(?=b)", ["ab"], ["ac"]),
    ("(?<!a)b", ["cb"], ["ab"]),
    ("a|", ["", "x"], []),
    ("colou?r|gr[ae]y", ["color", "colour", "grey"], ["gry"]),
    ("#x y", ["#x y"], ["#xy"]),
    (r"\d+\.\d", ["12.5"], ["١.٢", "12x5"]),
    ("\U0001f600", ["a\U0001f600"], ["a"]),
]


@pytest.mark.parametrize("pattern, found, other", DIALECT, ids=[p for p, _, _ in DIALECT])
def test_patterns_of_the_page(spark, pattern, found, other):
    texts = spark.createDataFrame([(t, True) for t in found] + [(t, False) for t in other], "t string, yes boolean")
    wrong = texts.filter(F.col("t").rlike(to_java(pattern)) != F.col("yes")).collect()
    assert wrong == []
    ways = needed_grams(pattern)
    if ways is not None:
        for t in found:
            assert any(all(g in START + t + END for g in way) for way in ways), (pattern, t)


@pytest.mark.parametrize("pattern", ["(", ")", "a)", "*a", "a**", "a*+", "a{2}{3}", "a{2,1}", "[b-a]", "[a", "\\", "(?i)a", "(?>a)", "(?#x)",
                                     r"(a)\1", r"(?<n>a)\k<n>", "(?<=a*)b", "^*", "[\U0001f600]", "\U0001f600+", r"\ud83d"])
def test_patterns_without_an_equal_are_refused(pattern):
    with pytest.raises(ValueError, match="pattern"):
        to_java(pattern)


def test_needed_grams():
    assert needed_grams("elevated|^b1") == [frozenset({"\x02b1"}), frozenset({"ele", "lev", "eva", "vat", "ate", "ted"})]
    assert needed_grams("ab") is None and needed_grams("abc|x") is None and needed_grams("a.*b") is None and needed_grams("") is None
    assert needed_grams("(abc|def)ghi") == [frozenset({"abc", "ghi"}), frozenset({"def", "ghi"})]
    assert needed_grams("abcd?") == [frozenset({"abc"})]
    assert needed_grams("ab+cd") == [frozenset({"bcd"})]
    assert needed_grams("yz$") == [frozenset({"yz\x03"})]
    assert parse("a|b|")[2] == []


def records(spark, n=3000, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(400)]
    states = ["Virginia", "West Virginia", "Ohio", "Utah", "New York", "", None, "NA", "2018", "a/b=c", "Hawaiʻi"]
    rows = [(f"B{i}", rng.choice(states), " ".join(rng.choices(words, k=4)).title(), rng.choice([None, "ELEVATED", "x"]), i) for i in range(n)]
    return spark.createDataFrame(rows, "bi string, s string, r string, st string, na int"), words


FIELDS = ["bi", "s", "r", "st", "na"]


def test_indexed_lookup_equals_the_scan(spark, tmp_dir):
    df, words = records(spark)
    index = build(df, f"{tmp_dir}/index", "s", FIELDS, ["r"], block_rows=64, buckets=8)
    key = lambda x: sorted(map(tuple, x.collect()), key=str)
    assert key(index.records().select(*df.columns)) == key(df)
    terms = [words[0], words[1].upper(), f"{words[2]}|^b77", "^b1", "77$", "elev", ".", "a", f"{words[3][:3]}.*{words[4]}", "(?:vir|oh)i", "zzzzz", "na$"]
    for state in ("Virginia", "a", "", "2018", "a/b=c", "^$", "NA|Utah", "Hawai"):
        for term in (terms if state == "Virginia" else terms[:3] + [""]):
            assert key(find(index, state, term)) == key(lookup(df, "s", state, term, FIELDS, ["r"])), (state, term)


def test_a_lookup_reads_a_fraction(spark, tmp_dir):
    df, words = records(spark, 6000)
    index = build(df, f"{tmp_dir}/index", "s", FIELDS, ["r"], block_rows=32, buckets=16)
    some = candidates(index, "b1234$")
    assert 0 < some.count() < 10
    blocks = [r["__block"] for r in some.select("__block").distinct().collect()]
    assert index.records().filter(F.col("__block").isin(blocks)).count() < 600
    assert index.postings().filter(F.col("bucket").isin([1])).count() < index.postings().count() / 4
    plan = find(index, "Virginia", "b1234$")._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?), PushedFilters", plan)
    assert any("RLIKE(__state" in f and "__block" in f for f in filters) and any("bucket" in f for f in filters)
    assert candidates(index, "a") is None


def test_only_folders_of_matching_states_are_read(spark, tmp_dir):
    df, _ = records(spark, 2000)
    index = build(df.filter("s is not null and s <> ''"), f"{tmp_dir}/index", "s", FIELDS, ["r"])
    found = find(index, "Virginia", "")
    assert {r["s"] for r in found.select("s").distinct().collect()} == {"Virginia", "West Virginia"}
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*RLIKE\(__state#\d+, Virginia\)", scan)


def test_states_sort_by_utf16_units(spark):
    states = ["b", "ﬁ", "\U0001f600", "a", "é", "B"]
    df = spark.createDataFrame([(s,) for s in states] * 2, "s string")
    page = sorted(set(states), key=lambda s: s.encode("utf-16-be"))
    assert [r["s"] for r in distinct_sorted(df, "s", utf16=True).collect()] == page
    assert [r["s"] for r in distinct_sorted(df, "s").collect()] == sorted(set(states)) != page


def test_postings_are_rows_of_64_records(spark, tmp_dir):
    """Texts of many records give a row a piece and word of 64 records, not a row a piece and record."""
    n = 2000
    df = spark.createDataFrame([(f"B{i}", "Virginia" if i % 2 else None, "elevated bacteria, RAINFALL", None if i % 5 else "Active", i % 7)
                                for i in range(n)], "bi string, s string, r string, st string, na int")
    index = build(df, f"{tmp_dir}/index", "s", FIELDS, ["r"], block_rows=256, buckets=8)
    grams = {t[i:i + 3] for x in df.collect() for t in (START + str(v).lower() + END for v in x if v is not None) for i in range(len(t) - 2)}
    assert {x["gram"] for x in index.postings().select("gram").distinct().collect()} == grams
    common = index.postings().filter(F.col("gram") == "rai")
    assert common.count() < n / 16 and common.agg(F.sum(F.bit_count("bits"))).first()[0] == n
    for term, many in (("rainfall", n), ("^b1999$", 1), ("active", 400), ("virginia", 1000), ("^b1999$|^b1888$", 2), ("zzz", 0)):
        kept = candidates(index, term)
        assert kept.count() == kept.select("__id").distinct().count() == many, term
        assert find(index, "Virginia", term).count() == lookup(df, "s", "Virginia", term, FIELDS, ["r"]).count()
