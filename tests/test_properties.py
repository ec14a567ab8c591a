"""Randomised checks against a brute force that builds the long table literally.

The brute force follows the reference's steps: rows in file order, each row
split on its three lists in sequence (cross product), elements trimmed and
normalised, then per key the distinct values in order of appearance, and
counts over the long table.
"""

import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoreline.operators.aggregate import ordered_distinct_concat, site_lists_with_counts
from shoreline.operators.explode import token_frequency

TOKENS = ["x", " y", "Y", "z ", "", "w "]
KEYS = ["a", "b", None]
LISTS = ["l1", "l2", "l3"]


def norm(v):
    return None if v is None else v.strip().upper()


def parts(s):
    return [None] if s is None else s.split(",")


def brute(rows):
    """rows: (key, ord, l1, l2, l3, days) -> per key: lists, n, days."""
    out = {}
    for key, _, *ls, days in sorted(rows, key=lambda r: r[1]):
        o = out.setdefault(key, {"lists": {c: [] for c in LISTS}, "n": 0, "days": 0})
        o["n"] += 1
        o["days"] = None if o["days"] is None or days is None else o["days"] + days
        for combo in itertools.product(*[parts(x) for x in ls]):
            for c, v in zip(LISTS, combo):
                v = norm(v)
                if v not in o["lists"][c]:
                    o["lists"][c].append(v)
    return {k: ({c: ", ".join("NA" if v is None else v for v in vs) for c, vs in o["lists"].items()},
                o["n"], o["days"]) for k, o in out.items()}


list_value = st.one_of(st.none(), st.lists(st.sampled_from(TOKENS), min_size=1, max_size=3).map(",".join))
row = st.tuples(st.sampled_from(KEYS), list_value, list_value, list_value,
                st.one_of(st.none(), st.integers(0, 5)))


def frame(spark, rows):
    order = list(range(len(rows)))
    random.Random(len(rows)).shuffle(order)
    data = [(k, o, a, b, c, d) for o, (k, a, b, c, d) in zip(order, rows)]
    df = spark.createDataFrame(data, "k string, o long, l1 string, l2 string, l3 string, d long")
    return data, df.repartition(3)


NORMALIZE = {c: F.upper for c in LISTS}


@settings(max_examples=12, deadline=None)
@given(st.lists(row, min_size=1, max_size=12))
def test_lists_and_counts_match_brute_force(spark, rows):
    data, df = frame(spark, rows)
    expected = brute(data)
    lists = ordered_distinct_concat(df, ["k"], {c: c for c in LISTS}, "o", normalize=NORMALIZE)
    got = {r["k"]: {c: r[c] for c in LISTS} for r in lists.collect()}
    assert got == {k: v[0] for k, v in expected.items()}
    fused = site_lists_with_counts(df, ["k"], "k", {c: c for c in LISTS}, "o", "n", {"days": "d"},
                                   normalize=NORMALIZE)
    got = {r["k"]: ({c: r[c] for c in LISTS}, r["n"], r["days"]) for r in fused.collect()}
    assert got == expected


@settings(max_examples=12, deadline=None)
@given(st.lists(row, min_size=1, max_size=12))
def test_weighted_frequency_matches_long_table(spark, rows):
    data, df = frame(spark, rows)
    expected = {}
    for _, _, *ls, _ in data:
        for combo in itertools.product(*[parts(x) for x in ls]):
            v = norm(combo[1])
            expected[v] = expected.get(v, 0) + 1
    got = {r["l2"]: r["n"] for r in
           token_frequency(df, "l2", cross_with=["l1", "l3"], normalize=F.upper).collect()}
    assert got == expected


STATUSES = ["Active", "Historical", "No advisory or closure", "Dormant", None]
site = st.tuples(st.sampled_from(["s1", "s2", "s3"]), st.sampled_from(["n1", None]))


def brute_status(sites, profile, year):
    """sites: (id, name, reasons); profile rows in file order: (id, name, status, year)."""
    seen, snap = set(), []
    for pid, name, status, y in profile:          # first row per (id, status), then the year
        if (pid, status) in seen:
            continue
        seen.add((pid, status))
        if y == year:
            snap.append((pid, name, status))
    out, matched = [], set()
    for sid, sname, reasons in sites:             # full join, NULL matches NULL
        hits = [i for i, (pid, pname, _) in enumerate(snap) if (pid, pname) == (sid, sname)]
        matched.update(hits)
        out += [(sid, sname, reasons, snap[i][2]) for i in hits] or [(sid, sname, reasons, None)]
    out += [(pid, pname, None, st_) for i, (pid, pname, st_) in enumerate(snap) if i not in matched]
    result = []
    for sid, sname, reasons, status in out:
        cond = None if status is None else (status == "Historical")
        cond = (cond and reasons is None) if cond is not None else (None if reasons is None else False)
        if cond is True or cond is None:          # filter(!cond) drops TRUE and NA
            continue
        if status == "No advisory or closure":
            label = "Active" if reasons is not None else "Active: No advisory or closure"
        else:
            label = "NA" if status is None else status
        result.append((sid, sname, reasons, label))
    return sorted(result, key=repr)


@settings(max_examples=12, deadline=None)
@given(st.lists(site, max_size=4, unique=True),
       st.lists(st.tuples(site, st.sampled_from(STATUSES), st.sampled_from([2017, 2018])), max_size=8))
def test_snapshot_and_status_match_brute_force(spark, sites, profile):
    from shoreline.plans.sites import sites_with_status, snapshot

    site_rows = [(sid, name, f"r{i}" if i % 2 == 0 else None) for i, (sid, name) in enumerate(sites)]
    prof_rows = [(sid, name, status, y, i) for i, ((sid, name), status, y) in enumerate(profile)]
    sdf = spark.createDataFrame(site_rows, "id string, name string, reasons string")
    pdf = spark.createDataFrame(prof_rows, "id string, name string, beach_status string, year int, o long")
    snap = snapshot(pdf.repartition(2), "id", "beach_status", "o", "year", 2018,
                    ["id", "name", "beach_status"])
    got = sites_with_status(sdf, snap, ["id", "name"], "beach_status", "reasons")
    got = sorted((tuple(r) for r in got.select("id", "name", "reasons", "status").collect()), key=repr)
    assert got == brute_status(site_rows, [(a, b, c, d) for a, b, c, d, _ in prof_rows], 2018)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab.$\\\n(", max_size=8),
                          st.text(alphabet="ab.$\\(", min_size=1, max_size=3),
                          st.text(alphabet="ab$\\", max_size=3)), min_size=1, max_size=10))
def test_replace_first_matches_python(spark, cases):
    from shoreline.functions.text import replace_first

    df = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(cases)], "i long, s string")
    exprs = [replace_first(F.col("s"), p, r, literal=True).alias(f"r{i}") for i, (_, p, r) in enumerate(cases)]
    got = {row["i"]: row for row in df.select("i", *exprs).collect()}
    for i, (s, p, r) in enumerate(cases):
        assert got[i][f"r{i}"] == s.replace(p, r, 1), (s, p, r)


@settings(max_examples=10, deadline=None)
@given(st.lists(list_value, min_size=1, max_size=12))
def test_shares_match_brute_force(spark, lists):
    from shoreline.operators.aggregate import share_of_total
    from shoreline.operators.explode import token_share

    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i long, l string")
    total = len(lists)
    expected = {}
    for v in lists:
        for tok in {None if t is None else t.strip() for t in parts(v)}:
            expected[tok] = expected.get(tok, 0) + 1
    got = {r["token"]: (r["n"], r["pct"]) for r in token_share(df, "l").collect()}
    assert {k: n for k, (n, _) in got.items()} == expected
    assert all(abs(p - 100.0 * n / total) < 1e-9 for n, p in got.values())
    by_value = {}
    for v in lists:
        by_value[v] = by_value.get(v, 0) + 1
    shares = {r["l"]: (r["n"], r["pct"]) for r in share_of_total(df, ["l"]).collect()}
    assert {k: n for k, (n, _) in shares.items()} == by_value
    assert abs(sum(p for _, p in shares.values()) - 100.0) < 1e-9


@settings(max_examples=10, deadline=None)
@given(st.lists(row, min_size=1, max_size=10))
def test_long_form_is_the_per_row_product(spark, rows):
    from shoreline.operators.explode import long_form

    data, df = frame(spark, rows)
    expected = sorted(
        (o, *[norm(v) for v in combo]) for _, o, *ls, _ in data
        for combo in itertools.product(*[parts(x) for x in ls]))
    got = long_form(df, LISTS, normalize={c: F.upper for c in LISTS}).select("o", *LISTS)
    assert sorted(tuple(r) for r in got.collect()) == expected
