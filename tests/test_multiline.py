"""Multi-line reports read in many tasks a file, and headers found by the executors."""

import csv
import io
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoreline.sources.headers import header_groups, header_names
from shoreline.sources.readers import ORDINAL, clean_names, csv_options, read_report, typed
from shoreline.sources.records import report_records

TYPES = {"beach_id": T.StringType(), "note": T.StringType(), "days": T.LongType()}


@pytest.fixture()
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for n in names:
        spark.conf.set(n, "4096")
    yield spark
    for n in names:
        spark.conf.unset(n)


def report(rows, header=("Beach ID", "Note", "Days"), end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue()


def noted(n, seed=1, long_at=()):
    rng = random.Random(seed)
    parts = ["a b", "x,y", 'say "hi"', "line\nbreak", "\n\n", "two\nmore\nlines", "", "NA", "Zoë", "tail \" quote"]
    return [(f"B{i}", "".join(rng.choices(parts, k=rng.randrange(4))) + ("z\n" * 9000 if i in long_at else ""), i) for i in range(n)]


def one_task(spark, path):
    """The report as one task a file reads it, in its order."""
    raw = clean_names(csv_options(spark.read, True).csv(path))
    return [tuple(r) for r in raw.select(*typed(raw, TYPES)).collect()]


def in_order(df):
    rows = df.orderBy(ORDINAL).collect()
    assert len({r[ORDINAL] for r in rows}) == len(rows)
    return [(r["beach_id"], r["note"], r["days"]) for r in rows]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_read_equals_the_one_task_read(small_splits, tmp_dir, end):
    rows = noted(1200, long_at=(300, 301, 800))  # records over several splits
    with open(f"{tmp_dir}/r.csv", "w", newline="") as f:
        f.write("﻿" * (end == "\n") + report(rows, end=end) + end)  # a blank line at the end
    found = read_report(small_splits, f"{tmp_dir}/r.csv", TYPES, multiline=True)
    assert small_splits.read.text(f"{tmp_dir}/r.csv").rdd.getNumPartitions() > 5
    got, expect = in_order(found), one_task(small_splits, f"{tmp_dir}/r.csv")
    assert [g[0] for g in got] == [r[0] for r in rows]
    assert got == expect


def test_splits_without_a_broadcast_give_the_same(small_splits, tmp_dir):
    rows = noted(1500, seed=2, long_at=(300,))
    with open(f"{tmp_dir}/r.csv", "w", newline="") as f:
        f.write(report(rows))
    path, files = f"{tmp_dir}/r.csv", [f"file://{tmp_dir}/r.csv"]
    groups = header_groups(small_splits, path)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(report_records(small_splits, path, files, groups)) == key(report_records(small_splits, path, files, groups, max_broadcast=0))


def test_files_of_several_headers_in_one_plan(small_splits, tmp_dir):
    heads = [("Beach ID", "Note", "Days"), ("Days", "Beach ID", "Note"), ('Beach ID', 'Note', 'Days', 'Two\nlines')]
    expect = []
    for i in range(12):
        rows = noted(200, seed=i)
        head = heads[i % 3]
        order = {"Beach ID": 0, "Note": 1, "Days": 2}
        with open(f"{tmp_dir}/f{i:02}.csv", "w", newline="") as f:
            f.write(report([[r[order[h]] if h in order else f"t{i}" for h in head] for r in rows], head))
        expect += [(r[0], i % 3 == 2) for r in rows]
    df = read_report(small_splits, tmp_dir, TYPES, multiline=True)
    rows = df.orderBy(ORDINAL).collect()
    assert [(r["beach_id"], r["two_lines"] is not None) for r in rows] == expect
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # whole records, and the torn ones, of all headers


def test_a_quote_in_a_plain_field_fails_instead_of_reading_otherwise(spark, tmp_dir):
    with open(f"{tmp_dir}/r.csv", "w") as f:
        f.write('Beach ID,Note,Days\nB1,5" pipe,1\nB2,6" pipe,2\n')
    with pytest.raises(Exception, match="a field that is not quoted"):
        read_report(spark, f"{tmp_dir}/r.csv", TYPES, multiline=True).collect()


def test_other_splits_than_planned_fail(small_splits, tmp_dir):
    with open(f"{tmp_dir}/r.csv", "w", newline="") as f:
        f.write(report(noted(800)))
    df = read_report(small_splits, f"{tmp_dir}/r.csv", TYPES, multiline=True)
    small_splits.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    small_splits.conf.set("spark.sql.files.openCostInBytes", "3000")
    with pytest.raises(Exception, match="read it again"):
        df.select("*").collect()


def test_folder_columns_and_empty_files(spark, tmp_dir):
    import os

    for year in (2017, 2018):
        os.makedirs(f"{tmp_dir}/year={year}")
        with open(f"{tmp_dir}/year={year}/r.csv", "w", newline="") as f:
            f.write(report(noted(5, seed=year)))
    open(f"{tmp_dir}/year=2018/empty.csv", "w").close()
    rows = read_report(spark, tmp_dir, TYPES, multiline=True).collect()
    assert sorted(r["year"] for r in rows) == [2017] * 5 + [2018] * 5
    with open(f"{tmp_dir}/head.csv", "w") as f:
        f.write("Beach ID,Note,Days\n")
    assert read_report(spark, f"{tmp_dir}/head.csv", TYPES, multiline=True).collect() == []


def test_headers_of_many_small_files_take_seconds(spark, tmp_dir):
    heads = [",".join(f"C{j} {k}" for j in range(4)) for k in range(5)]
    for i in range(3000):
        with open(f"{tmp_dir}/f{i:05}.csv", "w") as f:
            f.write(f"{heads[i % 5]}\n1,2,3,4\n")
    began = time.time()
    groups = header_groups(spark, tmp_dir)
    assert time.time() - began < 30
    assert sorted(groups) == sorted(heads) and all(len(g) == 600 for g in groups.values())
    some = [f"{tmp_dir}/f{i:05}.csv" for i in range(20)]
    large = header_groups(spark, some, small=10)  # each in a task of its own
    assert sorted(large) == sorted(heads) and sum(map(len, large.values())) == 20
    # reading them is one job a header, of the files of that header only
    types = {"c0_0": T.LongType()}
    began = time.time()
    assert read_report(spark, tmp_dir, types).count() == 3000 and time.time() - began < 60


def test_header_names_are_those_of_the_reader(spark, tmp_dir):
    for n, head in enumerate(["a, b ,c", 'a,A,"x, y"', ",b,NA", '"two\nlines",b']):
        with open(f"{tmp_dir}/{n}.csv", "w") as f:
            f.write(head + "\n1,2,3\n")
        assert header_names(head) == csv_options(spark.read, True).csv(f"{tmp_dir}/{n}.csv").columns[:len(header_names(head))]


def test_reports_are_read_once_for_all_columns(small_splits, tmp_dir):
    with open(f"{tmp_dir}/r.csv", "w", newline="") as f:
        f.write(report([(f"B{i}", "plain", i) for i in range(2000)]))
    df = read_report(small_splits, f"{tmp_dir}/r.csv", TYPES, multiline=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Exchange hashpartitioning" not in plan  # nothing torn: one narrow pass
    assert df.agg(F.sum("days")).first()[0] == sum(range(2000))
