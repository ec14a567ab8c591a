"""One-file documents, stored site states, frequencies from one scan, header letters."""

import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from shoreline.operators.aggregate import Counts, merge_states, site_lists_with_counts, site_state, site_table
from shoreline.operators.explode import token_frequencies, token_frequency
from shoreline.plans import beaches as B
from shoreline.sinks import document_lines, write_csv_document, write_json_array
from shoreline.sources import snake_name
from test_io import ACTIONS_CSV, PROFILE_CSV, SUMMARY_CSV, write

ROWS = [("b", 'say "hi"', 1.5, None), ("a", "x,y", 2.0, "two\nlines"), (None, " pad ", None, ""), ("é", "NA", 1e20, "z")]


def table(spark, times=1):
    rows = [(k if i == 0 or k is None else f"{k}{i:04}", v, n, w) for i in range(times) for k, v, n, w in ROWS]
    return spark.createDataFrame(rows, "`the key` string, v string, n double, w string").repartition(5)


def test_csv_document_is_one_file_in_order(spark, tmp_dir):
    path = f"{tmp_dir}/out/table.csv"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    places = write_csv_document(table(spark, 300), path, ["the key", "v"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert os.path.isfile(path) and os.listdir(f"{tmp_dir}/out") in (["table.csv"], [".table.csv.crc", "table.csv"], ["table.csv", ".table.csv.crc"])
    raw = open(path, "rb").read()
    assert len(places) > 1 and [at for at, _ in places] == [sum([len(raw.split(b"\n")[0]) + 1, *[n for _, n in places[:i]]]) for i in range(len(places))]
    assert places[-1][0] + places[-1][1] == len(raw)
    rows = list(csv.reader(open(path, newline="")))
    assert rows[0] == ["the key", "v", "n", "w"] and len(rows) == 1201
    keys = [r[0] for r in rows[1:]]
    named = [k for k in keys if k != "NA"]
    assert keys[-1] == "NA" and named == sorted(named)
    assert rows[1:][keys.index("a")] == ["a", "x,y", "2.0", "two\nlines"] and ["b", 'say "hi"', "1.5", "NA"] in rows
    assert [r for r in rows if r[0] == "NA"] == [["NA", " pad ", "NA", ""]] * 300


def test_json_array_is_one_document_in_order(spark, tmp_dir):
    path = f"{tmp_dir}/a.json"
    write_json_array(table(spark, 200), path, ["the key"])
    rows = json.load(open(path))
    assert len(rows) == 800 and rows[0] == {"the key": "a", "v": "x,y", "n": 2.0, "w": "two\nlines"}
    assert rows[-1] == {"v": " pad ", "w": ""}  # missing fields are left out
    write_json_array(table(spark), path, ["the key"], na="NA")  # replaced
    rows = json.load(open(path))
    assert rows[1] == {"the key": "b", "v": 'say "hi"', "n": 1.5, "w": "NA"} and rows[3]["n"] == "NA" and len(rows) == 4


@pytest.mark.parametrize("times", [0, 1])
def test_documents_of_few_rows(spark, tmp_dir, times):
    df = table(spark).limit(times)
    write_json_array(df, f"{tmp_dir}/a.json", ["the key"])
    write_csv_document(df, f"{tmp_dir}/a.csv", ["the key"])
    assert len(json.load(open(f"{tmp_dir}/a.json"))) == times
    assert open(f"{tmp_dir}/a.csv").read().startswith("the key,v,n,w\n")
    assert not glob.glob(f"{tmp_dir}/*.draft")


def test_lines_of_a_document_are_numbered_over_its_splits(spark, tmp_dir):
    with open(f"{tmp_dir}/t.txt", "w") as f:
        f.write("".join(f"line {i}\n" for i in range(5000)))
    for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(n, "5000")
    try:
        df = document_lines(spark, f"{tmp_dir}/t.txt")
        assert [(r["place"], r["line"]) for r in df.orderBy("place").collect()] == [(i, f"line {i}") for i in range(5000)]
    finally:
        for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(n)


def test_reports_as_single_files(spark, tmp_dir):
    for name, text in (("a", ACTIONS_CSV), ("p", PROFILE_CSV), ("s", SUMMARY_CSV)):
        write(f"{tmp_dir}/{name}.csv", text)
    B.run_reports(spark, f"{tmp_dir}/a.csv", f"{tmp_dir}/p.csv", f"{tmp_dir}/s.csv", f"{tmp_dir}/out", multiline=True, single_files=True)
    names = {"beach_actions_clean.csv", "all_beach_vars.csv", "statesums.csv", "graphic1.csv", "graphic2.csv",
             "2017_state_summaries.csv", "2018_state_summaries.csv", "beaches.json", "allbeachesforpub.json"}
    assert {n for n in os.listdir(f"{tmp_dir}/out") if not n.startswith(".")} == names
    read = lambda n: list(csv.reader(open(f"{tmp_dir}/out/{n}", newline="")))
    assert [r[0] for r in read("beach_actions_clean.csv")[1:]] == ["B1", "B1", "B2", "B3", "B3", "B4", "B4"]
    assert [r[0] for r in read("statesums.csv")[1:]] == ["CA", "WA", "WI", "Total"]
    assert [r[:2] for r in read("graphic1.csv")[1:]] == [["Closure", "2017"], ["Closure", "2018"], ["Contamination Advisory", "2018"]]
    sources = [r[0] for r in read("graphic2.csv")[1:]]
    assert sources == sorted(sources[:-1]) + [sources[-1]]
    assert "year" not in read("2018_state_summaries.csv")[0]
    published = json.load(open(f"{tmp_dir}/out/allbeachesforpub.json"))
    assert published[0]["EPA beach ID"] == "B1" and all(len(p) == 13 for p in published)
    assert any("reasons" not in b for b in json.load(open(f"{tmp_dir}/out/beaches.json")))


# --- mergeable state

EVENTS = [("s1", "A", "x,y", 1, "F"), ("s1", "A", "y, z", None, "O"), ("s1", "B", None, 3, "F"), ("s2", "A", "z,x", 4, None),
          (None, "A", "q", 5, "F"), (None, "A", " x ,q", 6, "F"), ("s2", "A", "w,w", 7, "O"), ("s1", "A", "w", 8, "P")]
KEYS, LISTS = ["id", "name"], {"tokens": "toks"}
COUNTS = Counts("n", {"total": "v"}, "kind", {"f": "F", "o": "O"})


def test_merged_states_equal_one_read(spark):
    df = spark.createDataFrame([(*e, i) for i, e in enumerate(EVENTS)], "id string, name string, toks string, v int, kind string, ord long")
    key = lambda x: sorted(map(tuple, x.collect()), key=str)
    whole = site_lists_with_counts(df, KEYS, "id", LISTS, "ord", "n", {"total": "v"}, "kind", {"f": "F", "o": "O"})
    for cut in (0, 3, 5, len(EVENTS)):
        parts = [df.filter(F.col("ord") < cut), df.filter(F.col("ord") >= cut).withColumn("ord", F.col("ord") - cut)]  # each numbered from 0
        states = [site_state(p, KEYS, LISTS, "ord", COUNTS, delivery=i) for i, p in enumerate(parts)]
        merged = merge_states(states, KEYS, COUNTS)
        assert merged.schema == states[0].schema or merged.columns == states[0].columns
        for state in (merged, merge_states([merged, states[0].limit(0)], KEYS, COUNTS)):  # a merged state merges on
            assert key(site_table(state, KEYS, "id", LISTS, COUNTS)) == key(whole)
    assert ("s1", "A", "x, y, z, w", 4, None, 2, 1) in key(whole)


def test_a_merge_does_not_read_the_first_delivery_again(spark, tmp_dir):
    df = spark.createDataFrame([(*e, i) for i, e in enumerate(EVENTS)], "id string, name string, toks string, v int, kind string, ord long")
    site_state(df, KEYS, LISTS, "ord", COUNTS).write.parquet(f"{tmp_dir}/state")
    old = spark.read.parquet(f"{tmp_dir}/state")
    new = site_state(df, KEYS, LISTS, "ord", COUNTS, delivery=1)
    twice = site_table(merge_states([old, new], KEYS, COUNTS), KEYS, "id", LISTS, COUNTS).filter("id = 's2'").collect()
    assert [(r["tokens"], r["n"], r["o"]) for r in twice] == [("z, x, w", 4, None)]


def test_site_table_shuffles_few_times(spark):
    df = spark.createDataFrame([(*e, i) for i, e in enumerate(EVENTS)], "id string, name string, toks string, v int, kind string, ord long")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    sites = plan(site_lists_with_counts(df, KEYS, "id", LISTS, "ord", "n", {"total": "v"}, "kind", {"f": "F"}))
    assert sites.count("Exchange hashpartitioning") == 4 and "Join" not in sites


# --- frequencies

def test_frequencies_from_one_scan(spark, tmp_dir):
    rows = [("a, b", "x", None), ("b", "x,y,y", "q"), (None, "", "q,q"), ("a,", "x", " q")]
    spark.createDataFrame(rows, "l string, m string, o string").write.parquet(f"{tmp_dir}/t")
    df = spark.read.parquet(f"{tmp_dir}/t")
    upper = {"m": F.upper}
    got = token_frequencies(df, ["l", "m", "o"], normalize=upper)
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    for c in ("l", "m", "o"):
        each = token_frequency(df, c, [x for x in ("l", "m", "o") if x != c], normalize=upper.get(c))
        assert ({(r["value"], r["n"]) for r in got.filter(F.col("list") == c).collect()} == {tuple(r) for r in each.collect()})


@pytest.mark.parametrize("name, snake", [("Straße", "strasse"), ("Øre Æble", "ore_aeble"), ("Łódź", "lodz"), ("Þing ð", "thing_d"), ("Œuvre", "oeuvre")])
def test_letters_that_do_not_decompose_are_written_out(name, snake):
    assert snake_name(name) == snake
