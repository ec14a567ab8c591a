"""Streaming intake of report files (available-now trigger)."""

import os

from pyspark.sql import types as T

from shoreline.streaming import clean_actions_stream
from test_io import ACTIONS_CSV

HEADER = T.StructType([T.StructField(n, T.StringType()) for n in [
    "Beach ID", "Beach Name", "State", "County", "Action Type", "Action Reasons",
    "Action Indicator", "Action Possible Source", "Action Duration Days", "Year"]])


def test_stream_cleans_new_files(spark, tmp_dir):
    inbox = os.path.join(tmp_dir, "inbox")
    os.makedirs(inbox)
    # one file without quoted newlines (a stream reads line by line)
    lines = ACTIONS_CSV.splitlines()[:9]
    with open(os.path.join(inbox, "a.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    out = os.path.join(tmp_dir, "clean")
    q = clean_actions_stream(spark, inbox, out, HEADER, os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert sorted(r["beach_id"] for r in got.collect()) == ["B1", "B1", "B2", "B3", "B3", "B4", "B4"]
    assert dict(got.dtypes)["year"] == "int"
    assert {r["state"] for r in got.collect()} == {"WI", "WA", "CA"}


def test_stream_restart_appends_only_new_files(spark, tmp_dir):
    inbox = os.path.join(tmp_dir, "inbox2")
    os.makedirs(inbox)
    header = ACTIONS_CSV.splitlines()[0]
    with open(os.path.join(inbox, "a.csv"), "w") as f:
        f.write(header + "\nB1,Alpha,WI,Door,Closure,ELEV_BACT,ENTERO,CSO,2,2017\n")
    out = os.path.join(tmp_dir, "clean2")  # default checkpoint: out/_checkpoint
    clean_actions_stream(spark, inbox, out, HEADER).awaitTermination(120)
    assert spark.read.parquet(out).count() == 1
    with open(os.path.join(inbox, "b.csv"), "w") as f:
        f.write(header + "\nB2,Bravo,BR,Iron,Rain Advisory,RAINFALL,PREEMPT,STORM,1,2018\n"
                "B5,Echo,GU,Guam,Closure,ELEV_BACT,ENTERO,CSO,9,2018\n")
    clean_actions_stream(spark, inbox, out, HEADER).awaitTermination(120)
    got = spark.read.parquet(out)
    assert sorted((r["beach_id"], r["state"]) for r in got.collect()) == [("B1", "WI"), ("B2", "WI")]
