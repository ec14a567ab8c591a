"""JSON array documents in many splits: the same rows as a reader of the whole file gives."""

import json

import pytest

from shoreline.sources import read_records
from shoreline.sources.arrays import array_lines

SCHEMA = "a string, n string, d double, o string"


@pytest.fixture()
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for n in names:
        spark.conf.set(n, "700")
    yield
    for n in names:
        spark.conf.unset(n)


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def document(n: int, sep: str) -> str:
    texts = ['plain', 'a "quote" \\ back', '}, {"a": "x"', '[{', 'two\nlines', '\\"}', 'é\U0001f600}', '']
    rows = []
    for i in range(n):
        o = {"x": [{"y": texts[i % 8]}] * (i % 4 * 20)} if i % 3 == 0 else None
        rows.append('{"a": %s, "n": %s, "d": %d.50%s}' % (json.dumps(texts[i % 8] * (1 + i % 5), ensure_ascii=i % 2 == 0), ["1.50", "1e3", "7", '"NA"'][i % 4], i,
                                                         f', "o": {json.dumps(o)}' if o else ""))
    return "[" + sep.join(rows) + "]"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sep", [",", ",\n", "\n ,"])
def test_arrays_in_many_splits_equal_the_whole(spark, tmp_dir, small_splits, sep):
    path = f"{tmp_dir}/a.json"
    with open(path, "w") as f:
        f.write(document(200, sep) + ("\n" if sep != "," else ""))
    found = read_records(spark, path, schema(spark), large=0)
    assert "reports/objects" in found.inputFiles()[0]  # by its splits
    whole = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    assert rows(found) == rows(whole) and found.count() == 200
    assert spark.read.text(path).rdd.getNumPartitions() > 3


@pytest.mark.parametrize("text", ['{"a": "x", "d": 1}', '{"o": {"y": 1}}', "[]", " [ ]\n", '[{"a": "x"}, null, {"a": "y"}]', '[{"a": "x"}, 1]', '[{"a": "x"',
                                  '[{"a": "x}]', '[[{"a": "x"}], [{"a": "y"}]]', '[{"a": "x"}][{"a": "y"}]', '["x", {"a": "x"}]', "", "﻿[{\"a\": \"x\"}]"])
def test_other_documents_read_as_before(spark, tmp_dir, text):
    path = f"{tmp_dir}/a.json"
    with open(path, "w") as f:
        f.write(text)
    assert rows(read_records(spark, path, schema(spark), large=0)) == rows(spark.read.schema(SCHEMA).option("multiLine", True).json(path))


def test_files_of_a_folder(spark, tmp_dir, small_splits):
    for i in range(3):
        with open(f"{tmp_dir}/{i}.json", "w") as f:
            f.write(document(i * 40 + 1, ",\n"))
    found = read_records(spark, tmp_dir, schema(spark), large=2000)
    assert rows(found) == rows(spark.read.schema(SCHEMA).option("multiLine", True).json(tmp_dir))
    assert array_lines(spark, tmp_dir, 1 << 30) is None
