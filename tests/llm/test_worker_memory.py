"""Python workers get few whole texts at once and give back what they have freed."""

import re
import subprocess
import sys
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

from shoreline.llm import common, langid, packing, queries, simhash

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def counted(docs):
    """A row for each batch that a worker gets: its number of rows."""
    def each(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    return docs.mapInArrow(each, "n long")


def test_texts_to_pack_arrive_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "pieces", lambda docs, *a, **k: counted(docs))
    monkeypatch.setattr(packing, "pack", lambda cut, capacity: cut)
    was = spark.conf.get(BATCH)
    got = [r["n"] for r in packing.pack_documents(spark.range(0, 4500, 1, 1), "").collect()]
    assert sum(got) == 4500 and max(got) <= common.TEXT_ROWS == 1000
    assert spark.conf.get(BATCH) == was


@pytest.mark.parametrize("was, most", [("10000", 1000), ("300", 300), ("0", 1000), ("-1", 1000)])
def test_a_lower_number_of_the_session_holds_and_is_restored(spark, was, most):
    own = spark.conf.get(BATCH)
    spark.conf.set(BATCH, was)
    try:
        got = [r["n"] for r in common.stored(counted(spark.range(0, 2500, 1, 1)), "counts", 1000).collect()]
        assert sum(got) == 2500 and max(got) == most and spark.conf.get(BATCH) == was
        with pytest.raises(ZeroDivisionError), common.batches_of(spark, 7):
            assert spark.conf.get(BATCH) == "7" if most != 300 else "7"
            1 / 0
        assert spark.conf.get(BATCH) == was
    finally:
        spark.conf.set(BATCH, own)


def test_other_stages_get_small_batches_too(spark, monkeypatch):
    class Asked(Exception):
        pass

    def spy(df, name, batch_rows=None):
        raise Asked(name, batch_rows)

    docs = spark.createDataFrame([("a", "one text", "en")], "doc_id string, text string, lang string")
    monkeypatch.setattr(simhash, "stored", spy)
    monkeypatch.setattr(langid, "stored", spy)
    monkeypatch.setattr(langid, "identify", lambda docs, *a, **k: docs)
    for stage, name in ((simhash.keep_one, "nodes"), (simhash.near_duplicates, "fingerprints"), (langid.keep_identified, "identified")):
        with pytest.raises(Asked) as asked:
            stage(docs)
        assert asked.value.args == (name, common.TEXT_ROWS)


def test_a_worker_gives_memory_back_after_its_last_batch(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "one text", "en")], "doc_id string, text string, lang string")
    made, released = [], []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, each, schema, *a: made.append((self, each)) or DataFrame.limit(self, 0))
    monkeypatch.setattr(langid, "sample", lambda *a: {"en": [b"one text of some words"]})
    packing.pieces(docs, queries.tokenizer_path())
    simhash.fingerprints(docs)
    with pytest.raises(Exception):  # the stand-in lacks the columns that follow
        langid.identify(docs)
    for module, (rows, each) in zip((packing, simhash, langid), made, strict=True):
        monkeypatch.setattr(module, "release_memory", lambda: released.append(len(out)))
        batch = pa.RecordBatch.from_pylist([r.asDict() for r in rows.collect()])
        out, before = [], len(released)
        for b in each(iter([batch, batch])):
            assert len(released) == before
            out.append(b)
        assert released[before:] == [2] and sum(b.num_rows for b in out) == 2


def test_freed_memory_goes_back_to_the_system():
    """In a process of its own: many small and some Arrow blocks, freed but for a few, hardly weigh after the release."""
    code = """
import re, pyarrow as pa, numpy as np
from shoreline.llm.common import release_memory
def mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
start = mb()
kept = [np.ones(10_000) for _ in range(2000)]
arrow = [pa.array(np.arange(100_000) + i).cast(pa.float64()) for i in range(100)]
last = kept[-1]
del kept, arrow
freed = mb()
release_memory()
print(freed - start, mb() - start)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=common.Path(__file__).parents[2]).stdout
    freed, released = map(float, re.findall(r"[-\d.]+", out))
    assert freed > 100 and released < freed / 4


def test_cutting_takes_little_memory_at_once():
    text = " ".join(f"beach{i % 97}, the water" for i in range(200))
    texts = pa.array([text] * 2000, pa.large_string())  # some 8 MB
    own = packing.WordTokenizer(queries.tokenizer_path())
    pool, was = pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        n = sum(1 for _ in own.all_ids(texts))
        peak = pool.max_memory() + tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(was)
    assert n == 2000 and peak < 60e6, peak
