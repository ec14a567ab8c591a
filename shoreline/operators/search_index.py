"""Stored records that are looked up many times: partitioned by state, with an index of text pieces.

``build`` writes the records, sorted into small blocks within a folder for each state, and postings: for each
three-character piece of the records' searched fields and each group of 64 records one after the other, the
records that hold it, a bit each.  Texts that records of a group share are cut into pieces once.  A lookup then

* runs the state pattern over the few distinct states (it is a filter on the folder column, which Spark's file
  index evaluates), so only the folders of matching states are read;
* turns the term into pieces that every match must hold (``functions.pattern.needed_grams``), reads the postings of
  those pieces only, and keeps the blocks and records that hold them all; a pattern without such pieces
  reads all records of the states;
* applies the pattern itself to the records that are left, so the result equals that of the plain search.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoreline.functions.pattern import END, START, needed_grams
from shoreline.operators._util import qcol
from shoreline.operators.search import state_condition, state_filter, term_search

_ID, _BLOCK, _STATE = "__id", "__block", "__state"
_MASK = (1 << 33) - 1


@dataclass
class SearchIndex:
    """The folder of a stored index and what it was built with."""

    spark: SparkSession
    folder: str
    state_col: str
    columns: list[str]
    fields: list[str]
    raw_term_fields: list[str]
    buckets: int
    schema: T.StructType

    def records(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/records")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/postings")


def text_pieces(text: Column) -> Column:
    """The three-character pieces of a text between ``START`` and ``END``."""
    text = F.concat(F.lit(START), text, F.lit(END))
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1)))
    return F.transform(places, lambda i: F.substring(text, i, 3))


def posting_rows(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(gram, __block, word, bits)``: bit ``i`` of a word tells whether the record ``64 * word + i`` holds the piece."""
    keys = [_BLOCK, "word"]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(_ID).bitwiseAND(F.lit(63)).cast("int"))
    found = F.explode(F.array(*[F.lower(qcol(f).cast("string")) for f in fields])).alias("text")
    texts = records.select(_BLOCK, F.shiftright(_ID, 6).alias("word"), bit.alias("bits"), found).filter(F.col("text").isNotNull())
    texts = texts.groupBy(*keys, "text").agg(F.bit_or("bits").alias("bits"))
    grams = texts.select(*keys, "bits", F.explode(text_pieces(F.col("text"))).alias("gram"))
    return grams.groupBy("gram", *keys).agg(F.bit_or("bits").alias("bits"))


def build(records: DataFrame, folder: str, state_col: str, fields: Sequence[str], raw_term_fields: Iterable[str] = (),
          block_rows: int = 100_000, buckets: int = 64) -> SearchIndex:
    """Store ``records`` and the postings of ``fields`` in ``folder``, which all executors share."""
    # rows of a state stay together but a large state fills many tasks
    ordered = records.repartitionByRange(qcol(state_col), *[qcol(c) for c in fields]).sortWithinPartitions(qcol(state_col))
    row = F.monotonically_increasing_id()
    block = F.concat_ws("-", F.shiftright(row, 33), F.floor(row.bitwiseAND(F.lit(_MASK)) / block_rows).cast("long"))
    placed = ordered.withColumns({_ID: row, _BLOCK: block, _STATE: qcol(state_col)})
    index = SearchIndex(records.sparkSession, folder, state_col, list(records.columns), list(fields), list(raw_term_fields),
                        buckets, placed.schema)
    (placed.write.mode("overwrite").partitionBy(_STATE, _BLOCK).parquet(f"{folder}/records"))
    stored = posting_rows(index.records(), fields)
    bucket = (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int")
    (stored.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("gram"), F.lit(16)))
     .sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings"))
    return index


def candidates(index: SearchIndex, term: str) -> DataFrame | None:
    """``(__id, __block)`` of the records that hold the pieces of some way to match; None if any record may match."""
    ways: set[frozenset[str]] = set()
    raw = set(index.raw_term_fields)
    for pattern in {term if f in raw else term.lower() for f in index.fields}:
        found = needed_grams(pattern)
        if found is None:
            return None
        ways |= set(found)
    named = [(n, len(way), gram) for n, way in enumerate(sorted(ways, key=sorted)) for gram in sorted(way)]
    grams = sorted({g for _, _, g in named})
    buckets = sorted({zlib.crc32(g.encode()) % index.buckets for g in grams})
    hits = index.postings().filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)).select("gram", _BLOCK, "word", "bits")
    wanted = index.spark.createDataFrame(named, "way int, size int, gram string")
    held = hits.join(F.broadcast(wanted), "gram").groupBy("way", _BLOCK, "word").agg(
        F.max("size").alias("size"), F.count(F.lit(1)).alias("n"), F.bit_and("bits").alias("bits"))  # a word has a piece once
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    rows = held.filter("n = size").select(_BLOCK, "word", F.explode(places).alias("place"))
    return rows.select((F.shiftleft("word", 6) + F.col("place")).alias(_ID), _BLOCK).distinct()


def find(index: SearchIndex, selected: str, term: str) -> DataFrame:
    """The records of matching states with a field that matches ``term``.  One small job reads the postings, whose
    blocks (at most one a ``block_rows`` records) prune the records' folders."""
    # folders can't tell an empty name from a missing one
    folder = F.col(_STATE)
    rows = index.records().filter(folder.isNull() | state_condition(folder, selected))
    rows = state_filter(rows, index.state_col, selected)
    if term:
        some = candidates(index, term)
        if some is not None:
            blocks = [r[_BLOCK] for r in some.select(_BLOCK).distinct().collect()]
            rows = rows.filter(F.col(_BLOCK).isin(blocks)).join(some.select(_ID), _ID, "left_semi")
        rows = term_search(rows, term, index.fields, index.raw_term_fields)
    return rows.select(*[qcol(c) for c in index.columns])
