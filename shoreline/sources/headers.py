"""Headers of many report files, found by the executors.

The first record of every file is read in tasks, never file by file on the driver; files
are grouped by it there, and the driver gets one row a distinct header with its files (whose
names it listed before).  Small files are packed into few tasks; a large one has a task of its
own, which stops after the first record.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: files up to this size are read in packs, whole
SMALL_FILE_BYTES = 1 << 20


def plain_path(c):
    """``file:///x`` and ``file:/x`` are one file: a Column or a text."""
    if isinstance(c, str):
        return re.sub("^([^:/]+):/+", r"\1:/", c)
    return F.regexp_replace(c, "^([^:/]+):/+", "$1:/")


def _first_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(path, header)`` from ``(path, value, alone)``: a file's first lines up to the one that closes its
    quotes.  Where a task holds a single file (``alone``) the rest of it is not read."""
    path, lines, done, alone = None, [], True, False

    def found() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array(["\n".join(lines)])], ["path", "header"])

    for b in batches:
        at = 0
        while at < b.num_rows:
            here = b.column(0)[at].as_py()
            if here != path:
                if not done:
                    yield found()
                path, lines, done, alone = here, [], False, b.column(2)[at].as_py()
            if done:  # on to the next file
                other = pc.not_equal(b.column(0).slice(at), path).to_numpy(zero_copy_only=False)
                at = at + int(np.argmax(other)) if other.any() else b.num_rows
                continue
            lines.append(b.column(1)[at].as_py())
            at += 1
            if sum(line.count('"') for line in lines) % 2 == 0:
                yield found()
                done = True
                if alone:
                    return
    if not done:
        yield found()


def _headers(spark: SparkSession, path: str | Sequence[str], sizes: Column, alone: bool) -> DataFrame:
    """``(header, files)`` of the files whose size meets the condition: others are not even opened."""
    rows = spark.read.option("lineSep", "\n").text(path).filter(sizes).filter("_metadata.file_block_start = 0")
    rows = rows.select(F.col("_metadata.file_path").alias("path"), "value", F.lit(alone).alias("alone"))
    firsts = rows.mapInArrow(_first_records, "path string, header string")
    text = F.regexp_replace("header", "^\\ufeff|\\r$", "")
    return firsts.groupBy(text.alias("header")).agg(F.collect_list("path").alias("files"))


def header_groups(spark: SparkSession, path: str | Sequence[str], small: int = SMALL_FILE_BYTES) -> dict[str, list[str]]:
    """The first record of each file in ``path``, with the files that begin with it (as ``_metadata.file_path``
    spells them).  Empty files have none."""
    own = spark.newSession()  # settings of its own: files are not split, one to a task, in batches of few lines
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(name, str(1 << 50))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    size = F.col("_metadata.file_size")
    groups: dict[str, list[str]] = {}
    for df in (_headers(spark, path, size <= small, False), _headers(own, path, size > small, True)):
        for r in df.collect():
            groups.setdefault(r["header"], []).extend(r["files"])
    return {h: sorted(groups[h]) for h in sorted(groups, key=lambda h: min(groups[h]))}


def header_names(header: str) -> list[str]:
    """The column names of a header record, as Spark's reader gives them: trimmed, ``_c0`` for an empty one,
    repeated names with their place."""
    fields = [f.strip() for f in next(csv.reader(io.StringIO(header, newline=""), skipinitialspace=True), [])] if header else []
    lower = [f.lower() for f in fields]
    return [f"_c{i}" if f in ("", "NA") else f"{f}{i}" if lower.count(f.lower()) > 1 else f for i, f in enumerate(fields)]
