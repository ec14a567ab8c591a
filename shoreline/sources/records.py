"""Report records whose quoted fields hold line breaks, read in many tasks a file.

Whether a line break ends a record depends on the number of quotes before it in the file.  A
first pass counts the quotes of every input split; their running parity tells each split whether
it begins inside a quoted field.  In a second pass every split puts its lines together to
records by itself: all but the record that goes on in the next split, whose parts (at most two a
split) are joined by file and split.  The parts come from a scan that only keeps the splits on whose
borders a record is open, and there is none if there are no such splits.

Quotes are those of RFC 4180: a field that holds quotes is quoted, its quotes doubled.  A record of
several lines that does not read so fails with a message, instead of being cut otherwise than
a single reader would.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoreline.operators._util import fresh_name
from shoreline.operators.joins import MAX_BROADCAST_BYTES
from shoreline.session import materialize, scratch_folder
from shoreline.sources.headers import plain_path

#: what a row of the splits table takes in memory, generously
_SPLIT_BYTES = 400
_WHOLE, _TAIL, _HEAD = 0, 1, 2
_FIELD = r'(?:\s*+"(?:[^"]++|"")*+"\s*+|[^",\r\n]*+)'
_RECORD = rf"(?s)\A{_FIELD}(?:,{_FIELD})*+\z"


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(value, path, start, length)``: every line with the split that it is in, in order within a task."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"))


def _odd() -> Column:
    return ((F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2).cast("byte")


def quote_splits(spark: SparkSession, path: str | Sequence[str], files: Sequence[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(path, start, length, rank, header, before, after)`` of every split, stored: the file's place among the
    sorted files, the number of its header, and whether a quote is open at its begin and end."""
    counted = _lines(spark, path).groupBy("path", "start", "length").agg((F.sum(_odd()) % 2).alias("odd"))
    upto = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("odd").over(upto) % 2, F.lit(0))
    place = {plain_path(f): i for i, f in enumerate(sorted(files))}
    known = [(plain_path(f), place[plain_path(f)], h) for h, group in enumerate(groups.values()) for f in group]
    names = spark.createDataFrame(known, "__file string, rank long, header int")
    splits = (counted.withColumn("before", before).join(names, plain_path(F.col("path")) == F.col("__file"))
              .select("path", "start", "length", "rank", "header", F.col("before").cast("int"),
                      ((F.col("before") + F.col("odd")) % 2).cast("int").alias("after")))
    return materialize(splits, scratch_folder(spark, "reports/splits"))


def _assemble(fragments: bool):
    """Lines ``(rank, header, start, before, odd, value)`` to records ``(rank, header, start, line, kind, record)``:
    whole ones, or only the parts of those that are open at a border of their split."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None  # (rank, header, start)
        line = first = 0  # of the next line, and of the open record
        parts: list[str] | None = None  # of the open record
        head = False  # it was open when the split began

        def row(kind: int) -> list:
            return [*split, first, kind, "\n".join(parts)]

        for b in batches:
            out: list[list] = []  # rows
            singles: list[tuple[int, int, int]] = []  # (from, to, line of the first) of this batch
            rank, start = b.column(0).to_numpy(), b.column(2).to_numpy()
            value = b.column(5)
            cuts = np.flatnonzero((rank[1:] != rank[:-1]) | (start[1:] != start[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]) if b.num_rows else ():
                here = (int(rank[lo]), b.column(1)[lo].as_py(), int(start[lo]))
                if here != split:
                    if parts is not None and fragments:
                        out.append(row(_HEAD if head else _TAIL))
                    split, line, first = here, 0, 0
                    head = bool(b.column(3)[lo].as_py())
                    parts = [] if head else None
                at = lo
                for o in (np.flatnonzero(b.column(4).slice(lo, hi - lo).to_numpy()) + lo).tolist():
                    if parts is None:  # a record opens
                        singles.append((at, o, line + at - lo))
                        parts, first = [value[o].as_py()], line + o - lo
                    else:  # and closes
                        parts += value.slice(at, o + 1 - at).to_pylist()
                        if head == fragments:
                            out.append(row(_HEAD if head else _WHOLE))
                        parts, head = None, False
                    at = o + 1
                if parts is None:
                    singles.append((at, hi, line + at - lo))
                else:
                    parts += value.slice(at, hi - at).to_pylist()
                line += hi - lo
            yield _batch(out)
            if not fragments:
                for lo, hi, n in singles:
                    if hi > lo:
                        many = hi - lo
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).slice(lo, many), b.column(1).slice(lo, many), b.column(2).slice(lo, many),
                             pa.array(np.arange(n, n + many)), pa.array(np.zeros(many, np.int32)), value.slice(lo, many)], _NAMES)
        if parts is not None and fragments:
            yield _batch([row(_HEAD if head else _TAIL)])

    return each


_NAMES = ["rank", "header", "start", "line", "kind", "record"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def _placed(lines: DataFrame, splits: DataFrame, bounded: bool) -> DataFrame:
    """The lines with their split's columns, in order within a split."""
    keys = ["path", "start", "length"]
    columns = ["rank", "header", "start", "before", _odd().alias("odd"), "value"]
    if bounded:
        return lines.join(F.broadcast(splits), keys, "left").select(*columns, "length")
    # more splits than may be broadcast: the lines of each are gathered and sorted
    n = fresh_name(lines, "__n")
    numbered = lines.withColumn(n, F.monotonically_increasing_id()).join(splits, keys, "left")
    return numbered.repartition("rank", "start").sortWithinPartitions("rank", "start", n).select(*columns, "length")


def report_records(spark: SparkSession, path: str | Sequence[str], files: Sequence[str], groups: Mapping[str, Sequence[str]],
                   max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``(rank, header, start, line, record)``: every record of the ``files`` in ``path`` but their headers and blank lines.
    ``start`` and ``line`` are the split and the number of the line in it with which the record begins."""
    splits = quote_splits(spark, path, files, groups)
    bounded = splits.count() * _SPLIT_BYTES <= max_broadcast
    schema = "rank long, header int, start long, line long, kind int, record string"
    lines = _placed(_lines(spark, path), splits.drop("after"), bounded)
    # the same files must be split alike in both passes
    known = F.when(F.col("before").isNull(), F.raise_error(F.lit("the input splits of the report changed: read it again")).cast("int"))
    lines = lines.withColumn("before", F.coalesce("before", known)).drop("length")
    records = lines.mapInArrow(_assemble(False), schema).drop("kind")
    torn = splits.filter("before = 1 OR after = 1").drop("after")
    if not torn.isEmpty():
        keys = ["path", "start", "length"]
        some = _lines(spark, path).join(F.broadcast(torn.select(*keys)) if bounded else torn.select(*keys), keys, "left_semi")
        parts = _placed(some, torn, bounded).drop("length").mapInArrow(_assemble(True), schema)
        of = F.sum((F.col("kind") == _TAIL).cast("int")).over(Window.partitionBy("rank").orderBy("start", "line"))
        inner = F.array_sort(F.collect_list(F.struct("start", "line", "record")))
        joined = (parts.withColumn("of", of).groupBy("rank", "header", "of").agg(inner.alias("p"))  # the parts of one record
                  .select("rank", "header", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["line"].alias("line"),
                          F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))
        records = records.unionByName(joined)
    text = F.regexp_replace("record", "\\r\\z", "")
    return (records.withColumn("record", text).filter((F.trim("record") != "") & ~((F.col("start") == 0) & (F.col("line") == 0))))


def record_fields(records: DataFrame, names: Sequence[Sequence[str]], options: Mapping[str, str]) -> DataFrame:
    """``records`` with one text column for each name of the headers (``names`` by header number): the
    record's field of that name, NULL where its file has none."""
    most = max(1, *map(len, names))
    schema = ", ".join(f"_c{i} string" for i in range(most))
    message = F.concat(F.lit("a quote stands in a field that is not quoted: "), F.left("record", F.lit(200)))
    broken = F.col("record").contains("\n") & ~F.col("record").rlike(_RECORD)
    checked = F.when(broken, F.raise_error(message)).otherwise(F.col("record"))
    read = records.select("rank", "header", "start", "line", F.from_csv(checked, schema, dict(options)).alias("fields"))

    def field(name: str) -> Column:
        at = [(h, F.col("fields")[f"_c{list(header).index(name)}"]) for h, header in enumerate(names) if name in header]
        if len(at) == len(names) and len({str(c) for _, c in at}) == 1:
            return at[0][1].alias(name)
        return reduce(lambda acc, x: acc.when(F.col("header") == x[0], x[1]), at, F).alias(name)

    return read.select("rank", "start", "line", *[field(n) for n in dict.fromkeys(n for header in names for n in header)])
