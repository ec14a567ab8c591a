"""Large JSON array documents, read in many tasks a file.

A document is scanned in segments, each up to the next closing brace.  Whether a brace is part of a text and how
deep it is nested depends on what comes before it in the file: a first pass finds, for every input split, the
quotes and the change of depth in it for both ways to begin (outside or inside of a text); their running sums tell each
split how it begins.  In a second pass every split puts its segments together to the objects of the array, and writes
each as a record of its own; the parts of an object that crosses a border of splits are joined by file and split.

Only what is certain is read so: one array of objects a file.  For any other document, and for one whose braces
and quotes do not balance, ``array_lines`` gives nothing and the caller reads it as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from shoreline.session import materialize, scratch_folder

#: files up to this size are read by one task each
LARGE_FILE_BYTES = 1 << 20
#: ends a record; no JSON text holds this character itself
RECORD_END = "\x1e"
_KEYS = ["path", "start", "length"]
_WHOLE, _HEAD, _TAIL, _STRANGE = 0, 1, 2, 3
_OPENS = r"\A\x{FEFF}?\s*[\[,]\s*\{"


def _depth(text: Column) -> Column:
    """Opening less closing brackets outside of quotes."""
    bare = F.regexp_replace(text, r'"[^"]*+(?:"|\z)', "")
    return F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]"))


def segments(spark: SparkSession, path: str | Sequence[str], large: int) -> DataFrame:
    """``(path, start, length, odd, outer, inner, value)``: the text up to each closing brace with its split, in order within
    a task; whether its quotes are odd in number, and its change of depth, brace included, if it begins outside or inside of quotes."""
    lines = spark.read.option("lineSep", "}").text(path).filter(F.col("_metadata.file_size") > large)
    text = F.regexp_replace("value", r"(?s)\\.", "")  # escaped characters
    odd = ((F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2).cast("long")
    rest = F.regexp_replace(text, r'\A[^"]*+(?:"|\z)', "")
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"), odd.alias("odd"),
        (_depth(text) - 1 + odd).cast("long").alias("outer"), (_depth(rest) - odd).cast("long").alias("inner"), "value")


def _sums():
    """Segments to ``(path, start, length, odd, outer, inner)`` of every split in a task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "start", "length", "odd", "outer", "inner"]
        found: dict[tuple, list[int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            path, start, length, odd, outer, inner = (b.column(i) for i in range(6))
            ids = path.dictionary_encode().indices.to_numpy(), start.to_numpy()
            cuts = (np.flatnonzero((np.diff(ids[0]) != 0) | (np.diff(ids[1]) != 0)) + 1).tolist()
            o, x, y = odd.to_numpy(), outer.to_numpy(), inner.to_numpy()
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                now = found.setdefault((path[lo].as_py(), start[lo].as_py(), length[lo].as_py()), [0, 0, 0])
                inside = ((now[0] + np.cumsum(o[lo:hi]) - o[lo:hi]) % 2).astype(bool)
                now[0] = (now[0] + int(o[lo:hi].sum())) % 2
                now[1] += int(np.where(inside, y[lo:hi], x[lo:hi]).sum())
                now[2] += int(np.where(inside, x[lo:hi], y[lo:hi]).sum())
        rows = [(*k, *v) for k, v in found.items()]
        types = [pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return each


def array_splits(parts: DataFrame) -> DataFrame:
    """``(path, start, length, quoted, depth, last_quoted, last_depth)`` of every split, stored: how it begins and ends."""
    sums = parts.drop("value").mapInArrow(_sums(), "path string, start long, length long, odd long, outer long, inner long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.withColumn("quoted", F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)))
    begun = begun.withColumn("change", F.when(F.col("quoted") == 1, F.col("inner")).otherwise(F.col("outer")))
    begun = begun.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    splits = begun.select(*_KEYS, "quoted", "depth", ((F.col("quoted") + F.col("odd")) % 2).alias("last_quoted"),
                          (F.col("depth") + F.col("change")).alias("last_depth"))
    return materialize(splits, scratch_folder(parts.sparkSession, "reports/splits"))


def _objects():
    """Segments with how their split begins to ``(path, start, n, kind, record)``: whole objects, and the parts (``_HEAD``: up to
    the end of an object that began before, or all of a split inside of one; ``_TAIL``: from its begin on) of others."""
    whole, head, tail, strange = _WHOLE, _HEAD, _TAIL, _STRANGE

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None  # (path, start)
        quoted = depth = n = 0
        parts: list[str] = []  # of the open object
        torn = False  # it was open when the split began
        names, types = ["path", "start", "n", "kind", "record"], [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

        def left() -> list[tuple]:
            """What stands behind the last object of a split."""
            if not parts:
                return []
            text = "}".join(parts)
            if quoted == 0 and depth == -1:  # the end of the document
                if torn:
                    return [(*split, n, strange, None)]
                return [] if text.strip(" \t\r\n﻿[") == "]" else [(*split, n, strange, None)]
            return [(*split, n, head if torn else tail, text + "}")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for b in batches:
            if not b.num_rows:
                continue
            out: list[tuple] = []
            path, start = b.column(0), b.column(1).to_numpy()
            place = path.dictionary_encode().indices.to_numpy()
            cuts = (np.flatnonzero((np.diff(place) != 0) | (np.diff(start) != 0)) + 1).tolist()
            odd, outer, inner = (b.column(i).to_numpy() for i in (3, 4, 5))
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                here = (path[lo].as_py(), int(start[lo]))
                if here != split:
                    if split:
                        out += left()
                    split, n, parts = here, 0, []
                    quoted, depth = b.column(7)[lo].as_py(), b.column(8)[lo].as_py()
                    torn = here[1] > 0 and (quoted == 1 or depth > 1)
                o = odd[lo:hi]
                after = (quoted + np.cumsum(o)) % 2
                depths = depth + np.cumsum(np.where((after + o) % 2 == 1, inner[lo:hi], outer[lo:hi]))
                texts = b.column(6).slice(lo, hi - lo).to_pylist()
                at = 0
                for end in np.flatnonzero((after == 0) & (depths == 1)).tolist():
                    parts += texts[at:end + 1]
                    out.append((*split, n, head if torn else whole, "}".join(parts) + "}"))
                    parts, torn, n, at = [], False, n + 1, end + 1
                parts += texts[at:]
                quoted, depth = int(after[-1]), int(depths[-1])
            yield batch(out)
        if split:
            yield batch(left())

    return each


def array_lines(spark: SparkSession, path: str | Sequence[str], large: int = LARGE_FILE_BYTES) -> str | None:
    """The folder, of text files, to which the objects of the arrays in files of over ``large`` bytes are written, each ended by
    ``RECORD_END``; None if there are no such files or one holds anything else than an array of objects."""
    parts = segments(spark, path, large)
    splits = array_splits(parts)
    # a file ends outside of quotes, one deeper than the last segment's brace that is not there
    ends = splits.groupBy("path").agg(F.max_by(F.struct("last_quoted", "last_depth"), "start").alias("e"))
    found = ends.agg(F.count(F.lit(1)).alias("files"), F.count_if((F.col("e.last_quoted") != 0) | (F.col("e.last_depth") != -1)).alias("odd")).first()
    if not found["files"] or found["odd"]:
        return None
    placed = parts.join(F.broadcast(splits.drop("last_quoted", "last_depth")), _KEYS, "left")  # a row a split
    changed = F.raise_error(F.lit("the input splits of the document changed: read it again")).cast("long")
    placed = placed.select(*_KEYS, "odd", "outer", "inner", "value", F.coalesce("quoted", changed).alias("quoted"), "depth")
    schema = "path string, start long, n long, kind int, record string"
    rows = placed.mapInArrow(_objects(), schema)
    border = splits.filter("start > 0 AND (quoted = 1 OR depth > 1)")
    if not border.isEmpty():
        # the object that is open at a border: its tail in the last split before, and heads
        ends_open = splits.filter("last_quoted = 1 OR last_depth > 1")
        some = border.select(*_KEYS).union(ends_open.select(*_KEYS)).distinct()
        pieces = placed.join(F.broadcast(some), _KEYS, "left_semi").mapInArrow(_objects(), schema).filter(F.col("kind").isin(_HEAD, _TAIL))
        of = F.sum((F.col("kind") == _TAIL).cast("int")).over(Window.partitionBy("path").orderBy("start", "n"))
        pieces = pieces.withColumn("of", of).groupBy("path", "of").agg(
            F.array_sort(F.collect_list(F.struct("start", "n", "kind", "record"))).alias("p"))
        # a piece that ends with its split ends with the brace that the next begins behind
        joined = pieces.select("path", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["n"].alias("n"), F.lit(_WHOLE).alias("kind"),
                               F.array_join(F.transform("p", lambda x: x["record"]), "").alias("record"))
        rows = rows.filter(~F.col("kind").isin(_HEAD, _TAIL)).unionByName(joined)
    strange = (F.col("kind") != _WHOLE) | F.col("record").isNull() | ~F.col("record").rlike(_OPENS)
    seen = Observation()
    folder = scratch_folder(spark, "reports/objects")
    texts = rows.withColumn("strange", strange).observe(seen, F.count_if("strange").alias("n")).filter(~F.col("strange"))
    texts = texts.select(F.regexp_replace("record", r"\A\x{FEFF}?\s*[\[,]\s*", "").alias("value"))
    texts.write.option("lineSep", RECORD_END).option("compression", "none").text(folder)
    return None if seen.get["n"] else folder
