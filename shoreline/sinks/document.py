"""One ordered file out of many tasks: a CSV with its header once, or a JSON array.

Rows are range-partitioned and sorted, and every task writes its range as a part; a row but
the first of its part begins with the separator, so a part is a piece of the document.  The parts are then
joined in order, prefix, separators and suffix between them, each at its byte offset: a file has one writer,
so this is a copy by the driver's JVM, through a buffer of 64 kB.  The document
is written under another name and renamed when complete, so readers never see half of it.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoreline.operators._util import qcol
from shoreline.session import hadoop_path, remove_folder, scratch_folder

_CSV = {"nullValue": "NA", "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_ROWS = (1 << 33) - 1


def write_parts(df: DataFrame, folder: str, text: Column, order_by: Sequence[Column], separator: str) -> None:
    """The rows' ``text`` in order as one text file a task; every row but a part's first begins with ``separator``."""
    rows = df.orderBy(*order_by) if order_by else df
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS)) == 0
    value = F.when(first, text).otherwise(F.concat(F.lit(separator), text)) if separator else text
    rows.select(value.alias("value")).write.mode("overwrite").option("lineSep", "\n").option("compression", "none").text(folder)


def join_parts(spark: SparkSession, folder: str, path: str, prefix: str = "", separator: str = "", suffix: str = "") -> list[tuple[int, int]]:
    """Join the parts in ``folder``, by name, to the single file ``path``, which is replaced.  Returns
    offset and length of each part in it."""
    sc = spark.sparkContext
    fs, source = hadoop_path(spark, folder)
    _, target = hadoop_path(spark, path)
    _, draft = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.draft")
    parts = sorted(((s.getPath().getName(), s.getLen(), s.getPath()) for s in fs.listStatus(source)
                    if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda p: p[0])
    fs.mkdirs(target.getParent())
    places, at = [], 0
    out = fs.create(draft, True)
    try:
        def put(text: str) -> int:
            raw = text.encode()
            if raw:
                out.write(bytearray(raw))
            return len(raw)

        at += put(prefix)
        for n, (_, length, part) in enumerate(parts):
            at += put(separator if n else "")
            stream = fs.open(part)
            try:
                sc._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            finally:
                stream.close()
            places.append((at, length))
            at += length
        put(suffix)
        out.close()
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(draft, target):
            raise OSError(f"cannot move the finished document to {path}")
    finally:
        out.close()
        fs.delete(draft, False)
    return places


def _write(df: DataFrame, path: str, text: Column, order_by: Sequence[Column], prefix: str, separator: str, suffix: str) -> list[tuple[int, int]]:
    spark = df.sparkSession
    folder = scratch_folder(spark, "reports/parts")
    try:
        write_parts(df, folder, text, order_by, separator)
        return join_parts(spark, folder, path, prefix, separator, suffix)
    finally:
        remove_folder(spark, folder)


def in_order(order_by: Sequence[str | Column]) -> list[Column]:
    """Names ascending with NULL last, as grouped tables come; columns as they are."""
    return [qcol(c).asc_nulls_last() if isinstance(c, str) else c for c in order_by]


def write_csv_document(df: DataFrame, path: str, order_by: Sequence[str | Column] = (),
                       columns: Sequence[str] | None = None) -> list[tuple[int, int]]:
    """One CSV file: header, then the rows in order, NULL as ``NA``, quotes doubled.  Only ``columns`` are
    written, if given; rows may be ordered by others."""
    columns = df.columns if columns is None else list(columns)
    header = io.StringIO()
    csv.writer(header, lineterminator="\n").writerow(columns)
    text = F.to_csv(F.struct(*[qcol(c) for c in columns]), dict(_CSV))
    return _write(df, path, text, in_order(order_by), header.getvalue(), "", "")


def json_object(columns: Sequence[str], na: str | None = None) -> Column:
    """A row as the text of a JSON object: NULL fields left out, or written as the text ``na``.

    Each field is rendered by Spark's JSON writer in a one-field object, so keys and values are escaped alike."""
    if na is None:
        return F.to_json(F.struct(*[qcol(c) for c in columns]))
    inner = lambda c: F.regexp_replace(F.to_json(F.struct(c)), r"^\{|\}$", "")
    fields = [F.when(qcol(c).isNull(), inner(F.lit(na).alias(c))).otherwise(inner(qcol(c))) for c in columns]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def write_json_array(df: DataFrame, path: str, order_by: Sequence[str | Column] = (), na: str | None = None) -> list[tuple[int, int]]:
    """One JSON array with an object for each row in order; NULL fields are left out, or written as the
    text ``na``."""
    return _write(df, path, json_object(df.columns, na), in_order(order_by), "[\n", ",", "]\n")


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(place, line)``: the lines of one text file, numbered from 0, read in as many tasks as it has splits."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("start"), row.alias("row"))
    before = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("start").agg(F.count(F.lit(1)).alias("n"))  # a row a split
    offsets = splits.select("start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return lines.join(offsets, "start").select((F.col("offset") + F.col("row")).cast("long").alias("place"), "line")
