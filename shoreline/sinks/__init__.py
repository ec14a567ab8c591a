"""Sinks: CSV with NA for missing, JSON lines with or without NULL fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoreline.operators._util import qcol
from shoreline.sinks.document import document_lines, json_object, write_csv_document, write_json_array


def sorted_for_output(df: DataFrame, order_by: Sequence[str] | None) -> DataFrame:
    """Sort by ``order_by`` (NULLs last) just before writing; no-op if None."""
    if not order_by:
        return df
    return df.orderBy(*[qcol(c).asc_nulls_last() for c in order_by])


def r_style_numbers(df: DataFrame) -> DataFrame:
    """Render floating-point columns as R's CSV writer does.

    Whole numbers lose the ``.0`` (``2.0`` -> ``2``), infinities are
    ``Inf``/``-Inf``, NaN is ``NaN``; other values use Spark's shortest
    round-trip text.  Other columns are unchanged.  Row-local.
    """
    cols = []
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = c.cast("double")
            text = (F.when(F.isnan(d), F.lit("NaN"))
                    .when(d == float("inf"), F.lit("Inf"))
                    .when(d == float("-inf"), F.lit("-Inf"))
                    .when((d == F.floor(d)) & (F.abs(d) < F.lit(1e15)), d.cast("long").cast("string"))
                    .otherwise(d.cast("string")))
            c = text
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, order_by: Sequence[str] | None = None,
              single_file: bool = False, mode: str = "overwrite",
              partition_by: Sequence[str] | None = None) -> None:
    """CSV with header; NULL written as ``NA``, quotes doubled; a directory of part files
    (``write_csv_document`` writes one file).

    ``order_by`` range-partitions and sorts, so the part files read in
    order.  ``single_file`` coalesces to one task: only for outputs bounded
    by construction (one row per state, per type and year, ...).
    ``partition_by`` writes one sub-directory per value (readers prune).
    """
    out = sorted_for_output(df, order_by)
    if single_file:
        out = out.coalesce(1)
    w = out.write.mode(mode).option("header", True).option("nullValue", "NA").option("emptyValue", "").option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; NULL fields are omitted from the object."""
    df.write.mode(mode).json(path)


def json_na_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row (column ``value``): missing values as ``"NA"``,
    present values with their own JSON type (numbers stay numbers).

    Each field is rendered by ``to_json`` of a one-field struct, so keys and
    strings are escaped and numbers formatted by Spark's JSON writer; a NULL
    field becomes the string ``"NA"``.  Row-local, no shuffle.
    """
    return df.select(json_object(df.columns, "NA").alias("value"))


def write_json_na(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; NULL written as the string ``"NA"``, other
    values keep their JSON type (as the reference's JSON with NA as text)."""
    json_na_lines(df).write.mode(mode).text(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


__all__ = ["document_lines", "json_na_lines", "r_style_numbers", "sorted_for_output", "write_csv", "write_csv_document", "write_json_array",
           "write_json_lines", "write_json_na", "write_parquet"]
