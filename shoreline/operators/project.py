"""Projections: renames, short-key records, display rendering."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.functions.text import na_text
from shoreline.operators._util import qcol


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename ``old -> new``; names with spaces are allowed."""
    missing = [c for c in mapping if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumnsRenamed(dict(mapping))


def project_as(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Select ``source -> output`` pairs in the mapping's order."""
    return df.select(*[qcol(src).alias(out) for src, out in mapping.items()])


def render_na(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NULL -> ``"NA"`` in nullable columns; those columns become strings.

    Non-nullable columns keep their type.  A column mixing numbers and
    ``"NA"`` cannot keep a numeric type, so it is rendered as text.
    """
    targets = set(columns) if columns is not None else {f.name for f in df.schema.fields if f.nullable}
    return df.select(*[na_text(qcol(c)).alias(c) if c in targets else qcol(c) for c in df.columns])


def display_fields(df: DataFrame, upper: Iterable[str] = (), hide_na: Iterable[str] = ()) -> DataFrame:
    """Upper-case ``upper`` fields; NULL out ``hide_na`` fields equal to ``"NA"``."""
    up, hide = set(upper), set(hide_na)
    cols = []
    for c in df.columns:
        e = qcol(c)
        if c in hide:
            e = F.nullif(e.cast("string"), F.lit("NA"))
        if c in up:
            e = F.upper(e.cast("string"))
        cols.append(e.alias(c))
    return df.select(*cols)
