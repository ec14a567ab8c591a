"""Row filters (three-valued logic: a NULL condition drops the row)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.functions.text import recode_chain
from shoreline.operators._util import qcol


def exclude_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Drop rows whose ``column`` is one of ``values``.

    Same as a chain of ``column != v`` conditions: a NULL ``column`` is
    dropped too.  The predicate reaches the Parquet scan as ``Not(In)``.
    """
    return df.filter(~qcol(column).isin(list(values)))


def recode_and_exclude(df: DataFrame, column: str, recodes: Iterable[tuple[str, str]],
                       excluded: Iterable) -> DataFrame:
    """Recode ``column`` with first-match replacements, then exclude codes.

    The recode runs first, so a value recoded into an excluded code is
    dropped and one recoded out of it is kept.
    """
    return exclude_values(df.withColumn(column, recode_chain(qcol(column), recodes)),
                          column, excluded)


def keep_positive(df: DataFrame, column: str) -> DataFrame:
    """Rows with ``column > 0``; NULL counts drop out."""
    return df.filter(qcol(column) > 0)


def drop_unmatched_with_status(df: DataFrame, status_col: str, status_value: str,
                               match_col: str) -> DataFrame:
    """``filter(!(status == value & is.na(match)))``.

    Three-valued: a NULL status with a NULL match column gives NULL and the
    row is dropped; this is the reference's behaviour and is kept.
    """
    cond = (qcol(status_col) == F.lit(status_value)) & qcol(match_col).isNull()
    return df.filter(~cond)
