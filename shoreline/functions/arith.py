"""Numeric expressions with R's missing-value and division semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoreline.functions.text import ColumnOrName, col_of


def ieee_divide(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """``n / d`` as a double with IEEE results for a zero denominator.

    NULL in either input gives NULL; ``x/0`` is +/-Infinity (the sign of
    ``x`` flipped for a ``-0.0`` denominator) and ``0/0`` or ``NaN/0`` is
    NaN.  Spark's ANSI ``/`` raises on a zero divisor, and ``try_divide``
    returns NULL, so the cases are spelled out.
    """
    n = col_of(numerator).cast("double")
    d = col_of(denominator).cast("double")
    negative_zero = d.cast("string").startswith("-")
    positive = ((n > 0) & ~negative_zero) | ((n < 0) & negative_zero)
    return (F.when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
            .when(d != 0, n / d)
            .when(F.isnan(n) | (n == 0), F.lit(float("nan")))
            .when(positive, F.lit(float("inf")))
            .otherwise(F.lit(float("-inf"))))


def na_sum(c: ColumnOrName) -> Column:
    """Aggregate: sum that is NULL when any input is NULL (R ``sum``).

    Both counts are algebraic, so the aggregate keeps map-side partial
    aggregation.
    """
    c = col_of(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def sum_or_zero(c: ColumnOrName) -> Column:
    """Aggregate: sum skipping NULLs, 0 for an all-NULL group (``na.rm=TRUE``)."""
    return F.coalesce(F.sum(col_of(c)), F.lit(0))


def count_equal(c: ColumnOrName, value) -> Column:
    """Aggregate: number of rows equal to ``value``; NULL if any input is NULL."""
    return na_sum((col_of(c) == F.lit(value)).cast("long"))
