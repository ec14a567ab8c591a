"""First-row de-duplication in a given row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoreline.functions.text import ColumnOrName, col_of
from shoreline.operators._util import fresh_name, qcol


def first_by(df: DataFrame, keys: Sequence[str], order_by: ColumnOrName | Sequence[ColumnOrName]) -> DataFrame:
    """Keep the first row per ``keys`` in ``order_by`` order.

    ``distinct(k1, k2, .keep_all = TRUE)`` with file order made explicit:
    ``order_by`` must be unique within a key, otherwise which tied row is
    kept is undefined.  Spark plans ``row_number() = 1`` as a partial
    WindowGroupLimit before the shuffle and a final one after it, so a hot
    key ships at most one row per map task.

    Filters written after this call are not pushed below it (the Window
    blocks predicates on non-key columns), so dedupe-then-filter keeps its
    meaning.
    """
    orders = [order_by] if isinstance(order_by, (str,)) or not isinstance(order_by, Sequence) else order_by
    rn = fresh_name(df, "__rn")
    w = Window.partitionBy(*[qcol(k) for k in keys]).orderBy(*[col_of(o).asc_nulls_last() for o in orders])
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) == 1).drop(rn)
