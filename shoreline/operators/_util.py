from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def qcol(name: str) -> Column:
    """Column by exact name (names may hold dots, spaces or backticks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name not yet used in ``df``."""
    name, i = base, 0
    taken = set(df.columns)
    while name in taken:
        i += 1
        name = f"{base}_{i}"
    return name


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the relations ``df`` reads: the sum of its plan's leaf sizes.

    Planning only, no job.  Leaf sizes are file sizes (or local data); join
    estimates above the leaves are not used.  A checkpointed frame is a leaf
    that carries the estimate of the plan it was made from, so its size may
    be far too large.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # no JVM plan available (e.g. a remote session)
        return None
