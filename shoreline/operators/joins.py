"""Joins that match NULL keys with NULL keys, and dimension lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.operators._util import input_bytes, qcol

_HOWS = {"left", "right", "full", "inner"}


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                   suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join on ``on`` where NULL matches NULL (``<=>`` on every key).

    Output: the keys (for a full join ``coalesce(left.k, right.k)``), then
    the other left columns, then the other right columns; a non-key name on
    both sides gets ``suffixes``.  Spark plans ``<=>`` keys as a sort-merge
    (or broadcast hash) join on ``(coalesce(k, default), isnull(k))`` pairs,
    never a nested loop.  All-NULL keys hash to one partition, so filter
    or pre-aggregate such rows first when they are many.
    """
    if how not in _HOWS:
        raise ValueError(f"how must be one of {sorted(_HOWS)}")
    on = list(on)
    lcols = [c for c in left.columns if c not in on]
    rcols = [c for c in right.columns if c not in on]
    both = set(lcols) & set(rcols)
    l_alias = {c: f"__l{i}" for i, c in enumerate(left.columns)}
    r_alias = {c: f"__r{i}" for i, c in enumerate(right.columns)}
    lt = left.select(*[qcol(c).alias(l_alias[c]) for c in left.columns])
    rt = right.select(*[qcol(c).alias(r_alias[c]) for c in right.columns])
    cond = reduce(and_, [lt[l_alias[k]].eqNullSafe(rt[r_alias[k]]) for k in on])
    j = lt.join(rt, cond, "full_outer" if how == "full" else how)

    def key(k):
        lk, rk = F.col(l_alias[k]), F.col(r_alias[k])
        if how == "full":
            return F.coalesce(lk, rk).alias(k)
        return (rk if how == "right" else lk).alias(k)

    out = [key(k) for k in on]
    out += [F.col(l_alias[c]).alias(c + suffixes[0] if c in both else c) for c in lcols]
    out += [F.col(r_alias[c]).alias(c + suffixes[1] if c in both else c) for c in rcols]
    return j.select(*out)


# Largest dimension input (bytes read) that ``bounded=True`` will broadcast;
# below Spark's own 10 MB default, since bytes on disk grow in memory.
MAX_BROADCAST_BYTES = 8 * 1024 * 1024


def dim_lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, dim_value: str,
               out_col: str | None = None, bounded: bool = False) -> DataFrame:
    """Replace/add ``out_col`` with the dimension value for ``key``.

    Left join: a code missing from the dimension gives NULL.  ``dim`` must
    be unique on ``dim_key``.  ``bounded=True`` marks a dimension whose size
    is fixed by construction (e.g. a literal code table) and broadcasts it
    if what it reads is known at planning time to be under
    ``MAX_BROADCAST_BYTES`` (a Python-built frame has no known size: use an
    inline ``VALUES`` table or a file); otherwise, and beyond that size, the
    planner chooses the join from the dimension's size statistics.
    """
    out_col = out_col or key
    d = dim.select(qcol(dim_key).alias("__dk"), qcol(dim_value).alias("__dv"))
    if bounded:
        size = input_bytes(dim)
        if size is not None and size <= MAX_BROADCAST_BYTES:
            d = F.broadcast(d)
    j = df.join(d, qcol(key) == F.col("__dk"), "left")
    cols = [F.col("__dv").alias(c) if c == out_col else qcol(c) for c in df.columns]
    if out_col not in df.columns:
        cols.append(F.col("__dv").alias(out_col))
    return j.select(*cols)
