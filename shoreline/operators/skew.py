"""A join for keys that hold a large share of the rows, on either side, NULL included.

Adaptive execution splits hot partitions of inner and left joins only, and never those of a full
join.  Here the hot keys are found beforehand: a frequency sketch of each side names at most ``candidates``
keys, whose rows are then counted.  A key's rows are salted into ``a`` (left) times ``b``
(right) cells: a left row goes to one of the ``a`` and is copied to each of the ``b``, a right row the
other way round, so every pair of rows meets in exactly one cell and no task gets a whole hot key.

Copies without a partner in their cell are not unmatched: a side is only copied for keys that the
other side has, so such copies are dropped, and each unmatched row comes once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.operators._util import qcol

#: counters of the frequency sketch: a key is surely found that holds over 1/750 of the rows
_TRACKED = 1000


def _aliased(df: DataFrame, side: str) -> tuple[DataFrame, dict[str, str]]:
    names = {c: f"__{side}{i}" for i, c in enumerate(df.columns)}
    return df.select(*[qcol(c).alias(n) for c, n in names.items()]), names


def _same(pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(and_, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])


def hot_keys(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], candidates: int, min_rows: int, pieces: int) -> DataFrame:
    """``(__k0, ..., __a, __b)``: keys (left, right name each) with more rows on a side than the
    ``pieces``-th part of it, and into how many parts their rows of each side go.  At most
    ``2 * candidates`` rows (but for equal hashes); nothing runs before the result is used."""
    sides, sketches = [], []
    for n, df in enumerate((left, right)):
        own = [pair[n] for pair in keys]
        hashed = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(own)], F.xxhash64(*own).alias("__h"))
        top = hashed.agg(F.call_function("approx_top_k", F.col("__h"), F.lit(candidates), F.lit(_TRACKED)).alias("__t"))
        sketches.append(top.select(F.explode("__t").alias("__e")).select(F.col("__e.item").alias("__h")))
        sides.append(hashed)
    known = F.broadcast(sketches[0].unionByName(sketches[1]).distinct())
    ks = [f"__k{i}" for i in range(len(keys))]
    parts = []
    for n, rows in enumerate(sides):
        total = rows.agg(F.count(F.lit(1))).scalar()
        counts = rows.join(known, "__h", "left_semi").groupBy(*ks).agg(F.count(F.lit(1)).alias("__n"))
        most = F.greatest(F.lit(float(min_rows)), total / F.lit(float(pieces)))
        one, many = F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("__n") / most).cast("int"))
        parts.append(counts.select(*ks, (many if n == 0 else one).alias("__a"), (many if n == 1 else one).alias("__b")))
    both = parts[0].unionByName(parts[1]).groupBy(*ks).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    return both.filter((F.col("__a") > 1) | (F.col("__b") > 1))


def skew_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "full", suffixes: tuple[str, str] = ("_x", "_y"),
                   candidates: int = 64, min_rows: int = 10_000, pieces: int | None = None) -> DataFrame:
    """``null_safe_join`` that no key can slow down: equal result and columns.

    A key is split if a side has more than ``min_rows`` of its rows and more than a ``pieces``-th part
    of its rows (16 parts a shuffle partition if None).  The keys of both sides are read twice more:
    store inputs that are costly to compute.
    """
    if how not in ("left", "right", "full", "inner"):
        raise ValueError("how must be left, right, full or inner")
    on = list(on)
    if pieces is None:
        pieces = 16 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (lt, ln), (rt, rn) = _aliased(left, "l"), _aliased(right, "r")
    keys = [(ln[k], rn[k]) for k in on]
    hot = F.broadcast(hot_keys(lt, rt, keys, candidates, min_rows, pieces))  # 2 * candidates rows

    def salted(df: DataFrame, side: int, own: str, other: str) -> DataFrame:
        placed = df.join(hot, _same([(pair[side], f"__k{i}") for i, pair in enumerate(keys)]), "left")
        a, b = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        # by value and task, so that equal rows are dealt too and a task that runs again deals alike
        salt = F.pmod(F.xxhash64(*df.columns, F.spark_partition_id()), a).cast("int")
        copies = F.explode(F.when(b > 1, F.sequence(F.lit(0), b - 1)).otherwise(F.array(F.lit(0))))
        mark = "lr"[side]
        out = placed.select(*df.columns, salt.alias(f"__{mark}s"), (b > 1).alias(f"__{mark}copied"), copies.alias(f"__{mark}c"))
        return out.withColumn(f"__{mark}", F.lit(True))

    ls, rs = salted(lt, 0, "__a", "__b"), salted(rt, 1, "__b", "__a")
    on_cells = _same(keys) & (F.col("__ls") == F.col("__rc")) & (F.col("__lc") == F.col("__rs"))
    j = ls.join(rs, on_cells, "full_outer" if how == "full" else how)
    spare = (F.col("__r").isNull() & F.col("__lcopied")) | (F.col("__l").isNull() & F.col("__rcopied"))
    if how != "inner":
        j = j.filter(~F.coalesce(spare, F.lit(False)))
    both = (set(left.columns) & set(right.columns)) - set(on)
    out = []
    for k in on:
        lk, rk = F.col(ln[k]), F.col(rn[k])
        out.append((F.coalesce(lk, rk) if how == "full" else rk if how == "right" else lk).alias(k))
    out += [F.col(n).alias(c + suffixes[0] if c in both else c) for c, n in ln.items() if c not in on]
    out += [F.col(n).alias(c + suffixes[1] if c in both else c) for c, n in rn.items() if c not in on]
    return j.select(*out)
