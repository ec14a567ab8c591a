"""Delimited lists: split into rows, frequencies and token shares.

The reference splits three list columns one after another, which yields the
cross product of the three lists for every row; its frequency tables count
those combinations.  ``token_frequency`` gets the same counts without
materialising the product: it explodes one list and weights each element by
the product of the other lists' sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.functions.text import split_tokens, trim_unicode
from shoreline.operators._util import fresh_name, qcol

Normalizer = Callable[[Column], Column]


def clean_token(c: Column, trim: bool = True, normalize: Normalizer | None = None) -> Column:
    if trim:
        c = trim_unicode(c)
    if normalize is not None:
        c = normalize(c)
    return c


def by_count(df: DataFrame, keys: Sequence[str], count_col: str) -> DataFrame:
    """Sort a frequency table: count descending, then the keys, NULL last."""
    return df.orderBy(qcol(count_col).desc_nulls_last(), *[qcol(k).asc_nulls_last() for k in keys])


def split_rows(df: DataFrame, column: str, sep: str = ",", trim: bool = False,
               normalize: Normalizer | None = None, position_col: str | None = None) -> DataFrame:
    """One row per element of the delimited list in ``column``.

    A NULL list keeps its row with a NULL element; empty parts are kept
    (``'a,'`` gives ``a`` and ``''``).  Narrow: no shuffle.
    """
    pos, val = fresh_name(df, "__pos"), fresh_name(df, "__val")
    out = df.select("*", F.posexplode(split_tokens(qcol(column), sep)).alias(pos, val))
    value = clean_token(F.col(val), trim, normalize)
    cols = [value.alias(column) if c == column else qcol(c) for c in df.columns]
    if position_col:
        cols.append(F.col(pos).cast("long").alias(position_col))
    return out.select(*cols)


def long_form(df: DataFrame, columns: Sequence[str], sep: str = ",", trim: bool = True,
              normalize: dict[str, Normalizer] | None = None) -> DataFrame:
    """Split several list columns in sequence: the per-row cross product.

    This is the on-demand long table; its size is the product of the list
    lengths by definition.  Aggregates over it should use
    ``token_frequency`` instead.
    """
    normalize = normalize or {}
    # Each list is cleaned right after its own split, before later splits
    # multiply its values, so an element is cleaned once per source row.
    for c in columns:
        df = split_rows(df, c, sep=sep, trim=trim, normalize=normalize.get(c))
    return df


def token_frequency(df: DataFrame, column: str, cross_with: Iterable[str] = (), sep: str = ",",
                    trim: bool = True, normalize: Normalizer | None = None,
                    count_col: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """Count list elements of ``column`` (grouped by ``by``), NULL a group.

    With ``cross_with`` each element counts once per combination with the
    elements of those other list columns, i.e. the count over the long
    (cross-product) table, computed as a weighted count.

    Raw elements are counted first (map-side partial aggregation, so a
    dominant token is combined before the shuffle); trimming and
    normalisation then run once per distinct raw element and a second,
    small aggregate merges raw variants that normalise alike.
    """
    weight = reduce(mul, [F.size(split_tokens(qcol(c), sep)).cast("long") for c in cross_with],
                    F.lit(1).cast("long"))
    tok, w = fresh_name(df, "__tok"), fresh_name(df, "__w")
    bcols = [qcol(b) for b in by]
    ex = df.select(*bcols, F.explode(split_tokens(qcol(column), sep)).alias(tok), weight.alias(w))
    raw = ex.groupBy(*bcols, F.col(tok)).agg(F.sum(w).alias(w))
    if not trim and normalize is None:
        return raw.select(*bcols, F.col(tok).alias(column), F.col(w).alias(count_col))
    return (raw.groupBy(*bcols, clean_token(F.col(tok), trim, normalize).alias(column))
               .agg(F.sum(w).alias(count_col)))


def token_frequencies(df: DataFrame, columns: Sequence[str], sep: str = ",", trim: bool = True,
                      normalize: dict[str, Normalizer] | None = None, list_col: str = "list",
                      value_col: str = "value", count_col: str = "n") -> DataFrame:
    """``token_frequency`` of each of ``columns``, crossed with the others, in one pass: rows
    ``(list, value, n)``, ``list`` the column's name.

    Every row gives one array of its lists, each weighted by the product of the other lists' sizes; raw
    elements of all lists are counted in one aggregate, and cleaned once per distinct one.
    """
    normalize = normalize or {}
    sizes = [F.size(split_tokens(qcol(c), sep)).cast("long") for c in columns]
    per_list = [F.struct(F.lit(i).alias("__f"), qcol(c).cast("string").alias("__l"),
                         reduce(mul, [s for j, s in enumerate(sizes) if j != i], F.lit(1).cast("long")).alias("__w"))
                for i, c in enumerate(columns)]
    rows = df.select(F.inline(F.array(*per_list)))
    raw = (rows.select("__f", F.explode(split_tokens(F.col("__l"), sep)).alias("__tok"), "__w")
           .groupBy("__f", "__tok").agg(F.sum("__w").alias("__w")))
    of = lambda make: reduce(lambda acc, x: acc.when(F.col("__f") == x[0], make(x[1])), enumerate(columns), F)
    value = of(lambda c: clean_token(F.col("__tok"), trim, normalize.get(c)))
    return (raw.select(of(F.lit).alias(list_col), value.alias(value_col), "__w")
            .groupBy(list_col, value_col).agg(F.sum("__w").alias(count_col)))


def token_share(df: DataFrame, column: str, sep: str = ",", trim: bool = True,
                normalize: Normalizer | None = None, tokens: Sequence[str] | None = None,
                token_col: str = "token", count_col: str = "n",
                pct_col: str = "pct") -> DataFrame:
    """Percent of rows whose list in ``column`` holds each token.

    The denominator counts every row, including rows whose list is NULL.
    A row holding a token twice counts once.  ``tokens`` restricts the
    output to those tokens (others are dropped before the shuffle).

    Rows are counted by their raw list text first (map-side partial
    aggregation); each distinct text is then split, cleaned and
    de-duplicated once, weighted by its count.  The total is a one-row
    scalar subquery over the same counts, whose shuffle it reuses, so the
    result is lazy.  Sorted by count descending, then token, NULL last.
    """
    lst, w, tok = fresh_name(df, "__list"), fresh_name(df, "__w"), fresh_name(df, "__tok")
    texts = df.groupBy(qcol(column).alias(lst)).agg(F.count(F.lit(1)).alias(w))
    # cleaned in a projection of its own, so array_distinct sees each list once
    clean = F.transform(split_tokens(F.col(lst), sep), lambda x: clean_token(x, trim, normalize))
    ex = texts.select(F.explode(F.array_distinct(clean)).alias(tok), F.col(w))
    if tokens is not None:
        ex = ex.filter(F.col(tok).isin(list(tokens)))
    total = texts.agg(F.sum(w).cast("double")).scalar()
    out = ex.groupBy(F.col(tok).alias(token_col)).agg(F.sum(w).alias(count_col))
    return by_count(out.select(qcol(token_col), qcol(count_col),
                               (qcol(count_col) / total * 100).alias(pct_col)),
                    [token_col], count_col)
