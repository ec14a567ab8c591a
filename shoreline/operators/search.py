"""Regional and free-text lookup over published records.

Matching is an unanchored regular expression, as in the reference page:
selecting ``Virginia`` also finds ``West Virginia``, and a term is a pattern
(``(`` is an invalid pattern and raises).  Patterns are of the page's dialect and
translated for Java's engine (``functions.pattern``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.functions.pattern import to_java
from shoreline.functions.text import utf16_key
from shoreline.operators._util import qcol


def state_condition(state: Column, selected: str) -> Column:
    """The state picker's condition (see ``state_filter``)."""
    if selected in ("", "all"):
        return F.lower(state).rlike("all")
    return state.rlike(to_java(selected))


def state_filter(df: DataFrame, state_col: str, selected: str) -> DataFrame:
    """Rows whose state matches the selection.

    An empty selection or ``"all"`` keeps rows whose lower-cased state
    contains ``all`` (in practice: none), as the page does before a state
    is picked.
    """
    return df.filter(state_condition(qcol(state_col), selected))


def term_search(df: DataFrame, term: str, fields: Sequence[str],
                raw_term_fields: Iterable[str] = ()) -> DataFrame:
    """Rows where any field, lower-cased as text, matches ``term``.

    The term is lower-cased too, except for ``raw_term_fields`` where it is
    used as typed (so an upper-case term never matches those).  An empty
    term keeps every row.
    """
    if term == "":
        return df
    raw = set(raw_term_fields)
    conds = [F.lower(qcol(f).cast("string")).rlike(to_java(term if f in raw else term.lower())) for f in fields]
    return df.filter(reduce(or_, conds))


def lookup(df: DataFrame, state_col: str, selected: str, term: str, fields: Sequence[str],
           raw_term_fields: Iterable[str] = ()) -> DataFrame:
    """State filter, then term search: one narrow filter, no shuffle."""
    return term_search(state_filter(df, state_col, selected), term, fields, raw_term_fields)


def distinct_sorted(df: DataFrame, column: str, out_col: str | None = None, utf16: bool = False) -> DataFrame:
    """Distinct values of ``column`` in ascending order; with ``utf16`` as the page sorts texts, by UTF-16
    code units (characters beyond U+FFFF come before U+E000 to U+FFFF)."""
    name = out_col or column
    values = df.select(qcol(column).alias(name)).distinct()
    return values.orderBy(utf16_key(qcol(name)).asc_nulls_last() if utf16 else qcol(name).asc_nulls_last())
