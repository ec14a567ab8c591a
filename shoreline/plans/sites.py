"""Report pipelines over any table of per-site events.

Each function is one product of the report pipeline with the column names
as parameters: the beach reports bind them in ``plans.beaches``; the same
functions run on other tables with other names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.operators._util import qcol
from shoreline.operators.aggregate import (
    count_by,
    grouped_sums_with_ratio,
    ordered_distinct_concat,
    site_lists_with_counts,
    sums_and_count,
    with_ratio_columns,
    with_total_row,
)
from shoreline.operators.dedupe import first_by
from shoreline.operators.filters import drop_unmatched_with_status
from shoreline.operators.joins import null_safe_join

Normalizer = Callable[[Column], Column]


def per_site_table(events: DataFrame, site_keys: Sequence[str], id_col: str,
                   lists: Mapping[str, str], order_by: str | Column,
                   count_col: str, sums: Mapping[str, str],
                   category_col: str | None, categories: Mapping[str, object],
                   normalize: Mapping[str, Normalizer] | None = None,
                   numbers: DataFrame | None = None) -> DataFrame:
    """Lists per site with counts per site id (left, NULL-safe).

    Sites are groups of ``site_keys`` (which include ``id_col``).  When one
    id has several key spellings, each of its rows gets the id's full
    counts, as in the reference.  By default lists and counts come from one
    pass over ``events``; ``numbers`` supplies a separate counts table
    instead, joined on ``id_col``.
    """
    if numbers is None:
        return site_lists_with_counts(events, site_keys, id_col, lists, order_by, count_col,
                                      sums, category_col, categories, normalize=normalize)
    collapsed = ordered_distinct_concat(events, site_keys, lists, order_by, normalize=normalize)
    return null_safe_join(collapsed, numbers, [id_col], "left")


def region_totals(sites: DataFrame, region_col: str, sum_cols: Sequence[str],
                  count_col: str, ratios: Mapping[str, tuple[str, str]],
                  total_label: str = "Total") -> DataFrame:
    """Per region: NA-removed sums, number of sites, per-site ratios, and a
    total row summing every numeric column (ratios included).

    One aggregate replaces the reference's sum, count and join on the same
    grouping.
    """
    by_region = sums_and_count(sites, [region_col], sum_cols, count_col)
    return with_total_row(with_ratio_columns(by_region, ratios), region_col, total_label)


def ranked_by_sum(df: DataFrame, a: str, b: str, out_col: str) -> DataFrame:
    """Add ``out = a + b`` and sort by it descending (ties by the other columns)."""
    out = df.withColumn(out_col, qcol(a) + qcol(b))
    return out.orderBy(qcol(out_col).desc_nulls_last(),
                       *[qcol(c).asc_nulls_last() for c in df.columns])


def snapshot(profile: DataFrame, id_col: str, status_col: str, order_by: str | Column,
             year_col: str, year, keep: Sequence[str],
             renames: Mapping[str, str] | None = None, keep_order: str | None = None) -> DataFrame:
    """First row per (id, status) in file order, *then* the rows of ``year``.

    The dedupe runs before the year filter: an (id, status) pair whose first
    row is from another year is not in the snapshot.  ``keep_order`` names
    an output column carrying the order (for a later dedupe).
    """
    first = first_by(profile, [id_col, status_col], order_by)
    first = first.filter(qcol(year_col) == F.lit(year))
    cols = [qcol(c) for c in keep]
    if keep_order:
        order = F.col(order_by) if isinstance(order_by, str) else order_by
        cols.append(order.alias(keep_order))
    out = first.select(*cols)
    return out.withColumnsRenamed(dict(renames)) if renames else out


def check_count(snap: DataFrame, status_col: str, excluded_status: str, id_col: str,
                order_by: str | Column, by: str, count_col: str = "n") -> DataFrame:
    """Sites per ``by`` without ``excluded_status``, one row per id (first)."""
    kept = snap.filter(qcol(status_col) != F.lit(excluded_status))
    return count_by(first_by(kept, [id_col], order_by), [by], count_col)


def sites_with_status(sites: DataFrame, snap: DataFrame, keys: Sequence[str], status_col: str,
                      match_col: str, out_col: str = "status",
                      historical: str = "Historical",
                      no_action: str = "No advisory or closure",
                      active: str = "Active",
                      active_no_action: str = "Active: No advisory or closure") -> DataFrame:
    """Full NULL-safe join of site table and status snapshot, then status.

    Drops historical sites with no event data (``match_col`` NULL); a NULL
    status with no event data drops too (three-valued filter).  The status
    text: the no-action status becomes ``active`` for a site with events and
    ``active_no_action`` without; any other status is kept, NULL as "NA".
    """
    joined = null_safe_join(sites, snap, keys, "full")
    kept = drop_unmatched_with_status(joined, status_col, historical, match_col)
    s, m = qcol(status_col), qcol(match_col)
    status = (F.when((s == F.lit(no_action)) & m.isNotNull(), F.lit(active))
              .when(s == F.lit(no_action), F.lit(active_no_action))
              .otherwise(F.coalesce(s, F.lit("NA"))))
    return kept.withColumn(out_col, status).drop(status_col)


def type_by_year(events: DataFrame, type_col: str, year_col: str, excluded_type: str,
                 count_col: str = "n") -> DataFrame:
    """Events per (type, year) without ``excluded_type`` (NULL type dropped)."""
    return count_by(events.filter(qcol(type_col) != F.lit(excluded_type)), [type_col, year_col],
                    count_col)


def yearly_summaries(summary: DataFrame, region_col: str, year_col: str, years: Sequence,
                     sums: Mapping[str, str], ratios: Mapping[str, tuple[str, str, float]],
                     order: Sequence[str]) -> DataFrame:
    """Per (year, region) for the given years in one pass: NA-propagating
    sums and scaled ratios of those sums (IEEE on zero denominators)."""
    rows = summary.filter(qcol(year_col).isin(list(years)))
    return grouped_sums_with_ratio(rows, [year_col, region_col], sums, ratios, na_rm=False,
                                   order=[year_col, region_col, *order])
