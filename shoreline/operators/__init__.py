"""DataFrame -> DataFrame operators, parameterised by column names."""

from shoreline.operators.aggregate import (
    Counts,
    count_by,
    grouped_sums_with_ratio,
    merge_states,
    ordered_distinct_concat,
    share_of_total,
    site_state,
    site_table,
    sums_and_count,
    summarize_counts,
    with_ratio_columns,
    with_total_row,
)
from shoreline.operators.dedupe import first_by
from shoreline.operators.explode import long_form, split_rows, token_frequencies, token_frequency, token_share
from shoreline.operators.filters import (
    drop_unmatched_with_status,
    exclude_values,
    keep_positive,
    recode_and_exclude,
)
from shoreline.operators.joins import dim_lookup, null_safe_join
from shoreline.operators.project import display_fields, project_as, rename_columns, render_na
from shoreline.operators.search import distinct_sorted, lookup, state_filter, term_search
from shoreline.operators.skew import skew_safe_join

__all__ = [
    "Counts", "count_by", "dim_lookup", "display_fields", "distinct_sorted", "drop_unmatched_with_status",
    "exclude_values", "first_by", "grouped_sums_with_ratio", "keep_positive", "long_form",
    "lookup", "merge_states", "null_safe_join", "ordered_distinct_concat", "project_as", "recode_and_exclude",
    "rename_columns", "render_na", "share_of_total", "site_state", "site_table",
    "skew_safe_join", "split_rows", "state_filter",
    "sums_and_count", "summarize_counts", "term_search", "token_frequencies", "token_frequency",
    "token_share",
    "with_ratio_columns", "with_total_row",
]
