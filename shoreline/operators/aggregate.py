"""Aggregations: ordered distinct lists, conditional counts, totals, shares."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoreline.functions.arith import count_equal, ieee_divide, na_sum, sum_or_zero
from shoreline.functions.text import ColumnOrName, col_of, split_tokens
from shoreline.operators._util import fresh_name, is_integral, is_numeric, qcol
from shoreline.operators.explode import by_count, clean_token

Normalizer = Callable[[Column], Column]


def _first_appearances(df: DataFrame, keys: Sequence[str], fields: list[tuple[str, str]],
                       order_by: ColumnOrName, sep: str) -> DataFrame:
    """Per (keys, list, raw element): first (order ``__o``, position ``__p``) of the element.

    One row per (row, list) and one per distinct raw element of the list
    (no lambdas).
    """
    if not fields:
        raise ValueError("at least one list column is required")
    kcols = [qcol(k) for k in keys]
    ordv = fresh_name(df, "__ord")
    per_list = F.array(*[F.struct(F.lit(fi).alias("__f"), qcol(src).cast("string").alias("__l"))
                         for fi, (_, src) in enumerate(fields)])
    rows = df.select(*kcols, col_of(order_by).alias(ordv), F.inline(per_list))
    # array_distinct keeps first occurrences in order, so a raw value has one
    # position per row and (order, position) has no ties within a group.
    items = rows.select(*kcols, ordv, "__f", F.posexplode(
        F.array_distinct(split_tokens(F.col("__l"), sep))).alias("__pos", "__raw"))
    grouped = items.groupBy(*kcols, F.col("__f"), F.col("__raw"))
    if is_integral(items.schema[ordv].dataType):
        return grouped.agg(F.min(ordv).alias("__o"), F.min_by("__pos", ordv).alias("__p"))
    firsts = grouped.agg(F.min(F.struct(F.col(ordv).alias("o"), F.col("__pos").alias("p"))).alias("__first"))
    return firsts.select(*kcols, "__f", "__raw", F.col("__first.o").alias("__o"),
                         F.col("__first.p").alias("__p"))


def _cleaned(fields: list[tuple[str, str]], trim: bool, normalize: Mapping[str, Normalizer]) -> Column:
    """The trimmed and normalised value of a raw element of its list ``__f``."""
    value = None
    for fi, (out, _) in enumerate(fields):
        expr = clean_token(F.col("__raw"), trim, normalize.get(out))
        value = (F.when(F.col("__f") == fi, expr) if value is None
                 else value.when(F.col("__f") == fi, expr))
    return value.otherwise(F.lit(None).cast("string"))


def _place(firsts: DataFrame, delivery: int = 0) -> Column:
    """(delivery, order, position) as one number, where the order is one: that keeps aggregates hashed."""
    if not is_integral(firsts.schema["__o"].dataType):
        return F.struct("__o", "__p")
    place = F.col("__o").cast("decimal(20,0)") * 2**31 + F.col("__p")
    return (place + F.lit(Decimal(delivery * 2**94))).cast("decimal(38,0)")


def _joined_lists(fields: list[tuple[str, str]], joiner: str, na: str) -> list[Column]:
    """The values ``(__f, __at, __v)`` of a group, one text a list in their order."""
    out = []
    for fi, (name, _) in enumerate(fields):
        lst = F.array_sort(F.collect_list(F.when(F.col("__f") == fi, F.struct("__at", "__v"))))
        out.append(F.array_join(F.transform(lst, lambda e: e["__v"]), joiner, na).alias(name))
    return out


def ordered_distinct_concat(df: DataFrame, keys: Sequence[str], lists: Mapping[str, str],
                            order_by: ColumnOrName, sep: str = ",", joiner: str = ", ",
                            trim: bool = True,
                            normalize: Mapping[str, Normalizer] | None = None,
                            na: str = "NA") -> DataFrame:
    """Per group of ``keys``: the distinct elements of each list column,
    joined by ``joiner`` in order of first appearance.

    ``lists`` maps output name -> source list column.  Elements are split on
    ``sep``, trimmed and normalised; a NULL list or element counts as the
    value ``na``.  First appearance is the smallest (``order_by``, position
    in the list); ``order_by`` must be unique per row.

    Plan: first appearance per (keys, list, raw element) by a hash aggregate
    with map-side partial aggregation; trimming and normalisation then run
    once per distinct raw element, not per row.  These are shuffled by the keys
    once, for both the first appearance of each normalised value and the
    lists.  Every shuffle carries de-duplicated data; a group's
    state is bounded by its number of distinct normalised values, not its
    rows or spellings, and no cross product of the lists is formed.
    """
    fields = list(lists.items())
    kcols = [qcol(k) for k in keys]
    firsts = _first_appearances(df, keys, fields, order_by, sep)
    values = firsts.select(*kcols, "__f", _place(firsts).alias("__at"), _cleaned(fields, trim, normalize or {}).alias("__v"))
    once = values.repartition(*kcols).groupBy(*kcols, F.col("__f"), F.col("__v")).agg(F.min("__at").alias("__at"))
    return once.groupBy(*kcols).agg(*_joined_lists(fields, joiner, na))


@dataclass(frozen=True)
class Counts:
    """What is counted per site id: rows as ``count_col``, NA-propagating ``sums`` (output -> column), and
    rows of each of ``categories`` (output -> value of ``category_col``)."""

    count_col: str
    sums: Mapping[str, str] = field(default_factory=dict)
    category_col: str | None = None
    categories: Mapping[str, object] = field(default_factory=dict)

    def measures(self) -> list[Column]:
        return [*(qcol(c) for c in self.sums.values()),
                *((qcol(self.category_col) == F.lit(v)).cast("long") for v in self.categories.values())]

    def names(self) -> list[str]:
        """Columns of partial counts: rows, then values present and their sum for each measure."""
        return ["__rows", *[f"__{p}{i}" for i in range(len(self.sums) + len(self.categories)) for p in ("c", "s")]]

    def partial(self) -> list[Column]:
        out = [F.count(F.lit(1)).alias("__rows")]
        for i, m in enumerate(self.measures()):
            out += [F.count(m).alias(f"__c{i}"), F.sum(m).alias(f"__s{i}")]
        return out

    def of_id(self, id_col: str) -> list[Column]:
        """The results of the rows' id, from partial counts by site: sums over the rows of one id."""
        same = Window.partitionBy(qcol(id_col))
        rows = F.sum("__rows").over(same)
        out = [rows.alias(self.count_col)]
        for i, name in enumerate([*self.sums, *self.categories]):
            out.append(F.when(F.sum(f"__c{i}").over(same) == rows, F.sum(f"__s{i}").over(same)).alias(name))
        return out


def site_counts(df: DataFrame, site_keys: Sequence[str], id_col: str, count_col: str,
                sums: Mapping[str, str] | None = None, category_col: str | None = None,
                categories: Mapping[str, object] | None = None) -> DataFrame:
    """One row per site (``site_keys``) with the counts of its *id*.

    Counts per id as ``summarize_counts``; an id spelled several ways counts
    fully on each of its rows (NULL ids match).  Rows are aggregated once,
    by site; the sites are then shuffled by their id once, and summed over it.
    """
    counts = Counts(count_col, sums or {}, category_col, categories or {})
    kcols = [qcol(k) for k in site_keys]
    return df.groupBy(*kcols).agg(*counts.partial()).select(*kcols, *counts.of_id(id_col))


def site_state(df: DataFrame, site_keys: Sequence[str], lists: Mapping[str, str], order_by: ColumnOrName, counts: Counts,
               sep: str = ",", delivery: int = 0) -> DataFrame:
    """Partial aggregates of events, from which ``site_table`` makes the table of sites: a row for each
    (site, list, raw element) with its first place, and one for each site with its partial counts.

    States can be stored and merged (``merge_states``), so a new delivery of events is aggregated alone.
    ``delivery`` numbers it: its rows come after those of smaller numbers.
    """
    firsts = _first_appearances(df, site_keys, list(lists.items()), order_by, sep)
    kcols = [qcol(k) for k in site_keys]
    per_site = df.groupBy(*kcols).agg(*counts.partial())
    types = {f.name: f.dataType for f in per_site.schema.fields}
    elements = firsts.select(*kcols, "__f", "__raw", _place(firsts, delivery).alias("__at"),
                             *[F.lit(None).cast(types[n]).alias(n) for n in counts.names()])
    numbers = per_site.select(*kcols, F.lit(-1).alias("__f"), F.lit(None).cast("string").alias("__raw"),
                              F.lit(None).cast(elements.schema["__at"].dataType).alias("__at"), *counts.names())
    return elements.unionByName(numbers)


def merge_states(states: Sequence[DataFrame], site_keys: Sequence[str], counts: Counts) -> DataFrame:
    """The state of all events of several states (of different deliveries)."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy(*[qcol(k) for k in site_keys], "__f", "__raw").agg(
        F.min("__at").alias("__at"), *[F.sum(n).cast(every.schema[n].dataType).alias(n) for n in counts.names()])


def site_table(state: DataFrame, site_keys: Sequence[str], id_col: str, lists: Mapping[str, str], counts: Counts, joiner: str = ", ",
               trim: bool = True, normalize: Mapping[str, Normalizer] | None = None, na: str = "NA") -> DataFrame:
    """One row per site of a ``site_state``: ordered distinct lists, and the counts of the site's id.

    The state is shuffled by the site's keys, for lists and counts alike, then by its id.
    """
    fields = list(lists.items())
    kcols = [qcol(k) for k in site_keys]
    names = counts.names()
    values = state.select(*kcols, "__f", _cleaned(fields, trim, normalize or {}).alias("__v"), "__at", *names)
    once = values.repartition(*kcols).groupBy(*kcols, F.col("__f"), F.col("__v")).agg(
        F.min("__at").alias("__at"), *[F.sum(n).alias(n) for n in names])
    sites = once.groupBy(*kcols).agg(*_joined_lists(fields, joiner, na), *[F.sum(n).alias(n) for n in names])
    return sites.select(*kcols, *[qcol(out) for out, _ in fields], *counts.of_id(id_col))


def site_lists_with_counts(df: DataFrame, site_keys: Sequence[str], id_col: str,
                           lists: Mapping[str, str], order_by: ColumnOrName,
                           count_col: str, sums: Mapping[str, str] | None = None,
                           category_col: str | None = None,
                           categories: Mapping[str, object] | None = None,
                           sep: str = ",", joiner: str = ", ", trim: bool = True,
                           normalize: Mapping[str, Normalizer] | None = None,
                           na: str = "NA") -> DataFrame:
    """Ordered distinct lists per site (as ``ordered_distinct_concat``) plus counts per site *id* (as ``site_counts``)."""
    counts = Counts(count_col, sums or {}, category_col, categories or {})
    state = site_state(df, site_keys, lists, order_by, counts, sep)
    return site_table(state, site_keys, id_col, lists, counts, joiner, trim, normalize, na)


def summarize_counts(df: DataFrame, key: Sequence[str], count_col: str = "n",
                     sums: Mapping[str, str] | None = None,
                     category_col: str | None = None,
                     categories: Mapping[str, object] | None = None) -> DataFrame:
    """One row per key: row count, NA-propagating sums, category counts.

    ``sums`` maps output -> column summed without removing NULLs (NULL if any
    input is NULL).  ``categories`` maps output -> value; each counts rows
    whose ``category_col`` equals the value, NULL if any category is NULL.
    One hash aggregate with map-side partial aggregation.
    """
    aggs = [F.count(F.lit(1)).alias(count_col)]
    for out, c in (sums or {}).items():
        aggs.append(na_sum(qcol(c)).alias(out))
    for out, v in (categories or {}).items():
        aggs.append(count_equal(qcol(category_col), v).alias(out))
    return df.groupBy(*[qcol(k) for k in key]).agg(*aggs)


def sums_and_count(df: DataFrame, by: Sequence[str], sum_cols: Sequence[str],
                   count_col: str = "n") -> DataFrame:
    """Per group: ``sum(c, na.rm=TRUE)`` (0 for all-NULL) and the row count.

    Fuses a grouped sum and a grouped count of the same table joined on the
    group key into one aggregate.
    """
    aggs = [sum_or_zero(qcol(c)).alias(c) for c in sum_cols]
    aggs.append(F.count(F.lit(1)).alias(count_col))
    return df.groupBy(*[qcol(b) for b in by]).agg(*aggs)


def with_total_row(df: DataFrame, label_col: str, label: str = "Total",
                   fill: str | None = "-") -> DataFrame:
    """Append a row summing every numeric column (NULLs skipped).

    Ratio columns are summed too, like the reference's totals row.  String
    columns other than ``label_col`` get ``fill``, other columns NULL; a sum
    keeps its own type (e.g. long for an int column) and the union widens
    the column to it.  The total is a global
    aggregate with partial aggregation per partition.
    """
    if not isinstance(df.schema[label_col].dataType, T.StringType):
        raise ValueError(f"label column {label_col!r} must be a string column")
    aggs = []
    for f in df.schema.fields:
        if f.name == label_col:
            aggs.append(F.lit(label).alias(f.name))
        elif is_numeric(f.dataType):
            # the sum keeps its own, wider type; the union widens the column
            aggs.append(sum_or_zero(qcol(f.name)).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            aggs.append(F.lit(fill).cast("string").alias(f.name))
        else:
            aggs.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.unionByName(df.agg(*aggs))


def with_ratio_columns(df: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add ``out = numerator / denominator`` (IEEE on a zero denominator)."""
    return df.withColumns({out: ieee_divide(qcol(n), qcol(d)) for out, (n, d) in ratios.items()})


def share_of_total(df: DataFrame, by: Sequence[str], count_col: str = "n",
                   pct_col: str = "pct") -> DataFrame:
    """Row count per group and its percent of all rows.

    The denominator is a one-row scalar subquery over the grouped counts,
    whose shuffle it reuses: lazy, one scan, and no window gathers the groups
    into a single task.  Sorted by count descending, then the keys, NULL last.
    """
    counts = df.groupBy(*[qcol(b) for b in by]).agg(F.count(F.lit(1)).alias(count_col))
    total = counts.agg(F.sum(count_col).cast("double")).scalar()
    return by_count(counts.withColumn(pct_col, qcol(count_col) / total * 100), by, count_col)


def count_by(df: DataFrame, by: Sequence[str], count_col: str = "n") -> DataFrame:
    """``count(...)``: rows per group, NULL a group of its own."""
    return df.groupBy(*[qcol(b) for b in by]).agg(F.count(F.lit(1)).alias(count_col))


def grouped_sums_with_ratio(df: DataFrame, by: Sequence[str], sums: Mapping[str, str],
                            ratios: Mapping[str, tuple[str, str, float]] | None = None,
                            na_rm: bool = False, order: Sequence[str] | None = None) -> DataFrame:
    """Per group: sums of columns and ratios of those sums.

    ``sums`` maps output -> input column; without ``na_rm`` a sum is NULL if
    any input is NULL.  ``ratios`` maps output -> (numerator output,
    denominator output, scale); a zero denominator gives NaN/Infinity.
    ``order`` fixes the output column order (keys first by default).
    """
    fn = sum_or_zero if na_rm else na_sum
    out = df.groupBy(*[qcol(b) for b in by]).agg(*[fn(qcol(c)).alias(o) for o, c in sums.items()])
    for o, (n, d, scale) in (ratios or {}).items():
        out = out.withColumn(o, ieee_divide(qcol(n), qcol(d)) * F.lit(float(scale)))
    if order is not None:
        out = out.select(*[qcol(c) for c in order])
    return out
