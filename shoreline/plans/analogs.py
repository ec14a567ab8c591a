"""The report products run on the driver's tables.

Each query binds the report operators to columns of the TPC-H-like tables:
a customer plays the site, an order the event, a nation the state.  The
tables carry no NULLs, so some columns are made missing by a CASE on the
key (data shaping only: no row is filtered out by it).  Every query reads
whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.functions.arith import na_sum
from shoreline.functions.text import recode_chain, replace_first
from shoreline.operators.aggregate import (
    count_by,
    ordered_distinct_concat,
    share_of_total,
    summarize_counts,
)
from shoreline.operators.dedupe import first_by
from shoreline.operators.explode import long_form, token_frequency, token_share
from shoreline.operators.filters import keep_positive, recode_and_exclude
from shoreline.operators.joins import dim_lookup
from shoreline.operators.project import rename_columns, render_na
from shoreline.operators.search import distinct_sorted, lookup
from shoreline.operators.skew import skew_safe_join
from shoreline.plans import sites
from shoreline.sources.readers import read_table

# Fixed values used by the queries (the oracle SQL uses the same ones).
PRIORITY_RECODES = [("5-LOW", "2-HIGH"), ("3-", "4-")]
EXCLUDED_PRIORITIES = ["2-HIGH"]
NAME_RECODES = [("e", "E"), ("o", "0"), ("E", "3")]
REASON_RECODES = [("-", " "), ("NOT SPECIFIED", "NS")]
INDICATOR_RECODES = [("BIG", "LARGE")]
SOURCE_RECODES = [("URGENT", "URG")]
STATUS_CATEGORIES = {"n_f": "F", "n_o": "O", "n_p": "P"}
SUMMARY_YEARS = [1996, 1997]
SEARCH_STATE = "O"
SEARCH_TERM = "ring|^1"
PUBLISH_LABELS = {
    "c_custkey": "Customer ID",
    "c_name": "Customer name",
    "nation": "Nation",
    "segment": "Segment",
    "n_orders": "Total number of orders",
    "total_days": "Total days",
}

ORDER_LISTS = {"reasons": "reasons", "indicators": "indicators", "sources": "sources"}


def _reasons(c: Column) -> Column:
    return recode_chain(c, REASON_RECODES)


def _indicators(c: Column) -> Column:
    return recode_chain(c, INDICATOR_RECODES)


def _sources(c: Column) -> Column:
    return recode_chain(c, SOURCE_RECODES)


ORDER_NORMALIZERS = {"reasons": _reasons, "indicators": _indicators, "sources": _sources}


def order_events(spark: SparkSession, d: str) -> DataFrame:
    """Orders as site events: three list columns, a count, a category."""
    o = read_table(spark, d, "orders")
    k, prio, st = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    null = F.lit(None).cast("string")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate",
        "o_totalprice",
        F.when(k % 101 == 0, null).otherwise(st).alias("status"),
        F.when(k % 97 == 0, F.lit(None).cast("long"))
         .otherwise(F.floor(F.col("o_totalprice") / 10000).cast("long")).alias("days"),
        F.when(k % 3 == 0, null).when(k % 3 == 1, prio)
         .otherwise(F.concat(prio, F.lit(", "), st)).alias("reasons"),
        F.concat(st, F.lit(","), F.when(F.col("o_totalprice") > 200000, F.lit("BIG"))
                 .otherwise(F.lit("SMALL"))).alias("indicators"),
        F.when(k % 7 == 0, null)
         .otherwise(F.concat(F.substring(prio, F.lit(3), F.length(prio)), F.lit(" ,"), st)).alias("sources"),
    )


def customer_numbers(events: DataFrame) -> DataFrame:
    """Per customer: orders, days (NA if any NA), orders per status."""
    return summarize_counts(events, ["o_custkey"], "n_orders", {"total_days": "days"},
                            "status", STATUS_CATEGORIES)


def _nation_of_customer(spark: SparkSession, d: str) -> DataFrame:
    cust = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, d, "nation")
    return dim_lookup(cust, nation, "c_nationkey", "n_nationkey", "n_name", out_col="state")


# C1-C4, T1
def recode_replace_first(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    return p.select("p_partkey",
                    recode_chain(F.col("p_name"), NAME_RECODES).alias("name_recoded"),
                    replace_first(F.col("p_brand"), "#", "-").alias("brand_recoded"),
                    replace_first(F.col("p_type"), "[AEIOU]", "*").alias("type_recoded"))


# F1-F3, C1, T12
def exclude_codes(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    o = o.select("o_orderkey", "o_custkey",
                 F.when(F.col("o_orderkey") % 11 == 0, F.lit(None).cast("string"))
                  .otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return recode_and_exclude(o, "o_orderpriority", PRIORITY_RECODES, EXCLUDED_PRIORITIES)


def _line_list(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    n = F.col("l_linenumber") % 3
    return li.select(F.when(n == 0, F.lit(None).cast("string"))
                     .when(n == 1, F.col("l_returnflag"))
                     .otherwise(F.concat(F.col("l_returnflag"), F.lit(" ,"), F.col("l_linestatus"),
                                         F.lit(","))).alias("flags"))


# G1, A1, C5, T2
def token_frequency_q(spark: SparkSession, d: str) -> DataFrame:
    return token_frequency(_line_list(spark, d), "flags",
                           normalize=lambda c: recode_chain(c, [("N", "NONE")]))


def _two_lists(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    k, prio, st = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    return o.select("o_orderkey",
                    F.when(k % 4 == 0, F.lit(None).cast("string"))
                     .otherwise(F.concat(prio, F.lit(","), st)).alias("l1"),
                    F.when(k % 5 == 0, st)
                     .otherwise(F.concat(st, F.lit(",X,"), F.substring(prio, 1, 1))).alias("l2"))


# Count over the cross product without forming it
def token_frequency_weighted(spark: SparkSession, d: str) -> DataFrame:
    return token_frequency(_two_lists(spark, d), "l1", cross_with=["l2"])


# G1-G3 chained (the long table itself)
def long_form_q(spark: SparkSession, d: str) -> DataFrame:
    return long_form(_two_lists(spark, d), ["l1", "l2"])


# A6, T3, T4
def ordered_distinct_concat_q(spark: SparkSession, d: str) -> DataFrame:
    return ordered_distinct_concat(order_events(spark, d), ["o_custkey"], ORDER_LISTS,
                                   "o_orderkey", normalize=ORDER_NORMALIZERS)


# A5, T6
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return customer_numbers(order_events(spark, d))


# J1 (+A5, A6): lists per (customer, priority) with per-customer counts
def left_join_counts(spark: SparkSession, d: str) -> DataFrame:
    ev = order_events(spark, d)
    # orders of status P count for another id, so some customers go unmatched
    other = F.when(F.col("o_orderstatus") == "P", -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    numbers = customer_numbers(ev.withColumn("o_custkey", other))
    return sites.per_site_table(ev, ["o_custkey", "o_orderpriority"], "o_custkey", ORDER_LISTS,
                                "o_orderkey", "n_orders", {}, None, {},
                                normalize=ORDER_NORMALIZERS, numbers=numbers)


def _customer_sites(spark: SparkSession, d: str) -> DataFrame:
    numbers = customer_numbers(order_events(spark, d))
    nations = _nation_of_customer(spark, d)
    return dim_lookup(numbers, nations, "o_custkey", "c_custkey", "state", out_col="state")


STATE_SUM_COLS = ["n_orders", "total_days", "n_f", "n_o", "n_p"]


# A7, J2, P5, A8, T7, T10
def state_totals(spark: SparkSession, d: str) -> DataFrame:
    out = sites.region_totals(_customer_sites(spark, d), "state", STATE_SUM_COLS, "n_customers",
                              {"orders_per_customer": ("n_orders", "n_customers"),
                               "days_per_customer": ("total_days", "n_customers")})
    return out.withColumns({c: F.round(c, 6) for c in ("orders_per_customer", "days_per_customer")})


# P6, O2
def ranked_sum(spark: SparkSession, d: str) -> DataFrame:
    return sites.ranked_by_sum(state_totals(spark, d), "n_f", "n_o", "contam_close")


# A2, W1
def share_of_total_q(spark: SparkSession, d: str) -> DataFrame:
    out = share_of_total(read_table(spark, d, "orders"), ["o_orderpriority"], "n", "pct")
    return out.withColumn("pct", F.round("pct", 6))


# A11
def token_share_q(spark: SparkSession, d: str) -> DataFrame:
    out = token_share(order_events(spark, d), "reasons")
    return out.withColumn("pct", F.round("pct", 6))


# Dedupe first, filter after
def dedupe_first_then_filter(spark: SparkSession, d: str) -> DataFrame:
    ev = read_table(spark, d, "events")
    first = first_by(ev, ["user_id", "event_type"], "event_id")
    since = F.lit("2024-01-03 00:00:00").cast(ev.schema["ts"].dataType)
    return first.filter(F.col("ts") >= since).select("event_id", "user_id", "event_type", "value")


# F5, D2, A4
def dedupe_count(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").filter(F.col("o_orderstatus") != "F")
    return count_by(first_by(o, ["o_custkey"], "o_orderkey"), ["o_orderpriority"])


def _doc_sites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, d, "documents")
    lang = F.nullif(F.col("lang"), F.lit("fr")).alias("lang")
    # German documents get another id on this side only, so they go unmatched
    other = F.when(F.col("lang") == "de", -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    left = docs.select(other.alias("doc_id"), lang, F.col("source").alias("reasons"), "n_chars")
    labels = read_table(spark, d, "labels")
    langs = docs.select("doc_id", lang)
    status = (F.when(F.col("toxic") == 1, F.lit("Historical"))
              .when(F.col("quality") == 1, F.lit("No advisory or closure"))
              .when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string"))
              .otherwise(F.lit("Dormant")))
    right = (labels.join(langs, "doc_id", "left")
             .select("doc_id", "lang", status.alias("beach_status")))
    return left, right


# J3, F8, C6, C7, T8, T12
def full_join_status(spark: SparkSession, d: str) -> DataFrame:
    left, right = _doc_sites(spark, d)
    return sites.sites_with_status(left, right, ["doc_id", "lang"], "beach_status", "reasons")


# A4 on the joined table
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return count_by(full_join_status(spark, d), ["status"])


# F5, A3
def count_two_keys(spark: SparkSession, d: str) -> DataFrame:
    ev = order_events(spark, d).withColumn("year", F.year("o_orderdate"))
    return sites.type_by_year(ev, "status", "year", "F")


# F6
def positive_filter(spark: SparkSession, d: str) -> DataFrame:
    return keep_positive(customer_numbers(order_events(spark, d)), "n_p")


# J4, P4, K9
def dim_lookup_publish(spark: SparkSession, d: str) -> DataFrame:
    cust = read_table(spark, d, "customer")
    # only orders of status O count for the customer, the others for another id
    other = F.when(F.col("o_orderstatus") == "O", F.col("o_custkey")).otherwise(-F.col("o_custkey"))
    ev = order_events(spark, d).withColumn("o_custkey", other)
    numbers = summarize_counts(ev, ["o_custkey"], "n_orders", {"total_days": "days"})
    nation = read_table(spark, d, "nation")
    base = cust.select("c_custkey", "c_name", "c_nationkey",
                       F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("segment"))
    named = dim_lookup(base, nation, "c_nationkey", "n_nationkey", "n_name", out_col="nation")
    joined = named.join(numbers, named["c_custkey"] == numbers["o_custkey"], "left")
    table = joined.select("c_custkey", "c_name", "nation", "segment", "n_orders", "total_days")
    return render_na(rename_columns(table, PUBLISH_LABELS), columns=list(PUBLISH_LABELS.values()))


# A10, T6, T11
def year_state_summary(spark: SparkSession, d: str) -> DataFrame:
    ev = order_events(spark, d)
    jan = F.month("o_orderdate") == 1
    rows = ev.select(
        F.year("o_orderdate").alias("year"), "o_custkey",
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT") & jan, 1)
         .otherwise(0).alias("v_total"),
        F.when(F.col("o_orderkey") % 211 == 0, F.lit(None).cast("int"))
         .when((F.col("o_orderstatus") == "O") & jan, 1).otherwise(0).alias("v_monitored"),
        (F.col("o_orderstatus") == "F").cast("int").alias("v_with"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("v_price_k"))
    # additive sums per customer and year come before the join: a NULL stays a NULL
    rows = rows.filter(F.col("year").isin(SUMMARY_YEARS)).groupBy("year", "o_custkey").agg(
        *[na_sum(F.col(c)).alias(c) for c in ("v_total", "v_monitored", "v_with", "v_price_k")])
    rows = dim_lookup(rows, _nation_of_customer(spark, d), "o_custkey", "c_custkey", "state",
                      out_col="state")
    out = sites.yearly_summaries(
        rows, "state", "year", SUMMARY_YEARS,
        {"total": "v_total", "monitored": "v_monitored", "with_actions": "v_with",
         "price_k": "v_price_k"},
        {"percent_monitored": ("monitored", "total", 100.0)},
        ["total", "monitored", "percent_monitored", "with_actions", "price_k"])
    return out.withColumn("percent_monitored", F.round("percent_monitored", 6))


def part_records(spark: SparkSession, d: str) -> DataFrame:
    """Parts as published short-key records."""
    p = read_table(spark, d, "part")
    return p.select(F.col("p_name").alias("bn"), F.col("p_partkey").cast("string").alias("bi"),
                    F.col("p_type").alias("s"), F.col("p_brand").alias("c"),
                    F.col("p_size").cast("string").alias("na"), F.upper("p_name").alias("r"),
                    F.col("p_type").alias("st"))


# F9-F11, T13
def regex_search(spark: SparkSession, d: str) -> DataFrame:
    found = lookup(part_records(spark, d), "s", SEARCH_STATE, SEARCH_TERM,
                   ["bn", "bi", "s", "c", "r", "na", "st"], raw_term_fields=["r"])
    return found.select("bi", "bn", "s")


# nothing selected
def regex_search_unselected(spark: SparkSession, d: str) -> DataFrame:
    found = lookup(part_records(spark, d), "s", "", SEARCH_TERM,
                   ["bn", "bi", "s", "c", "r", "na", "st"], raw_term_fields=["r"])
    return found.select("bi", "bn", "s")


# D4
def distinct_sorted_q(spark: SparkSession, d: str) -> DataFrame:
    return distinct_sorted(part_records(spark, d), "s")


def skewed_full_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders and customers, joined in full where a third of the orders has no customer key, and another third
    the same one; one customer has no key either (NULL matches NULL)."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("long")
    orders = read_table(spark, d, "orders").select(
        F.when(k % 3 == 0, none).when(k % 3 == 1, F.lit(1).cast("long")).otherwise(F.col("o_custkey")).alias("custkey"),
        "o_orderkey", "o_orderstatus")
    customers = read_table(spark, d, "customer").select(
        F.when(F.col("c_custkey") == 2, none).otherwise(F.col("c_custkey")).alias("custkey"), "c_name", "c_mktsegment")
    return skew_safe_join(orders, customers, ["custkey"], "full", min_rows=100)


QUERIES = {
    "skewed_full_join": skewed_full_join,
    "recode_replace_first": recode_replace_first,
    "exclude_codes": exclude_codes,
    "token_frequency": token_frequency_q,
    "token_frequency_weighted": token_frequency_weighted,
    "long_form": long_form_q,
    "ordered_distinct_concat": ordered_distinct_concat_q,
    "conditional_counts": conditional_counts,
    "left_join_counts": left_join_counts,
    "state_totals": state_totals,
    "ranked_sum": ranked_sum,
    "share_of_total": share_of_total_q,
    "token_share": token_share_q,
    "dedupe_first_then_filter": dedupe_first_then_filter,
    "dedupe_count": dedupe_count,
    "full_join_status": full_join_status,
    "status_counts": status_counts,
    "count_two_keys": count_two_keys,
    "positive_filter": positive_filter,
    "dim_lookup_publish": dim_lookup_publish,
    "year_state_summary": year_state_summary,
    "regex_search": regex_search,
    "regex_search_unselected": regex_search_unselected,
    "distinct_sorted": distinct_sorted_q,
}
