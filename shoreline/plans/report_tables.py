"""Report-shaped tables derived from the driver's tables, and the beach
products run on them.

The three reports the beach pipeline reads are not available, so Spark
derives tables of the same shape from orders, customers and nations: a
customer is a beach, an order an action (or a profile or summary row), a
nation a state.  The derivation is a projection of the whole tables (plus a
customer lookup), so the work grows with them; the products below are the
unchanged functions of ``plans.beaches``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shoreline.operators.project import render_na
from shoreline.plans import beaches as B
from shoreline.plans import lookup as L
from shoreline.session import materialize, scratch_folder
from shoreline.sinks import (
    document_lines, json_na_lines, r_style_numbers, write_csv, write_csv_document, write_json_array, write_json_lines,
)
from shoreline.sources.readers import ORDINAL, read_records, read_report, read_table
from shoreline.sources.schemas import ACTIONS_TYPES, PROFILE_TYPES, RECORD_SCHEMA, STATE_SUMMARY_TYPES

# State code given to each nation key 0..24 (includes codes the
# pipeline recodes or excludes).
NATION_CODES = ["WI", "BR", "MK", "CA", "GU", "NY", "VA", "WV", "FL", "TX", "AS", "MI", "MN",
                "OH", "IL", "IN", "PR", "HI", "VI", "ME", "MA", "NJ", "NC", "SC", "GA"]
# Order years are shifted so the pipeline's 2017/2018 fall inside the data.
YEAR_SHIFT = 20
LOOKUP_STATE = "Virginia"
LOOKUP_TERM = "elevated|^b1"


def _code(nationkey: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in NATION_CODES]), nationkey.cast("int") + 1)


def _orders_with_customer(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    c = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey",
                                                "c_mktsegment", "c_acctbal")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left")


def actions_table(spark: SparkSession, d: str) -> DataFrame:
    """Actions report: one row per order.  Customers with a negative balance have other
    beach ids here than in the profile report, so sites go unmatched on both sides."""
    x = _orders_with_customer(spark, d)
    k, prio, st, price = (F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus"),
                          F.col("o_totalprice"))
    null = F.lit(None).cast("string")
    letter = F.when(F.col("c_acctbal") < 0, F.lit("N")).otherwise(F.lit("B"))
    return x.select(
        F.concat(letter, F.col("o_custkey").cast("string")).alias("beach_id"),
        F.when(k % 13 == 0, F.concat(F.col("c_name"), F.lit(" Cove")))
         .otherwise(F.col("c_name")).alias("beach_name"),
        F.when(k % 53 == 0, null).otherwise(_code(F.col("c_nationkey"))).alias("state"),
        F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("county"),
        F.when(k % 101 == 0, null).when(st == "F", F.lit("Closure"))
         .when(st == "O", F.lit("Contamination Advisory"))
         .otherwise(F.lit("Rain Advisory")).alias("action_type"),
        F.when(prio == "1-URGENT", F.lit("ELEV_BACT")).when(prio == "2-HIGH", F.lit("RAINFALL"))
         .when(prio == "3-MEDIUM", F.lit("ELEV_BACT, RAINFALL"))
         .when(prio == "4-NOT SPECIFIED", F.lit("SEWAGE")).otherwise(null).alias("action_reasons"),
        F.when(price > 300000, F.lit("ENTERO,RATIO")).when(price > 150000, F.lit("ENTERO"))
         .when(st == "P", F.lit("PREEMPT")).otherwise(F.lit("FECAL_COL, TOTAL_COL"))
         .alias("action_indicator"),
        F.when(k % 5 == 0, null).when(k % 5 == 1, F.lit("CSO,SSO"))
         .when(k % 5 == 2, F.lit("POTW,SEWER_LINE")).when(k % 5 == 3, F.lit("STORM"))
         .otherwise(F.lit(" RUNOFF ")).alias("action_possible_source"),
        F.when(k % 97 == 0, F.lit(None).cast("long"))
         .otherwise(F.floor(price / 10000).cast("long")).alias("action_duration_days"),
        (F.year("o_orderdate") + YEAR_SHIFT).alias("year"),
        k.alias(ORDINAL))


def profile_table(spark: SparkSession, d: str) -> DataFrame:
    """Profile report: one status row per order, in order-key order."""
    x = _orders_with_customer(spark, d)
    prio = F.col("o_orderpriority")
    return x.select(
        F.concat(F.lit("B"), F.col("o_custkey").cast("string")).alias("beach_id"),
        F.col("c_name").alias("beach_name"),
        _code(F.col("c_nationkey")).alias("state_code"),
        F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("county"),
        F.when(prio == "1-URGENT", F.lit("Active"))
         .when(prio == "2-HIGH", F.lit("No advisory or closure"))
         .when(prio == "3-MEDIUM", F.lit("Historical"))
         .when(prio == "4-NOT SPECIFIED", F.lit("Dormant"))
         .otherwise(F.lit(None).cast("string")).alias("beach_status"),
        (F.year("o_orderdate") + YEAR_SHIFT).alias("year"),
        F.col("o_orderkey").alias(ORDINAL))


def summary_table(spark: SparkSession, d: str) -> DataFrame:
    """State summary report: one row of counts per order."""
    x = _orders_with_customer(spark, d)
    k, st, prio = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    jan = F.month("o_orderdate") == 1
    one = lambda cond: F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return x.select(
        _code(F.col("c_nationkey")).alias("state"),
        (F.year("o_orderdate") + YEAR_SHIFT).alias("year"),
        one((st == "P") & (prio == "1-URGENT") & jan).alias("no_of_beach_act_beaches"),
        F.when(k % 211 == 0, F.lit(None).cast("long"))
         .otherwise(one((st == "O") & jan)).alias("no_of_monitored_beaches"),
        one(st == "F").alias("no_of_monitored_beacheswith_actions"),
        one(st != "F").alias("no_of_monitored_beacheswithout_actions"),
        F.lit(1).cast("long").alias("total_no_of_beach_actions"),
        F.floor(F.col("o_totalprice") / 10000).cast("long")
         .alias("no_of_days_undera_beach_action_monitored_beaches"),
        F.floor(F.col("o_totalprice") / 100000).cast("long")
         .alias("no_of_days_not_undera_beach_action_monitored_beaches"),
        k.alias(ORDINAL))


def _clean(spark, d):
    return B.clean_actions(actions_table(spark, d))


def _all(spark, d):
    clean = _clean(spark, d)
    return B.all_beaches(B.per_beach(clean), B.profile_snapshot(profile_table(spark, d)))


def _all_counts(spark, d):
    """``_all`` without the lists."""
    return B.all_beaches(B.beach_counts(_clean(spark, d)), B.profile_snapshot(profile_table(spark, d)))


# Q1
def beach_clean_actions(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).drop(ORDINAL)


# Q2: one row per reason x indicator x source of each action
def beach_long_actions(spark: SparkSession, d: str) -> DataFrame:
    return B.long_actions(_clean(spark, d)).drop(ORDINAL)


# Q3 / graphic2
def beach_source_frequency(spark: SparkSession, d: str) -> DataFrame:
    return B.frequencies(_clean(spark, d))["action_possible_source"]


def beach_reason_frequency(spark: SparkSession, d: str) -> DataFrame:
    return B.frequencies(_clean(spark, d))["action_reasons"]


def beach_indicator_frequency(spark: SparkSession, d: str) -> DataFrame:
    return B.frequencies(_clean(spark, d))["action_indicator"]


# Q4-Q6
def beach_per_beach(spark: SparkSession, d: str) -> DataFrame:
    return B.per_beach(_clean(spark, d))


# Display headers of the actions report (read back to snake case).
ACTIONS_HEADERS = {
    "beach_id": "Beach ID", "beach_name": "Beach Name", "state": "State", "county": "County",
    "action_type": "Action Type", "action_reasons": "Action Reasons",
    "action_indicator": "Action Indicator", "action_possible_source": "Action Possible Source",
    "action_duration_days": "Action Duration Days", "year": "Year",
}


# S1, S4, S6 + Q4-Q6: the same product from a CSV report
def beach_csv_per_beach(spark: SparkSession, d: str) -> DataFrame:
    """Publish the actions as a CSV report with display headers (sorted, in
    the shared checkpoint folder), read it back with the report reader and
    build the per-beach table from it: header normalisation, ``NA``,
    quoting and the file-position ordinal all take part."""
    # a folder of its own per call: the returned DataFrame reads it lazily, so
    # no later call (or other application) may overwrite it
    path = scratch_folder(spark, "reports/actions")
    ordered = actions_table(spark, d).orderBy(ORDINAL).drop(ORDINAL)
    write_csv(ordered.withColumnsRenamed(ACTIONS_HEADERS), path)
    back = read_report(spark, path, ACTIONS_TYPES, multiline=False)
    return B.per_beach(B.clean_actions(back))


def _two_files(table: DataFrame, path: str, headers: dict[str, str]) -> None:
    """A report in two folders, the later rows with their columns the other way round."""
    middle = (table.agg(F.max(ORDINAL)).first()[0] or 0) // 2
    named = [F.col(c).alias(headers.get(c, c)) for c in table.columns if c != ORDINAL]
    early, late = table.filter(F.col(ORDINAL) <= middle), table.filter(F.col(ORDINAL) > middle)
    write_csv(early.orderBy(ORDINAL).select(*named), f"{path}/a")
    write_csv(late.orderBy(ORDINAL).select(*reversed(named)), f"{path}/b")


# The snapshot from a CSV report, where file order decides
def beach_csv_snapshot(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_folder(spark, "reports/profile")
    _two_files(profile_table(spark, d), path, {"beach_id": "Beach ID", "state_code": "State Code", "year": "Year"})
    back = read_report(spark, [f"{path}/a", f"{path}/b"], PROFILE_TYPES)
    return B.profile_snapshot(back).drop(ORDINAL)


# The state summaries from a CSV report
def beach_csv_state_summaries(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_folder(spark, "reports/summary")
    _two_files(summary_table(spark, d), path, {"state": "State", "total_no_of_beach_actions": "Total No. of Beach Actions"})
    back = read_report(spark, [f"{path}/a", f"{path}/b"], STATE_SUMMARY_TYPES)
    return B.state_summaries(back).withColumn("percent_monitored", F.round("percent_monitored", 6))


# Quoted fields with line breaks
def beach_csv_multiline(spark: SparkSession, d: str) -> DataFrame:
    """The per-beach table of a CSV report whose names hold line breaks and quotes."""
    path = scratch_folder(spark, "reports/multiline")
    broken = actions_table(spark, d).withColumn("beach_name", F.replace("beach_name", F.lit(" Cove"), F.lit('\n"Cove"')))
    write_csv(broken.orderBy(ORDINAL).drop(ORDINAL).withColumnsRenamed(ACTIONS_HEADERS), path)
    return B.per_beach(B.clean_actions(read_report(spark, path, ACTIONS_TYPES, multiline=True)))


# Q3: the three tables from one scan
def beach_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return B.frequency_table(_clean(spark, d))


# Q4-Q6 from the stored states of two deliveries
def beach_merged_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Per-beach table of two deliveries of actions, each aggregated and stored alone."""
    clean = _clean(spark, d)
    middle = (clean.agg(F.max(ORDINAL)).first()[0] or 0) // 2
    deliveries = [clean.filter(F.col(ORDINAL) <= middle), clean.filter(F.col(ORDINAL) > middle)]
    states = [materialize(B.beach_state(part, n), scratch_folder(spark, "reports/state")) for n, part in enumerate(deliveries)]
    return B.per_beach_of(states)


# Q7
def beach_state_sums(spark: SparkSession, d: str) -> DataFrame:
    out = B.state_sums(B.beach_counts(_clean(spark, d)))
    return out.withColumns({c: F.round(c, 6) for c in ("actionsperbeach", "daysperbeach")})


# Q8
def beach_states_by_contamination(spark: SparkSession, d: str) -> DataFrame:
    return B.states_by_contamination(beach_state_sums(spark, d))


# Q9
def beach_reason_shares(spark: SparkSession, d: str) -> DataFrame:
    return B.reason_shares(_clean(spark, d)).withColumn("Pct", F.round("Pct", 6))


def beach_reason_token_shares(spark: SparkSession, d: str) -> DataFrame:
    return B.reason_token_shares(_clean(spark, d)).withColumn("pct", F.round("pct", 6))


# Q10
def beach_with_closures(spark: SparkSession, d: str) -> DataFrame:
    return B.beaches_with(B.per_beach(_clean(spark, d)), "closure")


def beach_with_contamination(spark: SparkSession, d: str) -> DataFrame:
    return B.beaches_with(B.per_beach(_clean(spark, d)), "contamination_advisory")


def beach_with_rain(spark: SparkSession, d: str) -> DataFrame:
    return B.beaches_with(B.per_beach(_clean(spark, d)), "rain_advisory")


# Q11
def beach_action_types(spark: SparkSession, d: str) -> DataFrame:
    return B.action_type_counts(_clean(spark, d))


# Q12
def beach_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return B.profile_snapshot(profile_table(spark, d)).drop(ORDINAL)


def beach_snapshot_check_count(spark: SparkSession, d: str) -> DataFrame:
    return B.snapshot_check_count(B.profile_snapshot(profile_table(spark, d)))


# Q13
def beach_all_status(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d)


# Q14
def beach_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.status_counts(_all_counts(spark, d))["by_status"]


def beach_state_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.status_counts(_all_counts(spark, d))["by_state"]


def beach_dormant_with_actions(spark: SparkSession, d: str) -> DataFrame:
    return B.status_counts(_all(spark, d))["dormant_with_actions"]


# Q15 / graphic1
def beach_type_by_year(spark: SparkSession, d: str) -> DataFrame:
    return B.type_by_year(_clean(spark, d))


# Q16: the published JSON rows (missing as "NA")
def beach_publication(spark: SparkSession, d: str) -> DataFrame:
    pub = B.publication(_all(spark, d))
    return render_na(pub, columns=pub.columns)


# Q17
def beach_state_summaries(spark: SparkSession, d: str) -> DataFrame:
    out = B.state_summaries(summary_table(spark, d))
    return out.withColumn("percent_monitored", F.round("percent_monitored", 6))


# K6, K7: the summaries as their CSV files write them (whole numbers, Inf, NaN)
def beach_state_summaries_text(spark: SparkSession, d: str) -> DataFrame:
    return r_style_numbers(B.state_summaries(summary_table(spark, d)))


# K8: JSON rows, missing fields left out
def beach_json(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).select(F.to_json(F.struct("*")).alias("value"))


# K9: JSON rows of the publication, missing as "NA"
def beach_json_na(spark: SparkSession, d: str) -> DataFrame:
    return json_na_lines(B.publication(_all(spark, d)))


# The published records written, read back and searched
def beach_records_search(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_folder(spark, "reports/records")
    write_json_lines(_records(spark, d), path)
    return L.find(read_records(spark, path, RECORD_SCHEMA, multiline=False), LOOKUP_STATE, LOOKUP_TERM)


# Q18
def beach_lookup(spark: SparkSession, d: str) -> DataFrame:
    return L.find(_records(spark, d), LOOKUP_STATE, LOOKUP_TERM)


# Q18 on stored records: an index of text pieces, folders by state
def beach_lookup_indexed(spark: SparkSession, d: str) -> DataFrame:
    index = L.store(_records(spark, d), scratch_folder(spark, "reports/index"), block_rows=1024)
    return L.find_stored(index, LOOKUP_STATE, LOOKUP_TERM)


# F9 on stored records: only the folders of matching states are read
def beach_lookup_state(spark: SparkSession, d: str) -> DataFrame:
    index = L.store(_records(spark, d), scratch_folder(spark, "reports/index"), block_rows=1024)
    return L.find_stored(index, LOOKUP_STATE, "")


def _document(spark: SparkSession, df: DataFrame, order_by) -> DataFrame:
    """``(place, line)`` of the one file that ``df`` is published as."""
    path = f"{scratch_folder(spark, 'reports/document')}/table.csv"
    write_csv_document(df, path, order_by)
    return document_lines(spark, path)


# K2-K5, O3: the published files, line by line
def beach_document_beaches(spark: SparkSession, d: str) -> DataFrame:
    return _document(spark, B.per_beach(_clean(spark, d)), B.SITE_KEYS)


def beach_document_state_sums(spark: SparkSession, d: str) -> DataFrame:
    return _document(spark, r_style_numbers(beach_state_sums(spark, d)), B.state_order())


def beach_document_type_by_year(spark: SparkSession, d: str) -> DataFrame:
    return _document(spark, B.type_by_year(_clean(spark, d)), ["action_type", "year"])


def beach_document_sources(spark: SparkSession, d: str) -> DataFrame:
    return _document(spark, B.frequencies(_clean(spark, d))["action_possible_source"], ["action_possible_source"])


# K8, K9: one JSON array, read back
def beach_json_array(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch_folder(spark, 'reports/array')}/beaches.json"
    allb = _all(spark, d)
    write_json_array(allb, path, B.site_order())
    return read_records(spark, path, allb.schema)


def beach_json_na_array(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch_folder(spark, 'reports/array')}/allbeachesforpub.json"
    pub = B.publication(_all(spark, d))
    write_json_array(pub, path, B.site_order(B.PUBLICATION_LABELS), na="NA")
    return read_records(spark, path, StructType([StructField(c, StringType()) for c in pub.columns]))


def _records(spark, d):
    return L.short_records(B.publication(_all(spark, d)))


# Records as the page shows them
def beach_display(spark: SparkSession, d: str) -> DataFrame:
    return L.display(_records(spark, d))


# The state picker list
def beach_state_list(spark: SparkSession, d: str) -> DataFrame:
    rows = _all_counts(spark, d).withColumns({c: F.lit(None).cast("string") for c in B.LIST_COLUMNS})
    return L.state_list(L.short_records(B.publication(rows)))


QUERIES = {
    "beach_clean_actions": beach_clean_actions,
    "beach_long_actions": beach_long_actions,
    "beach_reason_frequency": beach_reason_frequency,
    "beach_indicator_frequency": beach_indicator_frequency,
    "beach_source_frequency": beach_source_frequency,
    "beach_per_beach": beach_per_beach,
    "beach_csv_per_beach": beach_csv_per_beach,
    "beach_state_sums": beach_state_sums,
    "beach_states_by_contamination": beach_states_by_contamination,
    "beach_reason_shares": beach_reason_shares,
    "beach_reason_token_shares": beach_reason_token_shares,
    "beach_with_closures": beach_with_closures,
    "beach_with_contamination": beach_with_contamination,
    "beach_with_rain": beach_with_rain,
    "beach_action_types": beach_action_types,
    "beach_snapshot": beach_snapshot,
    "beach_snapshot_check_count": beach_snapshot_check_count,
    "beach_all_status": beach_all_status,
    "beach_status_counts": beach_status_counts,
    "beach_state_counts": beach_state_counts,
    "beach_dormant_with_actions": beach_dormant_with_actions,
    "beach_type_by_year": beach_type_by_year,
    "beach_publication": beach_publication,
    "beach_state_summaries": beach_state_summaries,
    "beach_lookup": beach_lookup,
    "beach_display": beach_display,
    "beach_state_list": beach_state_list,
    "beach_csv_snapshot": beach_csv_snapshot,
    "beach_csv_state_summaries": beach_csv_state_summaries,
    "beach_state_summaries_text": beach_state_summaries_text,
    "beach_json": beach_json,
    "beach_json_na": beach_json_na,
    "beach_records_search": beach_records_search,
    "beach_csv_multiline": beach_csv_multiline,
    "beach_frequencies": beach_frequencies,
    "beach_merged_deliveries": beach_merged_deliveries,
    "beach_lookup_indexed": beach_lookup_indexed,
    "beach_lookup_state": beach_lookup_state,
    "beach_document_beaches": beach_document_beaches,
    "beach_document_state_sums": beach_document_state_sums,
    "beach_document_type_by_year": beach_document_type_by_year,
    "beach_document_sources": beach_document_sources,
    "beach_json_array": beach_json_array,
    "beach_json_na_array": beach_json_na_array,
}

__all__ = ["QUERIES", "actions_table", "profile_table", "summary_table"]
