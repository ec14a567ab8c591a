"""The beach-report products, bound to the reports' column names.

Inputs are the three reports as read by ``sources.read_report`` (snake-case
columns, ``_ord`` file position).  Every product is a lazy DataFrame;
``run_reports`` writes the published files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.functions.text import recode_chain
from shoreline.operators._util import qcol
from shoreline.operators.aggregate import (
    Counts, count_by, merge_states, share_of_total, site_counts, site_state, site_table, summarize_counts,
)
from shoreline.operators.explode import by_count, long_form, token_frequencies, token_frequency, token_share
from shoreline.operators.filters import keep_positive, recode_and_exclude
from shoreline.operators.joins import dim_lookup
from shoreline.operators.project import rename_columns
from shoreline.plans import sites
from shoreline.session import materialize, remove_folder, scratch_folder
from shoreline.sinks import (
    r_style_numbers, write_csv, write_csv_document, write_json_array, write_json_lines, write_json_na,
)
from shoreline.sources.dims import state_dimension
from shoreline.sources.readers import ORDINAL, read_report
from shoreline.sources.schemas import ACTIONS_TYPES, PROFILE_TYPES, STATE_SUMMARY_TYPES

# Fixed values of the report pipeline (they must stay as they are for equal results).
STATE_RECODES = [("BR", "WI"), ("MK", "WA")]
EXCLUDED_STATES = ["AS", "CN", "GP", "GU", "MP", "VI"]
SOURCE_RECODES = [
    ("CSO", "COMBINED SEWER OVERFLOW"),
    ("SSO", "SANITARY SEWER OVERFLOW"),
    ("POTW", "PUBLICLY-OWNED TREATMENT WORKS"),
    ("SEWER_LINE", "SEWER LINE"),
]
INDICATOR_RECODES = [
    ("ENTERO", "ENTEROCOCCI"),
    ("PREEMPT", "PREEMPTORY ACTION"),
    ("FECAL_COL", "FECAL COLIFORM"),
    ("TOTAL_COL", "TOTAL COLIFORM"),
    ("RATIO", "FECAL-TO-TOTAL COLIFORM RATIO"),
]
REASON_RECODES = [("ELEV_BACT", "ELEVATED BACTERIA")]
ACTION_TYPES = {
    "closure": "Closure",
    "rain_advisory": "Rain Advisory",
    "contamination_advisory": "Contamination Advisory",
}
SNAPSHOT_YEAR = 2018
SUMMARY_YEARS = [2017, 2018]
PUBLICATION_LABELS = {
    "beach_id": "EPA beach ID",
    "beach_name": "Beach name",
    "state": "State",
    "county": "County",
    "reasons": "Action reasons",
    "indicators": "Bacteria indicators",
    "sources": "Possible pollution sources",
    "no_of_beach_actions": "Total number of beach actions",
    "no_of_days_under_action": "Total number of days under action",
    "closure": "Total number of beach closures",
    "rain_advisory": "Total number of rain advisories",
    "contamination_advisory": "Total number of contamination advisories",
    "status": "2018 beach reporting status",
}
STATE_SUMMARY_SUMS = {
    "total_beaches": "no_of_beach_act_beaches",
    "monitored_beaches": "no_of_monitored_beaches",
    "beaches_with_actions": "no_of_monitored_beacheswith_actions",
    "beaches_without_actions": "no_of_monitored_beacheswithout_actions",
    "total_actions": "total_no_of_beach_actions",
    "total_days_under_action": "no_of_days_undera_beach_action_monitored_beaches",
    "total_days_not_under_action": "no_of_days_not_undera_beach_action_monitored_beaches",
}
STATE_SUMMARY_ORDER = [
    "total_beaches", "monitored_beaches", "percent_monitored", "beaches_with_actions",
    "beaches_without_actions", "total_actions", "total_days_under_action",
    "total_days_not_under_action",
]

LIST_COLUMNS = {
    "reasons": "action_reasons",
    "indicators": "action_indicator",
    "sources": "action_possible_source",
}
SITE_KEYS = ["beach_id", "beach_name", "state", "county"]
STATE_SUM_COLS = ["no_of_beach_actions", "no_of_days_under_action", "closure",
                  "contamination_advisory", "rain_advisory"]


def _reason(c: Column) -> Column:
    return recode_chain(c, REASON_RECODES)


def _indicator(c: Column) -> Column:
    return recode_chain(c, INDICATOR_RECODES)


def _source(c: Column) -> Column:
    return recode_chain(c, SOURCE_RECODES)


NORMALIZERS = {"reasons": _reason, "indicators": _indicator, "sources": _source}
COLUMN_NORMALIZERS = {"action_reasons": _reason, "action_indicator": _indicator,
                      "action_possible_source": _source}


# Q1
def clean_actions(actions: DataFrame) -> DataFrame:
    """Recode tribal codes into states, drop territories (NULL state too)."""
    return recode_and_exclude(actions, "state", STATE_RECODES, EXCLUDED_STATES)


# Q2
def long_actions(clean: DataFrame) -> DataFrame:
    """One row per reason x indicator x source of each action, normalised."""
    return long_form(clean, list(LIST_COLUMNS.values()), normalize=COLUMN_NORMALIZERS)


# Q3
def frequencies(clean: DataFrame) -> dict[str, DataFrame]:
    """Counts of reasons, indicators and sources over the long form, most frequent first."""
    cols = list(LIST_COLUMNS.values())
    return {c: by_count(token_frequency(clean, c, cross_with=[o for o in cols if o != c],
                                        normalize=COLUMN_NORMALIZERS[c]), [c], "n") for c in cols}


def frequency_table(clean: DataFrame) -> DataFrame:
    """All of ``frequencies`` from one scan: ``(list, value, n)``, by list, most frequent first."""
    counts = token_frequencies(clean, list(LIST_COLUMNS.values()), normalize=COLUMN_NORMALIZERS)
    return counts.orderBy("list", F.desc("n"), F.asc_nulls_last("value"))


# Q5
def beach_numbers(clean: DataFrame) -> DataFrame:
    """Per beach id: actions, days under action (NA if any NA), type counts."""
    return summarize_counts(clean, ["beach_id"], "no_of_beach_actions",
                            {"no_of_days_under_action": "action_duration_days"},
                            "action_type", ACTION_TYPES)


# Q4 + Q6
def per_beach(clean: DataFrame) -> DataFrame:
    """One row per beach (id, name, state, county): lists and counts."""
    return sites.per_site_table(clean, SITE_KEYS, "beach_id", LIST_COLUMNS, ORDINAL,
                                "no_of_beach_actions",
                                {"no_of_days_under_action": "action_duration_days"},
                                "action_type", ACTION_TYPES, normalize=NORMALIZERS)


#: what is counted per beach id
BEACH_COUNTS = Counts("no_of_beach_actions", {"no_of_days_under_action": "action_duration_days"}, "action_type", ACTION_TYPES)


def beach_state(clean: DataFrame, delivery: int = 0) -> DataFrame:
    """Partial aggregates of one delivery of cleaned actions, to be stored; deliveries are numbered in their order."""
    return site_state(clean, SITE_KEYS, LIST_COLUMNS, ORDINAL, BEACH_COUNTS, delivery=delivery)


def per_beach_of(states: list[DataFrame]) -> DataFrame:
    """``per_beach`` of all deliveries, from their states."""
    merged = merge_states(states, SITE_KEYS, BEACH_COUNTS)
    return site_table(merged, SITE_KEYS, "beach_id", LIST_COLUMNS, BEACH_COUNTS, normalize=NORMALIZERS)


def beach_counts(clean: DataFrame) -> DataFrame:
    """``per_beach`` without its lists: for products that only count."""
    return site_counts(clean, SITE_KEYS, "beach_id", "no_of_beach_actions",
                       {"no_of_days_under_action": "action_duration_days"}, "action_type", ACTION_TYPES)


# Q7
def state_sums(beaches: DataFrame) -> DataFrame:
    """Per state sums, beaches, per-beach ratios, and the Total row."""
    out = sites.region_totals(beaches, "state", STATE_SUM_COLS, "n",
                              {"actionsperbeach": ("no_of_beach_actions", "n"),
                               "daysperbeach": ("no_of_days_under_action", "n")})
    return out.withColumnRenamed("n", "number_of_beaches_with_actions")


# Q8
def states_by_contamination(sums: DataFrame) -> DataFrame:
    return sites.ranked_by_sum(sums, "closure", "contamination_advisory", "contamclose")


# Q9
def reason_shares(clean: DataFrame) -> DataFrame:
    """Actions per raw reasons text and percent of all actions."""
    return share_of_total(clean, ["action_reasons"], "n", "Pct")


def reason_token_shares(clean: DataFrame, tokens=("ELEV_BACT", "RAINFALL")) -> DataFrame:
    """Percent of actions whose reasons list holds each token."""
    return token_share(clean, "action_reasons", tokens=list(tokens))


# Q10
def beaches_with(beaches: DataFrame, column: str) -> DataFrame:
    return keep_positive(beaches, column)


# Q11
def action_type_counts(clean: DataFrame) -> DataFrame:
    return count_by(clean, ["action_type"])


# Q12
def profile_snapshot(profile: DataFrame) -> DataFrame:
    """2018 statuses: first row per (beach, status) in file order, then 2018."""
    clean = recode_and_exclude(profile, "state_code", STATE_RECODES, EXCLUDED_STATES)
    return sites.snapshot(clean, "beach_id", "beach_status", ORDINAL, "year", SNAPSHOT_YEAR,
                          ["beach_id", "beach_name", "state_code", "county", "beach_status"],
                          {"state_code": "state"}, keep_order=ORDINAL)


def snapshot_check_count(snap: DataFrame) -> DataFrame:
    return sites.check_count(snap, "beach_status", "Historical", "beach_id", ORDINAL, "state")


# Q13
def all_beaches(beaches: DataFrame, snap: DataFrame) -> DataFrame:
    # the count is never NULL on a beach with actions, so it tells matches apart
    # and products that don't show the lists need not build them
    return sites.sites_with_status(beaches, snap.drop(ORDINAL), SITE_KEYS, "beach_status",
                                   "no_of_beach_actions")


# Q14
def status_counts(allb: DataFrame) -> dict[str, DataFrame]:
    return {
        "by_state": count_by(allb, ["state"]),
        "by_status": count_by(allb, ["status"]),
        "dormant_with_actions": allb.filter((F.col("status") == "Dormant")
                                            & (F.col("no_of_beach_actions") > 0)),
    }


# Q15
def type_by_year(clean: DataFrame) -> DataFrame:
    return sites.type_by_year(clean, "action_type", "year", "Rain Advisory")


# Q16
def publication(allb: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """State code -> name, display labels."""
    spark = spark or allb.sparkSession
    named = dim_lookup(allb, state_dimension(spark), "state", "code", "name", bounded=True)
    return rename_columns(named, PUBLICATION_LABELS)


# Q17
def clean_state_summary(summary: DataFrame) -> DataFrame:
    return recode_and_exclude(summary, "state", STATE_RECODES, EXCLUDED_STATES)


def state_summaries(summary: DataFrame, years=SUMMARY_YEARS) -> DataFrame:
    return sites.yearly_summaries(
        clean_state_summary(summary), "state", "year", list(years), STATE_SUMMARY_SUMS,
        {"percent_monitored": ("monitored_beaches", "total_beaches", 100.0)},
        STATE_SUMMARY_ORDER)


@dataclass
class Reports:
    clean: DataFrame
    beaches: DataFrame
    state_sums: DataFrame
    snapshot: DataFrame
    all_beaches: DataFrame
    publication: DataFrame
    type_by_year: DataFrame
    sources: DataFrame
    state_summaries: DataFrame


def build_reports(actions: DataFrame, profile: DataFrame, summary: DataFrame,
                  folder: str | None = None) -> Reports:
    """All products as lazy DataFrames.

    With ``folder`` (shared by all executors) the reused intermediates are
    written there as Parquet: the cleaned actions (read by five products),
    the per-beach table and the joined all-beaches table (one row per site
    each, read by several outputs).  Each is then computed once, later reads
    take only the columns they need, and a lost executor does not send the
    later jobs back to the reports.
    """
    def kept(df: DataFrame, name: str) -> DataFrame:
        return materialize(df, f"{folder}/{name}") if folder else df

    clean = kept(clean_actions(actions), "clean")
    beaches = kept(per_beach(clean), "beaches")
    snap = profile_snapshot(profile)
    allb = kept(all_beaches(beaches, snap), "all_beaches")
    return Reports(clean=clean, beaches=beaches, state_sums=state_sums(beaches), snapshot=snap,
                   all_beaches=allb, publication=publication(allb),
                   type_by_year=type_by_year(clean),
                   sources=frequencies(clean)["action_possible_source"],
                   state_summaries=state_summaries(summary))


def story(r: Reports) -> dict[str, DataFrame]:
    """The results the reference script prints or views rather than writes.

    Frequencies, reason shares and token shares, beaches with closures,
    contamination or rain actions, action types, the profile check count,
    counts by state and status, dormant beaches with actions, and states
    ranked by closures plus contamination advisories.  All lazy.
    """
    freq = frequencies(r.clean)
    counts = status_counts(r.all_beaches)
    return {
        "reason_frequency": freq["action_reasons"],
        "indicator_frequency": freq["action_indicator"],
        "source_frequency": freq["action_possible_source"],
        "reason_shares": reason_shares(r.clean),
        "reason_token_shares": reason_token_shares(r.clean),
        "beaches_with_closures": beaches_with(r.beaches, "closure"),
        "beaches_with_contamination": beaches_with(r.beaches, "contamination_advisory"),
        "beaches_with_rain": beaches_with(r.beaches, "rain_advisory"),
        "action_types": action_type_counts(r.clean),
        "profile_check_count": snapshot_check_count(r.snapshot),
        "beaches_by_state": counts["by_state"],
        "beaches_by_status": counts["by_status"],
        "dormant_with_actions": counts["dormant_with_actions"],
        "states_by_contamination": states_by_contamination(r.state_sums),
    }


def register_views(r: Reports, prefix: str = "") -> list[str]:
    """Expose every product as a temporary view for ``spark.sql`` users.

    Views are lazy (no job); names are the product names with ``prefix``.
    """
    names = []
    for name in Reports.__dataclass_fields__:
        view = f"{prefix}{name}"
        getattr(r, name).createOrReplaceTempView(view)
        names.append(view)
    return names


def run_reports(spark: SparkSession, actions_path: str, profile_path: str, summary_path: str,
                out_dir: str, multiline: bool = False, single_files: bool = False) -> Reports:
    """Read the three reports and write the published files under ``out_dir``: folders of parts, or
    with ``single_files`` one file each, rows in the reference's order.

    Intermediates live in a folder under ``spark.checkpoint.dir`` that is
    removed at the end; the returned products are lazy over the reports.
    """
    reports = (read_report(spark, actions_path, ACTIONS_TYPES, multiline),
               read_report(spark, profile_path, PROFILE_TYPES, multiline),
               read_report(spark, summary_path, STATE_SUMMARY_TYPES, multiline))
    folder = scratch_folder(spark, "reports/run")
    try:
        publish = _publish_files if single_files else _publish
        publish(build_reports(*reports, folder=folder), out_dir)
    finally:
        remove_folder(spark, folder)
    return build_reports(*reports)


def state_order() -> list[Column]:
    """States by code, the Total row last."""
    return [(F.col("state") == "Total").asc(), F.col("state").asc_nulls_last()]


def site_order(labels: dict[str, str] | None = None) -> list[Column]:
    """Sites with actions by key, then profile-only ones (the reference keeps these in file order)."""
    name = lambda c: qcol((labels or {}).get(c, c))
    return [name("no_of_beach_actions").isNull().asc(), *[name(k).asc_nulls_last() for k in [*SITE_KEYS, "status"]]]


def _publish_files(r: Reports, out_dir: str) -> None:
    """The nine published files, each one document."""
    out = out_dir.rstrip("/")
    shown = [c for c in r.clean.columns if c != ORDINAL]
    write_csv_document(r.clean, f"{out}/beach_actions_clean.csv", [ORDINAL], columns=shown)
    write_csv_document(r.beaches, f"{out}/all_beach_vars.csv", SITE_KEYS)
    write_csv_document(r_style_numbers(r.state_sums), f"{out}/statesums.csv", state_order())
    write_csv_document(r.type_by_year, f"{out}/graphic1.csv", ["action_type", "year"])
    write_csv_document(r.sources, f"{out}/graphic2.csv", ["action_possible_source"])
    for year in SUMMARY_YEARS:
        summary = r.state_summaries.filter(F.col("year") == year).drop("year")
        write_csv_document(r_style_numbers(summary), f"{out}/{year}_state_summaries.csv", ["state"])
    write_json_array(r.all_beaches, f"{out}/beaches.json", site_order())
    write_json_array(r.publication, f"{out}/allbeachesforpub.json", site_order(PUBLICATION_LABELS), na="NA")


def _publish(r: Reports, out_dir: str) -> None:
    out = out_dir.rstrip("/")
    # The largest output is written without a global sort: each part file
    # holds its input split's rows in input order, and no shuffle is added.
    write_csv(r.clean.drop(ORDINAL), f"{out}/beach_actions_clean")
    write_csv(r.beaches, f"{out}/all_beach_vars", order_by=SITE_KEYS)
    # states in order, the Total row last (one row per state: one file)
    write_csv(r_style_numbers(r.state_sums.orderBy(*state_order())), f"{out}/statesums", single_file=True)
    write_csv(r.type_by_year, f"{out}/graphic1", order_by=["action_type", "year"], single_file=True)
    write_csv(r.sources, f"{out}/graphic2", order_by=["action_possible_source"])
    write_csv(r_style_numbers(r.state_summaries), f"{out}/state_summaries", order_by=["state"],
              partition_by=["year"])
    write_json_lines(r.all_beaches.orderBy(*site_order()), f"{out}/beaches_json")
    write_json_na(r.publication.orderBy(*site_order(PUBLICATION_LABELS)), f"{out}/allbeachesforpub_json")
