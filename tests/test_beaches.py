"""The beach-report products on the fixture rows (expected values: FIXTURES.md)."""

import math

import pytest

from fixtures import ACTIONS, ACTIONS_SCHEMA, PROFILE, PROFILE_SCHEMA, SUMMARY, SUMMARY_SCHEMA, frame
from shoreline.plans import beaches as B


@pytest.fixture(scope="module")
def reports(spark):
    return B.build_reports(frame(spark, ACTIONS, ACTIONS_SCHEMA), frame(spark, PROFILE, PROFILE_SCHEMA),
                           frame(spark, SUMMARY, SUMMARY_SCHEMA))


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_clean_and_long(reports):
    assert reports.clean.count() == 7
    assert sorted(r["beach_id"] for r in reports.clean.collect()) == ["B1", "B1", "B2", "B3", "B3", "B4", "B4"]
    assert B.long_actions(reports.clean).count() == 12


def test_frequencies_count_combinations(reports):
    f = B.frequencies(reports.clean)
    as_dict = lambda df, c: {r[c]: r["n"] for r in df.collect()}
    assert as_dict(f["action_reasons"], "action_reasons") == {
        "ELEVATED BACTERIA": 5, "RAINFALL": 4, "SEWAGE": 2, None: 1}
    assert as_dict(f["action_indicator"], "action_indicator") == {
        "ENTEROCOCCI": 6, "FECAL COLIFORM": 2, "PREEMPTORY ACTION": 2,
        "FECAL-TO-TOTAL COLIFORM RATIO": 1, "TOTAL COLIFORM": 1}
    assert as_dict(f["action_possible_source"], "action_possible_source") == {
        "COMBINED SEWER OVERFLOW": 2, "RUNOFF": 2, "SANITARY SEWER OVERFLOW": 2,
        "PUBLICLY-OWNED TREATMENT WORKS": 1, "SEWER LINE": 1, "STORM": 1, "UNKNOWN": 1, None: 2}


def test_weighted_frequency_equals_long_form_count(reports):
    long = B.long_actions(reports.clean)
    for c, df in B.frequencies(reports.clean).items():
        expected = {r[c]: r["count"] for r in long.groupBy(c).count().collect()}
        assert {r[c]: r["n"] for r in df.collect()} == expected


def test_per_beach_table(reports):
    got = rows(reports.beaches, "beach_id", "beach_name", "state", "county", "reasons", "indicators",
               "sources", "no_of_beach_actions", "no_of_days_under_action", "closure",
               "rain_advisory", "contamination_advisory")
    assert got == sorted([
        ("B1", "Alpha", "WI", "Door", "ELEVATED BACTERIA, RAINFALL",
         "ENTEROCOCCI, FECAL-TO-TOTAL COLIFORM RATIO",
         "COMBINED SEWER OVERFLOW, SANITARY SEWER OVERFLOW, NA", 2, 5, 1, 0, 1),
        ("B2", "Bravo", "WI", "Iron", "RAINFALL", "PREEMPTORY ACTION", "STORM", 1, 1, 0, 1, 0),
        ("B3", "Charlie", "WA", None, "SEWAGE, NA", "FECAL COLIFORM, TOTAL COLIFORM",
         "PUBLICLY-OWNED TREATMENT WORKS, SEWER LINE, UNKNOWN", 2, None, 2, 0, 0),
        ("B4", "Delta", "CA", "Marin", "RAINFALL", "PREEMPTORY ACTION", "RUNOFF", 2, 10, None, None, None),
        ("B4", "Delta Cove", "CA", "Marin", "ELEVATED BACTERIA", "ENTEROCOCCI", "RUNOFF", 2, 10, None, None, None),
    ], key=repr)


def test_per_beach_independent_of_partitioning(reports):
    shuffled = reports.clean.repartition(5, "year")
    a = rows(B.per_beach(shuffled), "beach_id", "beach_name", "reasons", "indicators", "sources")
    b = rows(reports.beaches, "beach_id", "beach_name", "reasons", "indicators", "sources")
    assert a == b


def test_state_sums_with_total(reports):
    got = {r["state"]: tuple(r)[1:] for r in reports.state_sums.collect()}
    assert reports.state_sums.columns == [
        "state", "no_of_beach_actions", "no_of_days_under_action", "closure",
        "contamination_advisory", "rain_advisory", "number_of_beaches_with_actions",
        "actionsperbeach", "daysperbeach"]
    assert got == {"CA": (4, 20, 0, 0, 0, 2, 2.0, 10.0), "WA": (2, 0, 2, 0, 0, 1, 2.0, 0.0),
                   "WI": (3, 6, 1, 1, 1, 2, 1.5, 3.0), "Total": (9, 26, 3, 1, 1, 5, 5.5, 13.0)}


def test_ranked_by_contamination(reports):
    ranked = [r["state"] for r in B.states_by_contamination(reports.state_sums).collect()]
    assert ranked[0] == "Total" and ranked[1] == "WA"


def test_reason_shares(reports):
    got = {r["action_reasons"]: (r["n"], round(r["Pct"], 6)) for r in B.reason_shares(reports.clean).collect()}
    assert got == {"ELEV_BACT": (2, 28.571429), "RAINFALL": (2, 28.571429),
                   "ELEV_BACT, RAINFALL": (1, 14.285714), "SEWAGE": (1, 14.285714), None: (1, 14.285714)}
    tok = {r["token"]: r["n"] for r in B.reason_token_shares(reports.clean).collect()}
    assert tok == {"ELEV_BACT": 3, "RAINFALL": 3}


def test_positive_filters_and_type_counts(reports):
    assert sorted(r["beach_id"] for r in B.beaches_with(reports.beaches, "closure").collect()) == ["B1", "B3"]
    assert {r["action_type"]: r["n"] for r in B.action_type_counts(reports.clean).collect()} == {
        "Closure": 3, "Contamination Advisory": 1, "Rain Advisory": 2, None: 1}
    assert rows(reports.type_by_year, "action_type", "year", "n") == sorted(
        [("Closure", 2017, 1), ("Closure", 2018, 2), ("Contamination Advisory", 2018, 1)], key=repr)


def test_snapshot_dedupes_before_year_filter(reports):
    assert sorted(r["beach_id"] for r in reports.snapshot.collect()) == ["B1", "B3", "B4", "B7", "B8", "B9"]
    assert {r["state"]: r["n"] for r in B.snapshot_check_count(reports.snapshot).collect()} == {"CA": 2, "WI": 1}


def test_all_beaches_status(reports):
    got = rows(reports.all_beaches, "beach_id", "beach_name", "state", "county", "status", "no_of_beach_actions")
    assert got == sorted([
        ("B1", "Alpha", "WI", "Door", "Active", 2), ("B2", "Bravo", "WI", "Iron", "NA", 1),
        ("B3", "Charlie", "WA", None, "Historical", 2), ("B4", "Delta", "CA", "Marin", "Dormant", 2),
        ("B4", "Delta Cove", "CA", "Marin", "NA", 2),
        ("B7", "Golf", "CA", "Marin", "Active: No advisory or closure", None)], key=repr)
    counts = B.status_counts(reports.all_beaches)
    assert {r["status"]: r["n"] for r in counts["by_status"].collect()}["NA"] == 2
    assert [r["beach_name"] for r in counts["dormant_with_actions"].collect()] == ["Delta"]


def test_publication_names_and_labels(reports):
    pub = reports.publication
    assert pub.columns[:4] == ["EPA beach ID", "Beach name", "State", "County"]
    assert {r["State"] for r in pub.collect()} == {"Wisconsin", "Washington", "California"}


def test_state_summaries(reports):
    got = {(r["year"], r["state"]): r for r in reports.state_summaries.collect()}
    assert set(got) == {(2017, "WI"), (2018, "CA"), (2018, "NY"), (2018, "WA"), (2018, "WI")}
    assert math.isnan(got[(2018, "CA")]["percent_monitored"])
    assert got[(2018, "WA")]["percent_monitored"] == math.inf
    assert got[(2018, "NY")]["monitored_beaches"] is None and got[(2018, "NY")]["percent_monitored"] is None
    wi = got[(2018, "WI")]
    assert (wi["total_beaches"], wi["monitored_beaches"], wi["total_days_not_under_action"]) == (12, 5, 590)
    assert abs(wi["percent_monitored"] - 41.666666666) < 1e-6
    assert got[(2017, "WI")]["percent_monitored"] == 50.0


def test_one_pass_summary_equals_per_year(reports, spark):
    s = frame(spark, SUMMARY, SUMMARY_SCHEMA)
    both = rows(B.state_summaries(s), "year", "state", "total_beaches", "monitored_beaches")
    each = sorted(rows(B.state_summaries(s, [2017]), "year", "state", "total_beaches", "monitored_beaches")
                  + rows(B.state_summaries(s, [2018]), "year", "state", "total_beaches", "monitored_beaches"),
                  key=repr)
    assert both == each


def test_one_pass_site_table_equals_join(reports):
    from shoreline.operators.aggregate import ordered_distinct_concat
    from shoreline.operators.joins import null_safe_join

    joined = null_safe_join(
        ordered_distinct_concat(reports.clean, B.SITE_KEYS, B.LIST_COLUMNS, "_ord",
                                normalize=B.NORMALIZERS),
        B.beach_numbers(reports.clean), ["beach_id"], "left")
    cols = reports.beaches.columns
    assert joined.columns == cols
    assert rows(joined, *cols) == rows(reports.beaches, *cols)


def test_fused_sums_and_count_equal_join(reports):
    from pyspark.sql import functions as F

    from shoreline.operators.aggregate import sums_and_count

    beaches = reports.beaches
    fused = sums_and_count(beaches, ["state"], B.STATE_SUM_COLS, "n")
    sums = beaches.groupBy("state").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in B.STATE_SUM_COLS])
    counts = beaches.groupBy("state").count().withColumnRenamed("count", "n")
    joined = sums.join(counts, "state", "left")
    cols = ["state", *B.STATE_SUM_COLS, "n"]
    assert rows(fused, *cols) == rows(joined, *cols)


def test_register_views_for_sql(reports, spark):
    names = B.register_views(reports, prefix="fx_")
    assert "fx_state_sums" in names and "fx_all_beaches" in names
    got = spark.sql("SELECT number_of_beaches_with_actions AS n FROM fx_state_sums WHERE state = 'Total'")
    assert got.first()["n"] == 5


def test_story_results(reports):
    st = B.story(reports)
    assert sorted(r["beach_id"] for r in st["beaches_with_rain"].collect()) == ["B2"]
    assert {r["state"]: r["n"] for r in st["profile_check_count"].collect()} == {"CA": 2, "WI": 1}
    assert [r["beach_name"] for r in st["dormant_with_actions"].collect()] == ["Delta"]
    assert {r["token"] for r in st["reason_token_shares"].collect()} == {"ELEV_BACT", "RAINFALL"}
    assert st["states_by_contamination"].first()["state"] == "Total"
