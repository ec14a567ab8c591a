"""State / free-text lookup over published records (FIXTURES.md section 5)."""

import pytest

from shoreline.plans.lookup import display, find, short_records, state_list
from shoreline.sources.schemas import RECORD_FIELDS, RECORD_SCHEMA

RECORDS = [
    ("Virginia Key", "VA01", "Virginia", "York", "2", "5", "1", "0", "1",
     "ELEVATED BACTERIA, RAINFALL", "ENTEROCOCCI", "STORM", "Active"),
    ("Stone (North)", "WV01", "West Virginia", "NA", "NA", "NA", "NA", "NA", "NA", "NA", "NA", "NA",
     "Dormant"),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, RECORD_SCHEMA)


@pytest.mark.parametrize("state,term,expected", [
    ("all", "", []), ("", "", []), ("Virginia", "", ["VA01", "WV01"]),
    ("West Virginia", "", ["WV01"]), ("Virginia", "rainfall", ["VA01"]),
    ("Virginia", "RAINFALL", []), ("Virginia", "DORMANT", ["WV01"]),
    ("Virginia", "^na$", ["WV01"]), ("Virginia", "5", ["VA01"]),
    ("Virginia", "stone (north)", []),
])
def test_find(records, state, term, expected):
    assert sorted(r["bi"] for r in find(records, state, term).collect()) == expected


def test_invalid_pattern_raises(records):
    with pytest.raises(Exception):
        find(records, "Virginia", "(").collect()


def test_state_list_sorted(records):
    assert [r["s"] for r in state_list(records).collect()] == ["Virginia", "West Virginia"]


def test_display_upper_and_hidden(records):
    row = {r["bi"]: r for r in display(records).collect()}
    assert row["VA01"]["bn"] == "VIRGINIA KEY" and row["VA01"]["na"] == "2"
    assert row["WV01"]["na"] is None and row["WV01"]["c"] == "NA"


def test_short_records_from_publication(spark):
    from fixtures import ACTIONS, ACTIONS_SCHEMA, PROFILE, PROFILE_SCHEMA, SUMMARY, SUMMARY_SCHEMA, frame
    from shoreline.plans import beaches as B

    r = B.build_reports(frame(spark, ACTIONS, ACTIONS_SCHEMA), frame(spark, PROFILE, PROFILE_SCHEMA),
                        frame(spark, SUMMARY, SUMMARY_SCHEMA))
    rec = short_records(r.publication)
    assert rec.columns == RECORD_FIELDS
    got = {x["bi"]: x for x in rec.collect()}
    assert got["B7"]["na"] == "NA" and got["B7"]["st"] == "Active: No advisory or closure"
    assert got["B3"]["c"] == "NA" and got["B3"]["nd"] == "NA" and got["B3"]["s"] == "Washington"
    assert sorted(x["bi"] for x in find(rec, "Wisconsin", "").collect()) == ["B1", "B2"]
