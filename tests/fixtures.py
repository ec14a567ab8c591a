"""Fixture rows of FIXTURES.md (``None`` is NULL, ``_ord`` the file position)."""

from pyspark.sql import types as T

S, L, I = T.StringType(), T.LongType(), T.IntegerType()

ACTIONS_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in [
    ("beach_id", S), ("beach_name", S), ("state", S), ("county", S), ("action_type", S),
    ("action_reasons", S), ("action_indicator", S), ("action_possible_source", S),
    ("action_duration_days", L), ("year", I), ("_ord", L)]])

ACTIONS = [
    ("B1", "Alpha", "WI", "Door", "Closure", "ELEV_BACT, RAINFALL", "ENTERO", "CSO,SSO", 2, 2017),
    ("B1", "Alpha", "WI", "Door", "Contamination Advisory", "ELEV_BACT", "ENTERO,RATIO", None, 3, 2018),
    ("B2", "Bravo", "BR", "Iron", "Rain Advisory", "RAINFALL", "PREEMPT", "STORM", 1, 2018),
    ("B3", "Charlie", "MK", None, "Closure", "SEWAGE", "FECAL_COL", "POTW,SEWER_LINE", 5, 2018),
    ("B3", "Charlie", "MK", None, "Closure", None, "TOTAL_COL", "UNKNOWN", None, 2018),
    ("B4", "Delta", "CA", "Marin", "Rain Advisory", "RAINFALL", "PREEMPT", "RUNOFF", 4, 2017),
    ("B4", "Delta Cove", "CA", "Marin", None, "ELEV_BACT", "ENTERO", "RUNOFF", 6, 2018),
    ("B5", "Echo", "GU", "Guam", "Closure", "ELEV_BACT", "ENTERO", "CSO", 9, 2018),
    ("B6", "Foxtrot", None, "Lost", "Closure", "ELEV_BACT", "ENTERO", "CSO", 9, 2018),
]

PROFILE_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in [
    ("beach_id", S), ("beach_name", S), ("state_code", S), ("county", S), ("beach_status", S),
    ("year", I), ("_ord", L)]])

PROFILE = [
    ("B1", "Alpha", "WI", "Door", "Active", 2017),
    ("B1", "Alpha", "WI", "Door", "No advisory or closure", 2018),
    ("B2", "Bravo", "BR", "Iron", "Active", 2017),
    ("B2", "Bravo", "BR", "Iron", "Active", 2018),
    ("B3", "Charlie", "MK", None, "Historical", 2018),
    ("B4", "Delta", "CA", "Marin", "Dormant", 2018),
    ("B7", "Golf", "CA", "Marin", "No advisory or closure", 2018),
    ("B8", "Hotel", "CA", "Kern", "Historical", 2018),
    ("B9", "India", "CA", "Kern", None, 2018),
    ("B10", "Juliet", "VI", "X", "Active", 2018),
    ("B4", "Delta", "CA", "Marin", "Dormant", 2017),
]

SUMMARY_COLS = ["no_of_beach_act_beaches", "no_of_monitored_beaches",
                "no_of_monitored_beacheswith_actions", "no_of_monitored_beacheswithout_actions",
                "total_no_of_beach_actions", "no_of_days_undera_beach_action_monitored_beaches",
                "no_of_days_not_undera_beach_action_monitored_beaches"]
SUMMARY_SCHEMA = T.StructType([T.StructField("state", S), T.StructField("year", I)]
                              + [T.StructField(c, L) for c in SUMMARY_COLS]
                              + [T.StructField("_ord", L)])
SUMMARY = [
    ("WI", 2018, 10, 4, 3, 1, 7, 12, 500),
    ("BR", 2018, 2, 1, 1, 0, 1, 2, 90),
    ("CA", 2018, 0, 0, 0, 0, 0, 0, 0),
    ("MK", 2018, 0, 1, 0, 1, 0, 0, 30),
    ("NY", 2018, 5, None, 2, 1, 4, 6, 80),
    ("GU", 2018, 9, 9, 9, 9, 9, 9, 9),
    ("WI", 2017, 8, 4, 2, 2, 3, 5, 300),
]


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r) + (i,) for i, r in enumerate(rows)], schema)
