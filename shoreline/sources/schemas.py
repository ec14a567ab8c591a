"""Column types of the three reports and the published record."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I = T.StringType(), T.LongType(), T.IntegerType()

# Columns used by the pipelines; any other report column passes through as text.
ACTIONS_TYPES = {
    "beach_id": S, "beach_name": S, "state": S, "county": S, "action_type": S,
    "action_reasons": S, "action_indicator": S, "action_possible_source": S,
    "action_duration_days": L, "year": I,
}

PROFILE_TYPES = {
    "beach_id": S, "beach_name": S, "state_code": S, "county": S, "beach_status": S,
    "year": I,
}

STATE_SUMMARY_VALUES = [
    "no_of_beach_act_beaches", "no_of_monitored_beaches",
    "no_of_monitored_beacheswith_actions", "no_of_monitored_beacheswithout_actions",
    "total_no_of_beach_actions", "no_of_days_undera_beach_action_monitored_beaches",
    "no_of_days_not_undera_beach_action_monitored_beaches",
]
STATE_SUMMARY_TYPES = {"state": S, "year": I, **{c: L for c in STATE_SUMMARY_VALUES}}

# Short keys of a published record (field -> meaning on the lookup page).
RECORD_FIELDS = ["bn", "bi", "s", "c", "na", "nd", "cl", "ra", "ca", "r", "i", "so", "st"]
RECORD_SCHEMA = T.StructType([T.StructField(f, S, True) for f in RECORD_FIELDS])


def struct_of(types: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in types.items()])
