"""Sources: report readers, header normalisation, row ordinals, dimensions."""

from shoreline.sources.dims import STATE_NAMES, state_dimension
from shoreline.sources.readers import (
    ORDINAL,
    clean_names,
    csv_ordinal,
    read_records,
    read_report,
    read_table,
    snake_name,
)
from shoreline.sources.schemas import (
    ACTIONS_TYPES,
    PROFILE_TYPES,
    RECORD_FIELDS,
    RECORD_SCHEMA,
    STATE_SUMMARY_TYPES,
    STATE_SUMMARY_VALUES,
)

__all__ = [
    "ACTIONS_TYPES", "ORDINAL", "PROFILE_TYPES", "RECORD_FIELDS", "RECORD_SCHEMA", "STATE_NAMES",
    "STATE_SUMMARY_TYPES", "STATE_SUMMARY_VALUES", "clean_names", "csv_ordinal",
    "read_records", "read_report", "read_table", "snake_name",
    "state_dimension",
]
