"""Published short-key records and the state / free-text lookup over them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shoreline.operators import search_index
from shoreline.operators.project import display_fields, project_as, render_na
from shoreline.operators.search import distinct_sorted, lookup
from shoreline.operators.search_index import SearchIndex, build
from shoreline.plans.beaches import PUBLICATION_LABELS

# Short key of each published field.
RECORD_KEYS = {
    "Beach name": "bn",
    "EPA beach ID": "bi",
    "State": "s",
    "County": "c",
    "Total number of beach actions": "na",
    "Total number of days under action": "nd",
    "Total number of beach closures": "cl",
    "Total number of rain advisories": "ra",
    "Total number of contamination advisories": "ca",
    "Action reasons": "r",
    "Bacteria indicators": "i",
    "Possible pollution sources": "so",
    "2018 beach reporting status": "st",
}
SEARCH_FIELDS = ["bn", "bi", "s", "c", "r", "i", "so", "na", "nd", "cl", "ra", "ca", "st"]
# The reasons field is matched against the term as typed (not lower-cased).
RAW_TERM_FIELDS = ["r"]
UPPER_FIELDS = ["bn", "bi", "s", "c", "r", "i", "so", "st"]
HIDE_NA_FIELDS = ["na", "nd", "cl", "ra", "ca", "r", "i", "so", "st"]

assert set(RECORD_KEYS) == set(PUBLICATION_LABELS.values())


def short_records(publication: DataFrame) -> DataFrame:
    """Publication table -> records with short keys, missing as ``"NA"``."""
    return render_na(project_as(publication, RECORD_KEYS),
                     columns=list(RECORD_KEYS.values()))


def find(records: DataFrame, state: str, term: str) -> DataFrame:
    """Records of the selected state matching the search term."""
    return lookup(records, "s", state, term, SEARCH_FIELDS, RAW_TERM_FIELDS)


def store(records: DataFrame, folder: str, block_rows: int = 100_000) -> SearchIndex:
    """Short-key records stored once for many lookups (``find_stored``)."""
    return build(records, folder, "s", SEARCH_FIELDS, RAW_TERM_FIELDS, block_rows)


def find_stored(index: SearchIndex, state: str, term: str) -> DataFrame:
    """``find`` on stored records: reads the folders of matching states and the blocks that may match."""
    return search_index.find(index, state, term)


def state_list(records: DataFrame) -> DataFrame:
    """The sorted distinct states offered for selection."""
    return distinct_sorted(records, "s", utf16=True)


def display(records: DataFrame) -> DataFrame:
    """Text as shown: identity fields upper-cased, ``"NA"`` fields hidden (NULL)."""
    return display_fields(records, UPPER_FIELDS, HIDE_NA_FIELDS)
