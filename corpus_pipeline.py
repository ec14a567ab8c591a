"""A corpus pipeline of the operators in ``shoreline.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoreline.llm import langid, linededup, mixing, packing, simhash
from shoreline.llm.common import stored, table
from shoreline.llm.queries import tokenizer_path

#: documents of a predicted language with at least this posterior probability stay
MIN_LANGUAGE_SCORE = 0.5
#: characters of the shortest run of lines that counts as repeated
MIN_REPEATED_CHARS = 60
#: words that a worker keeps with their ids, about 25 MB of them, as it serves the other stages too
MAX_WORDS = 100_000
#: ids of a training sequence
CAPACITY = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter, without a clear language, or coded much longer than texts of their language
    are (hex dumps, unknown scripts); fill missing labels.

    A missing or empty text has no letter and goes; a tie between languages goes to the first by code point and has
    a score of at most a half; rows are judged one by one, so repeated ones alike; if nothing can be
    learned (no labels) every row goes; an empty table gives none."""
    return langid.keep_identified(docs, MIN_LANGUAGE_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated runs of lines, and documents that lose all their words.

    A missing text stays missing; an empty one stays; documents are in the order of ``doc_id`` (missing last), then of a hash
    of their text; rows that repeat both are one document and lose the same lines; an empty table gives none."""
    return linededup.drop_repeated_lines(docs, MIN_REPEATED_CHARS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates.

    Missing and empty texts share the fingerprint 0, so one of them stays; of a class the smallest ``doc_id`` stays (missing
    last), then the smallest hash of the text, then the first row by its columns; an empty table gives none."""
    return simhash.keep_one(docs, shingle=4, radius=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the target weights of the sources ask, at most twice.

    A document without words is never taken; a missing source is one of its own; rows that agree in ``doc_id``, source and
    size get one number of copies; an empty table gives none."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in training sequences.

    A missing text is an empty one, of which only the end id is packed; every copy of a row is packed; an empty table
    gives none."""
    return packing.pack_documents(docs, tokenizer_path(), CAPACITY, end_id=0, max_words=MAX_WORDS)


#: each takes (spark, docs, sf_dir); all but the last return the columns of documents
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no PPM, suffix array, SimHash, Newton iterations or tokenizer: tests/llm/test_pipeline.py holds
#: every stage against a brute-force version of it instead
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
