"""Readers for delimited reports and published JSON records.

Headers and rows are read by the executors.  Reports are read with all fields as text, headers normalised to
snake case, and the known columns cast by name with ``try_cast`` (a field
that does not parse becomes NULL, as the reference's reader does), so
column order and extra columns in a file do not matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoreline.operators._util import qcol
from shoreline.operators.joins import MAX_BROADCAST_BYTES
from shoreline.sources.arrays import LARGE_FILE_BYTES, RECORD_END, array_lines
from shoreline.sources.headers import header_groups, header_names, plain_path
from shoreline.sources.records import record_fields, report_records
from shoreline.sources.tables import TABLE_SCHEMAS

ORDINAL = "_ord"

# Latin letters that don't decompose into an ASCII letter and a mark, and how they are written in ASCII.
LATIN_LETTERS = {
    "\u00df": "ss", "\u1e9e": "SS", "\u00e6": "ae", "\u00c6": "Ae", "\u0153": "oe", "\u0152": "Oe", "\u00f8": "o", "\u00d8": "O",
    "\u0111": "d", "\u0110": "D", "\u00f0": "d", "\u00d0": "D", "\u00fe": "th", "\u00de": "Th", "\u0142": "l", "\u0141": "L",
    "\u0127": "h", "\u0126": "H", "\u0131": "i", "\u0138": "q", "\u014b": "n", "\u014a": "N", "\u0167": "t", "\u0166": "T",
    "\u0180": "b", "\u0243": "B", "\u023c": "c", "\u023b": "C", "\u01e5": "g", "\u01e4": "G", "\u0268": "i", "\u0197": "I",
    "\u0249": "j", "\u0248": "J", "\u024d": "r", "\u024c": "R", "\u01b6": "z", "\u01b5": "Z", "\u024f": "y", "\u024e": "Y",
}


def snake_name(name: str) -> str:
    """Header -> snake case: ``No. of Beach Actions`` -> ``no_of_beach_actions``."""
    s = name.replace("%", "_percent_").replace("#", "_number_")
    s = s.translate(str.maketrans(LATIN_LETTERS))
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def snake_names(names: Sequence[str]) -> list[str]:
    """Snake-case names; repeated ones get ``_2``, ``_3``."""
    seen: dict[str, int] = {}
    out = []
    for c in names:
        s = snake_name(c)
        seen[s] = seen.get(s, 0) + 1
        out.append(s if seen[s] == 1 else f"{s}_{seen[s]}")
    return out


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to snake case; repeated names get ``_2``, ``_3``."""
    return df.toDF(*snake_names(df.columns))


# A position in the input: the file's place among the sorted files above
# ``_FILE_SHIFT`` bits, below them where the row stands in its file.
_FILE_SHIFT = 44


def csv_ordinal(df: DataFrame, files: Sequence[str], name: str) -> DataFrame:
    """Add the position of each CSV row as one long, growing by file, then row.

    Within a file it is the byte at which the input split starts plus the
    row's number in its task: every row takes a byte at least, and only the
    last, short split of a file shares a task with other files, so positions
    never cross.  ``monotonically_increasing_id`` is recomputed identically
    when a task is re-run, since file splits are deterministic.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    at = F.col("_metadata.file_block_start") + row
    if len(files) < 2:
        return df.withColumn(name, at)
    ranks = df.sparkSession.createDataFrame([(plain_path(f), i) for i, f in enumerate(sorted(files))], "__file string, __rank long")
    if sum(map(len, files)) * 4 <= MAX_BROADCAST_BYTES:  # a row a file
        ranks = F.broadcast(ranks)
    placed = df.select("*", at.alias(name), plain_path(F.col("_metadata.file_path")).alias("__path"))
    return (placed.join(ranks, F.col("__path") == F.col("__file"))
            .withColumn(name, F.shiftleft("__rank", _FILE_SHIFT) + qcol(name)).drop("__rank", "__file", "__path"))


def parse_as(c: Column, dtype: T.DataType) -> Column:
    """Text -> ``dtype``; a field that does not parse becomes NULL.

    Integral types also accept whole numbers written as decimals or with an
    exponent (``2018.0``, ``1e3``), which number-guessing readers load as
    the same value; a fractional value does not fit and becomes NULL.
    """
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        d = c.try_cast("decimal(38,10)")
        return F.coalesce(c.try_cast(dtype), F.when(d == F.floor(d), d).try_cast(dtype))
    return c.try_cast(dtype)


#: how the fields of a record are read
_FIELD_OPTIONS = {"escape": '"', "nullValue": "NA", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
                  "mode": "PERMISSIVE"}


def csv_options(reader, multiline: bool):
    """The options of every report reader, batch or streaming."""
    return reader.options(**_FIELD_OPTIONS).option("header", True).option("multiLine", multiline).option("inferSchema", False)


def typed(df: DataFrame, types: Mapping[str, T.DataType]) -> list[Column]:
    """The columns of a report read as text: empty and blank fields (quoted or not)
    are NULL, known columns get their type."""
    out = []
    for f in df.schema.fields:
        c = qcol(f.name)
        c = F.when(F.trim(c) != "", c) if isinstance(f.dataType, T.StringType) else c
        out.append((parse_as(c, types[f.name]) if f.name in types else c).alias(f.name))
    return out


_CORRUPT = "__corrupt"


def _read_alike(spark: SparkSession, path, header: str, files: Sequence[str] | None) -> DataFrame:
    """The ``files`` in ``path`` (None: all) that begin with ``header``, as text columns with cleaned names.

    A record whose line holds an unclosed quote fails the read: it goes on in the next line.
    """
    names = header_names(header)
    fields = [T.StructField(n, T.StringType()) for n in [*names, _CORRUPT]]
    raw = csv_options(spark.read, False).option("columnNameOfCorruptRecord", _CORRUPT).schema(T.StructType(fields)).csv(path)
    if files is not None:
        raw = raw.filter(F.col("_metadata.file_path").isin(list(files)))  # prunes the files
    quotes = F.length(_CORRUPT) - F.length(F.replace(F.col(_CORRUPT), F.lit('"'), F.lit("")))
    message = F.concat(F.lit("a quoted field holds a line break; read with multiline=True: "), F.col(_CORRUPT))
    first = raw.columns[0]
    checked = F.when(F.coalesce(quotes % 2 == 1, F.lit(False)), F.raise_error(message)).otherwise(qcol(first))
    return clean_names(raw.withColumn(first, checked).drop(_CORRUPT))


def _folder_columns(spark: SparkSession, path, files: Sequence[str]) -> DataFrame | None:
    """``(__rank, ...)``: the columns that folders named ``column=value`` give each file, or None."""
    fields = [f for f in spark.read.text(path).schema.fields if f.name != "value"]
    if not fields:
        return None
    found = [(i, *[unquote(m[1]) if (m := re.search(f"/{re.escape(f.name)}=([^/]*)/", name)) else None for f in fields])
             for i, name in enumerate(sorted(files))]
    texts = spark.createDataFrame(found, ", ".join(["__rank long", *[f"`{f.name}` string" for f in fields]]))
    missing = F.lit("__HIVE_DEFAULT_PARTITION__")
    return texts.select("__rank", *[F.nullif(qcol(f.name), missing).try_cast(f.dataType).alias(f.name) for f in fields])


def _read_multiline(spark: SparkSession, path, files: Sequence[str], ordinal: str | None, types: Mapping[str, T.DataType]) -> DataFrame:
    """All files in one plan, whatever their headers, as many tasks a file as it has splits."""
    groups = header_groups(spark, path) or {"": []}
    names = [snake_names(header_names(h)) for h in groups]
    rows = record_fields(report_records(spark, path, files, groups), names, {**_FIELD_OPTIONS, "multiLine": "true"})
    place = F.col("start") + F.col("line")
    at = place if len(files) < 2 else F.shiftleft("rank", _FILE_SHIFT) + place
    columns = list(dict.fromkeys(n for header in names for n in header))
    text = rows.select(*[qcol(c) for c in columns])
    out = rows.select(*typed(text, types), *([at.alias(ordinal)] if ordinal else []), F.col("rank").alias("__rank"))
    folders = _folder_columns(spark, path, files)
    if folders is not None:
        of = {c: parse_as(qcol(c).cast("string"), types[c]) if c in types else qcol(c) for c in folders.columns[1:]}
        out = out.join(folders.select("__rank", *[v.alias(c) for c, v in of.items()]), "__rank")
    return out.drop("__rank")


def read_report(spark: SparkSession, path: str | Sequence[str], types: Mapping[str, T.DataType],
                multiline: bool = False, ordinal: str | None = ORDINAL) -> DataFrame:
    """Read a delimited report of one or many files with header lines.

    ``types`` maps snake-case column -> Spark type; other columns stay
    strings.  Empty fields (quoted too) and ``NA`` load as NULL, white space
    around fields is trimmed, doubled quotes are kept.  Files may order their
    columns differently or have further ones: each file
    is read by its own names, a column that a file lacks is NULL.
    Large files are split; a quoted field that holds a line break then fails
    the read, and needs ``multiline=True``, which reads the files twice, in as many tasks
    (see ``sources.records``).
    ``ordinal`` adds the file position used by order-dependent operators.
    """
    files = spark.read.text(path).inputFiles()
    if multiline:
        df = _read_multiline(spark, path, files, ordinal, types)
    else:
        groups = header_groups(spark, path) or {"": []}
        parts = []
        for header, group in groups.items():
            part = _read_alike(spark, path, header, group if len(groups) > 1 else None)
            if ordinal:
                part = csv_ordinal(part, files, ordinal)
            parts.append(part.select(*typed(part, types)))
        df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    missing = [c for c in types if c not in df.columns]
    if missing:
        raise ValueError(f"report lacks columns {missing}; has {df.columns}")
    return df


def read_records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                 multiline: bool = True, large: int = LARGE_FILE_BYTES) -> DataFrame:
    """Read published records: JSON array documents (``multiline``) or JSON lines.

    Arrays in files of over ``large`` bytes are read in many tasks a file, their objects stored as records of
    their own first (see ``sources.arrays``); other documents by one task each."""
    whole = spark.read.schema(schema).option("multiLine", multiline).json(path)
    if not multiline or whole.columns != schema.names:  # folders give further columns
        return whole
    folder = array_lines(spark, path, large)
    if folder is None:
        return whole
    records = spark.read.schema(schema).option("lineSep", RECORD_END).json(folder)
    return whole.filter(F.col("_metadata.file_size") <= large).unionByName(records)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``, with its declared schema
    when it has one (no inference job), else the schema in the files."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = TABLE_SCHEMAS.get(name)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
