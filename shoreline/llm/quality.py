"""Quality rules with adaptive thresholds.

Every text gets exact counts.  For each language and source, quantile sketches of a few
ratios give the thresholds in place of fixed cutoffs: a ratio is out of bounds if it lies
beyond the quartiles by more than ``reach`` times their distance.  Where over half of a
group has one value, wider ranges of the sketch or the spread within the groups of the
language or the corpus stand in for that distance (``spreads``).  The sketch is a
histogram of logarithmic buckets with a relative error of ``accuracy`` (DDSketch, 2019):
sketches merge by adding counts, so those of a language and of the whole corpus, which
stand in for groups of fewer than ``min_rows`` rows, are sums of the others.  The
thresholds are then joined to the rows.

Defined cases: a NULL text has no words, so all counts are 0 and the base rule fails; NULL
languages and sources are groups of their own; rows without words don't enter the
sketches; ties (values equal to a threshold) are kept; repeated rows are judged alike; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoreline.llm.common import ship, stored

#: words of a repeated window
WINDOW = 8
#: ratio, the distance to the quartiles that is never out of bounds, and whether a low value is out of bounds too
RULES = {"symbols": (0.10, False), "duplicate_lines": (0.10, False), "word_length": (1.0, True)}
#: shares of rows beyond either end of the ranges that tell the spread
RANGES = (0.25, 0.10, 0.05, 0.025, 0.01)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows of ``window`` words found at least twice."""
    if len(words) <= window:
        return 0
    ids: dict[bytes, int] = {}
    name = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) > len(words) - window:  # two equal windows repeat at least that many words
        return 0
    # names of 2, 4, ... words: equal names, equal words
    size = 1
    while size < window:
        step = min(size, window - size)
        pair = name[:len(name) - step] * (int(name.max()) + 1) + name[step:]
        kinds, name = np.unique(pair, return_inverse=True)
        if len(kinds) == len(pair):
            return 0
        size += step
    twice = np.bincount(name)[name] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of ``_COUNTS`` for one text."""
    if not text:
        return (0,) * len(_COUNTS)
    raw = text.encode()
    words = raw.split()
    if not words:
        return (0,) * len(_COUNTS)
    blanks = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines))


def text_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, source)`` and the counts of every row."""
    ship(docs.sparkSession)
    kept = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"))
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.LongType()) for c in _COUNTS]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([counts(t.as_py()) for t in b.column(3)], np.int64).reshape(-1, len(_COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(found[:, k]) for k in range(len(_COUNTS))]], schema.names)

    return docs.select(*[F.col(c) if c == "doc_id" else F.col(c).cast("string") for c in ("doc_id", "lang", "source", "text")]
                       ).mapInArrow(each, schema)


def ratios() -> dict[str, Column]:
    return {"symbols": F.col("n_symbols") / F.col("n_words"),
            "duplicate_lines": F.col("n_dup_lines") / F.col("n_lines"),
            "word_length": F.col("word_chars") / F.col("n_words")}


def sketch(rows: DataFrame, keys: list[str], accuracy: float = 0.01) -> DataFrame:
    """Mergeable sketches ``(*keys, rule, bucket, n)`` of the ratios of rows with words."""
    gamma = math.log((1 + accuracy) / (1 - accuracy))
    values = rows.filter("n_words > 0").select(*keys, F.explode(F.array(*[
        F.struct(F.lit(k).alias("rule"), v.alias("v")) for k, v in ratios().items()])).alias("x")).select(*keys, "x.*")
    bucket = F.when(F.col("v") > 0, F.ceil(F.log("v") / gamma).cast("int"))  # NULL: zero
    return values.groupBy(*keys, "rule", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def _quantiles(values: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """``(*keys, rule, rows, *wanted)`` of values ``v`` that stand for ``n`` rows each."""
    group = Window.partitionBy(*keys, "rule")
    below = group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumns({"upto": F.sum("n").over(below), "rows": F.sum("n").over(group)})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("v")))
    return ranked.groupBy(*keys, "rule").agg(F.first("rows").alias("rows"), *[at(q).alias(name) for name, q in wanted.items()])


def _value(bucket: Column, accuracy: float) -> Column:
    gamma = math.log((1 + accuracy) / (1 - accuracy))
    return F.coalesce(F.exp(bucket * gamma) * (1 - accuracy), F.lit(0.0))


def quartiles(sketches: DataFrame, keys: list[str], accuracy: float = 0.01) -> DataFrame:
    """``(*keys, rule, rows, q1, q2, q3)``: values within ``accuracy`` of the exact quartiles."""
    return _quantiles(sketches.withColumn("v", _value(F.col("bucket"), accuracy)), keys, {"q1": 0.25, "q2": 0.5, "q3": 0.75})


def _with_parents(own: DataFrame, lang: DataFrame, all_: DataFrame) -> DataFrame:
    """Rows ``(lang, source, rule)`` with the columns of their own group, the language and the
    corpus, prefixed ``own_``, ``lang_`` and ``all_``."""
    named = lambda df, name: df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])
    a, b, c = named(own, "own"), named(lang, "lang"), named(all_, "all")
    return (a.join(b, F.col("own_lang").eqNullSafe(F.col("lang_lang")) & (F.col("own_rule") == F.col("lang_rule")))
            .join(F.broadcast(c), F.col("own_rule") == F.col("all_rule"))  # a row a rule
            .withColumnsRenamed({"own_lang": "lang", "own_source": "source", "own_rule": "rule"}).drop("lang_lang", "lang_rule", "all_rule"))


def spreads(own: DataFrame, quarters: DataFrame, min_rows: int, accuracy: float = 0.01) -> DataFrame:
    """``(lang, source, rule, spread)``: the quartile distance, or what stands in for it.

    Distances are those of the values to the median of their group, so that groups of
    different levels don't widen each other.  The narrowest of the ``RANGES`` that is not 0
    counts, of the group itself, else of its language, else of the corpus; it is scaled to
    the quartile distance of a normal distribution.  A range needs as many rows beyond it as
    ``min_rows`` rows have beyond a quartile.
    """
    gamma = math.log((1 + accuracy) / (1 - accuracy))
    centre = quarters.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("rule").alias("_rule"), F.col("q2").alias("_q2"))
    far = (own.join(centre, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("rule") == F.col("_rule")))
           .withColumn("d", _value(F.col("bucket"), accuracy) - F.col("_q2")))
    # buckets again, so that a coarser group has few however many groups it holds
    sized = F.when(F.abs("d") > 1e-9, F.signum("d") * F.exp(F.ceil(F.log(F.abs("d")) / gamma) * gamma) * (1 - accuracy)).otherwise(F.lit(0.0))
    far = stored(far.groupBy("lang", "source", "rule", sized.alias("v")).agg(F.sum("n").alias("n")), "distances")
    wanted = {f"{end}{i}": q for i, t in enumerate(RANGES) for end, q in (("lo", t), ("hi", 1 - t))}
    level = lambda keys: _quantiles(far.groupBy(*keys, "rule", "v").agg(F.sum("n").alias("n")), keys, wanted)
    joined = _with_parents(level(["lang", "source"]), level(["lang"]), level([]))
    normal = NormalDist()
    found = []
    for i, t in enumerate(RANGES):
        for name in ("own", "lang", "all"):
            wide = (F.col(f"{name}_hi{i}") - F.col(f"{name}_lo{i}")) * (normal.inv_cdf(0.75) / normal.inv_cdf(1 - t))
            found.append(F.when((F.col(f"{name}_rows") * t >= min_rows / 4) & (wide > 0), wide))
    return joined.select("lang", "source", "rule", F.coalesce(*found, F.lit(0.0)).alias("spread"))


def thresholds(rows: DataFrame, min_rows: int = 100, reach: float = 6.0, accuracy: float = 0.01) -> DataFrame:
    """``(lang, source)`` with ``<rule>_low`` and ``<rule>_high`` for every group of ``rows``."""
    own = stored(sketch(rows, ["lang", "source"], accuracy), "sketches")
    joined = _with_parents(quartiles(own, ["lang", "source"], accuracy), quartiles(merge(own, ["lang"]), ["lang"], accuracy),
                           quartiles(merge(own, []), [], accuracy))
    pick = lambda q: (F.when(F.col("own_rows") >= min_rows, F.col(f"own_{q}"))
                      .when(F.col("lang_rows") >= min_rows, F.col(f"lang_{q}")).otherwise(F.col(f"all_{q}")))
    quarters = stored(joined.select("lang", "source", "rule", *[pick(q).alias(q) for q in ("q1", "q2", "q3")]), "quartiles")
    wide = spreads(own, quarters, min_rows, accuracy).select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("rule").alias("_rule"), "spread")
    least = F.element_at(F.create_map(*[F.lit(x) for k, (w, _) in RULES.items() for x in (k, w)]), F.col("rule"))
    away = F.greatest(F.col("spread") * reach, least)
    slack = (1 + accuracy) / (1 - accuracy)  # a quartile of the sketch may be that far from its own values
    flat = (quarters.join(wide, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("rule") == F.col("_rule")))
            .select("lang", "source", "rule", (F.col("q1") / slack - away).alias("low"), (F.col("q3") * slack + away).alias("high")))
    ends = [F.max(F.when(F.col("rule") == k, F.col(end))).alias(f"{k}_{end}") for k in RULES for end in ("low", "high")]
    return flat.groupBy("lang", "source").agg(*ends)


def base_failed() -> Column:
    """Fewer than 20 words, or over 30% of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, min_rows: int = 100, reach: float = 6.0, accuracy: float = 0.01) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept)`` for every row of ``docs (doc_id, text, lang, source)``."""
    rows = stored(text_counts(docs), "counts")
    bounds = thresholds(rows, min_rows, reach, accuracy)
    bounds = bounds.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[c for c in bounds.columns if c not in ("lang", "source")])
    joined = rows.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    out = F.lit(False)
    for k, v in ratios().items():
        value = F.when(F.col("n_words") > 0, v)
        out = out | F.coalesce(value > F.col(f"{k}_high"), F.lit(False))
        if RULES[k][1]:
            out = out | F.coalesce(value < F.col(f"{k}_low"), F.lit(False))
    return joined.select("doc_id", *_COUNTS[:5], base_failed().alias("base_failed"), (~base_failed() & ~out).alias("kept"))
