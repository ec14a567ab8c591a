"""Mixing sources to target weights by entropy balancing.

Documents start at a rate of one copy.  Among all rates between 0 and ``max_copies`` under
which every source's words meet its target, entropy balancing takes those of least
relative entropy to the start: ``min(max_copies, exp(lambda * size / mean size))`` with one
dual variable ``lambda`` a source.  The dual is convex; distributed Newton steps solve it
over counts of equally long documents of a source, kept in the bracket that each step
narrows.  Rates become copies by systematic rounding along the sizes; the words that a source is then
off its target are made up for by a few copies more or less.

DataFrame operations only.  Defined cases: a NULL text has no words; a document without
words is never taken; NULL is a source of its own, last in order; a NULL ``doc_id`` is a
value like any other; equal rows are counted each, and in ``mix`` rows that agree in
``doc_id``, source and size share one number of copies (the largest of theirs); an empty
table, or one without words, gives targets of 0; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoreline.llm.common import fresh_name, gapless_index, ordered_index, qcol, stored, word_count

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5,
                   max_copies: int = 2) -> DataFrame:
    """``(source, sid, source_size, n, least, target)``: sources in code point order take the
    weights in turn and share ``total_share`` of all words; a target stops at ``max_copies``
    times its source, and the excess is shared again by weight."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"),
                                      F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    ranked = ordered_index(per, [F.col("source").asc_nulls_last()], "sid", "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = stored(ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_copies)), "sources")
    total = total_share * float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, capped = 0.0, -1
    while True:
        above = F.col("w") * F.lit(level) > F.col("cap")
        full, free, n = rows.agg(F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)),
                                 F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0)), F.count(F.when(above, 1))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - full) / free
    return rows.select("source", "sid", "source_size", "n", "least", F.least(F.col("w") * F.lit(level), F.col("cap")).alias("target"))


def solve(classes: DataFrame, targets: DataFrame, max_copies: int = 2, tolerance: float = 1e-7, steps: int = 60) -> DataFrame:
    """``(sid, lam)``: the dual variable of each source with words.

    ``classes (sid, size, n)`` counts the documents of a size.  A Newton step that leaves
    the bracket of the solution is replaced by the bracket's middle."""
    mean = F.col("source_size") / F.col("n")
    short = F.col("least") / mean
    ratio = F.col("target") / F.col("source_size")
    state = stored(targets.filter("source_size > 0 and target > 0").select(
        "sid", "target", mean.alias("mean"),
        F.when(ratio < 1, F.log(ratio) / short).otherwise(0.0).alias("lo"),
        F.when(ratio > 1, F.lit(math.log(max_copies)) / short).otherwise(0.0).alias("hi"),
        F.when(ratio >= max_copies, F.lit(math.log(max_copies)) / short).otherwise(F.log(ratio)).alias("lam"),
        F.lit(1.0).alias("error")), "dual")
    for _ in range(steps):
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        sums = classes.join(state, "sid").groupBy("sid").agg(
            F.sum(words * F.least(raw, F.lit(float(max_copies)))).alias("f"),
            F.sum(F.when(raw < max_copies, words * x * raw).otherwise(0.0)).alias("slope"))
        low = F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        high = F.when(F.col("f") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        error = F.abs(F.col("f") - F.col("target")) / F.col("target")
        newton = F.col("lam") - (F.col("f") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        state = stored(state.drop("error").join(sums, "sid").select(
            "sid", "target", "mean", low.alias("lo"), high.alias("hi"),
            F.when(error <= tolerance, F.col("lam")).when((newton > low) & (newton < high), newton)
            .otherwise((low + high) / 2).alias("lam"), error.alias("error")), "dual")
        if (state.agg(F.max("error")).first()[0] or 0.0) <= tolerance:
            break
    # rounded, so that the order in which sums were added up cannot show in the copies
    return state.select("sid", F.round("lam", 9).alias("lam"), "mean")


def settle(rounded: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """``rounded (_sid, _size, _n, _k)`` with a few copies more or less, so that the words of a
    source miss its target by little more than a short document: from one class of each half
    power of two of sizes, the long ones first, as many copies as still fit."""
    off = (rounded.groupBy("_sid").agg(F.sum(F.col("_k") * F.col("_size")).alias("words"))
           .join(targets.select(F.col("sid").alias("_sid"), "target"), "_sid")
           .select("_sid", (F.col("target") - F.col("words")).alias("off")))
    steps = (rounded.groupBy("_sid", F.floor(2 * F.log2("_size")).alias("step"))
             .agg(F.max_by(F.struct("_size", "_n", "_k"), F.struct("_n", -F.col("_size"))).alias("x")))
    ladder = steps.groupBy("_sid").agg(F.sort_array(F.collect_list("x"), asc=False).alias("xs")).join(off, "_sid")
    start = F.struct(F.col("off"), F.array().cast("array<struct<size:bigint,more:bigint>>").alias("out"))

    def step(acc, x):
        want = acc["off"] / x["_size"]
        whole = F.when(want >= 0, F.floor(want)).otherwise(F.ceil(want)).cast("long")
        more = F.greatest(-x["_k"], F.least(x["_n"] * max_copies - x["_k"], whole))
        return F.struct((acc["off"] - more * x["_size"]).alias("off"),
                        F.concat(acc["out"], F.array(F.struct(x["_size"].alias("size"), more.alias("more")))).alias("out"))

    moves = (ladder.select(F.col("_sid").alias("sid"), F.explode(F.aggregate("xs", start, step, lambda acc: acc["out"])).alias("m"))
             .select("sid", "m.*").filter("more <> 0"))
    return (rounded.join(moves, (F.col("_sid") == F.col("sid")) & (F.col("_size") == F.col("size")), "left")
            .select("_sid", "_size", "_n", (F.col("_k") + F.coalesce(F.col("more"), F.lit(0))).alias("_k")))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)`` for every row of ``docs
    (doc_id, source, text)``."""
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("size")), "sizes")
    targets = stored(source_targets(sizes, weights, total_share, max_copies), "targets")
    named = targets.select("sid", F.col("source").alias("_source"), "source_size", "target")
    rows = stored(sizes.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "sized")
    classes = stored(rows.filter("size > 0").groupBy("sid", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
    dual = solve(classes, targets, max_copies)
    rate = F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(max_copies)))
    along = Window.partitionBy("sid").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.floor(F.sum(F.col("n") * rate).over(along) + 0.5)
    rounded = (classes.join(dual, "sid").withColumn("upto", upto)
               .withColumn("k", F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("sid").orderBy("size")), F.lit(0)))
               .select(F.col("sid").alias("_sid"), F.col("size").alias("_size"), F.col("n").alias("_n"),
                       F.least(F.col("k"), F.col("n") * max_copies).alias("_k")))
    rounded = stored(settle(rounded, targets, max_copies), "rounded")
    # joined before they are numbered: a join of plain rows can be split where a class is large
    classed = rows.join(rounded, (F.col("sid") == F.col("_sid")) & (F.col("size") == F.col("_size")), "left")
    indexed = gapless_index(classed, ["sid", "size"], ["doc_id"], ["doc_id"], "_at", 16)
    mine = F.floor(F.col("_k") / F.col("_n")) + F.when(F.col("_at") < F.col("_k") % F.col("_n"), 1).otherwise(0)
    return indexed.select("doc_id", "source", "size", "source_size", "target", F.coalesce(mine, F.lit(0)).cast("long").alias("copies"))


def mix_words(docs: DataFrame, **how) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: the words that the mix takes."""
    return copies(docs, **how).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    own, group, size, n, words = (fresh_name(docs, c) for c in ("_id", "_source", "_size", "_copies", "_words"))
    taken = (copies(docs, **how).filter("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias(n))
             .select(F.col("doc_id").alias(own), F.col("source").alias(group), F.col("size").alias(size), n))
    sized = docs.withColumn(words, word_count(F.col("text").cast("string")))
    on = F.col("doc_id").eqNullSafe(F.col(own)) & F.col("source").eqNullSafe(F.col(group)) & (F.col(words) == F.col(size))
    return (sized.join(taken, on).select(*[qcol(c) for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int"))).alias(fresh_name(docs, "_each")))
            .select(*[qcol(c) for c in docs.columns]))
