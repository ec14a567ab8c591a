"""Line deduplication: repeated runs of lines are deleted but for their first copy.

A text is a sequence of line ids.  Distributed prefix doubling ranks the blocks of 1, 2,
4, ... lines that start at each line in lexicographic order of line ids, as in the
construction of a suffix array; a line whose block is unique drops out, since it can begin
no longer repeat.  Two suffixes share a prefix of a given length exactly if the ranks of two
(overlapping) blocks agree, so equal rank pairs are the longest-common-prefix intervals
of that depth.  A run of lines is deleted if it holds at least ``min_chars`` characters,
and an earlier copy exists (by ``doc_id``, then line; also within a document).

Only the shortest runs of ``min_chars`` from every line on, and up to every line, need
to be looked up: the lines of every maximal repeated run are exactly those of its shortest
such runs.

DataFrame operations only.  Defined cases: a NULL text stays NULL and has no lines; an
empty text has one empty line; a NULL ``doc_id`` comes last; documents of one ``doc_id`` are
ordered by a hash of their text; rows that repeat both are one document and get the same
result; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoreline.llm.common import fresh_name, ordered_rank, qcol, stored

POSITION = ["doc", "line"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, doc, line, chars, r)``: the lines that occur at other places too, ``doc`` in
    document order, ``r`` the rank of the line."""
    text = F.col("text").cast("string")
    line = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.length(x).alias("chars"))
    rows = stored(docs.filter(text.isNotNull()).select("doc_id", F.xxhash64(text).alias("h"), F.posexplode(F.transform(_lines(text), line)).alias("line", "x"))
                  .select("doc_id", "h", "line", "x.*"), "lines")
    ids = ordered_rank(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b"),
                       [F.col("a"), F.col("b")], "r", "ids")
    active = stored(rows.join(ids, ["a", "b"]).select("doc_id", "h", "line", "chars", "r").distinct(), "active")
    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]
    named = ordered_rank(active.select("doc_id", "h").distinct(), order, "doc", "docs").select(
        F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "doc")
    return stored(active.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).drop("_id", "_h"), "active")


def double(ranks: DataFrame, length: int) -> DataFrame:
    """Ranks ``(doc, line, r)`` of blocks of twice ``length`` lines from those of ``length``:
    blocks that occur at least twice."""
    second = ranks.select("doc", (F.col("line") - length).alias("line"), F.col("r").alias("r2"))
    pairs = stored(ranks.join(second, POSITION), "pairs")
    again = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("r", "r2")
    names = ordered_rank(again, [F.col("r"), F.col("r2")], "name", "names")
    return stored(pairs.join(names, ["r", "r2"]).select("doc", "line", F.col("name").alias("r")), "ranks")


def windows(active: DataFrame, min_chars: int) -> DataFrame:
    """``(doc, s, e)``: from every line, and up to every line, the shortest run of
    neighbouring repeated lines with ``min_chars`` characters."""
    in_doc = Window.partitionBy("doc").orderBy("line")
    runs = active.select("doc", "line", "chars", (F.col("line") - F.row_number().over(in_doc)).alias("run"))
    run = Window.partitionBy("doc", "run")
    c = runs.withColumn("upto", F.sum("chars").over(run.orderBy("line"))).withColumn("before", F.col("upto") - F.col("chars"))
    c = c.withColumns({
        "first": F.min("line").over(run), "last": F.max("line").over(run), "all": F.max("upto").over(run),
        "ahead": F.count(F.lit(1)).over(run.orderBy("before").rangeBetween(Window.unboundedPreceding, min_chars - 1)),
        "behind": F.count(F.lit(1)).over(run.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_chars))})
    end = (F.col("first") + F.col("ahead") - 1).cast("int")
    start = (F.col("first") + F.col("behind")).cast("int")
    forward = F.when(F.col("all") - F.col("before") >= min_chars, F.struct(F.col("line").alias("s"), end.alias("e")))
    backward = F.when(F.col("upto") >= min_chars, F.struct(start.alias("s"), F.col("line").alias("e")))
    return c.select("doc", F.explode(F.array_distinct(F.array_compact(F.array(forward, backward)))).alias("x")).select("doc", "x.*").distinct()


def later_copies(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, h, mask)`` for documents that lose lines: ``mask`` tells for each line (up to the
    last lost one) whether it is lost."""
    active = repeated_lines(docs)
    asked = stored(windows(active, min_chars).withColumn("n", F.col("e") - F.col("s") + 1)
                   .withColumn("level", F.floor(F.log2(F.col("n") + 0.5)).cast("int")), "windows")
    top = asked.agg(F.max("level")).first()[0] or 0
    ranks = active.select("doc", "line", "r")
    levels = ranks.withColumn("level", F.lit(0))
    for level in range(top):
        ranks = double(ranks, 1 << level)
        levels = levels.unionByName(ranks.withColumn("level", F.lit(level + 1)))
    tail = F.col("e") - F.pow(F.lit(2.0), F.col("level")).cast("int") + 1
    head_ranks = levels.select("doc", F.col("line").alias("s"), "level", F.col("r").alias("r1"))
    tail_ranks = levels.select("doc", F.col("line").alias("t"), "level", F.col("r").alias("r2"))
    found = stored(asked.withColumn("t", tail).join(head_ranks, ["doc", "s", "level"])
                   .join(tail_ranks, ["doc", "t", "level"]).select("doc", "s", "e", "n", "r1", "r2"), "intervals")
    # stored, so that both sides of the join are plain rows and a run with very many copies can be split
    first = stored(found.groupBy("n", "r1", "r2").agg(F.min(F.struct("doc", "s")).alias("at"), F.count(F.lit(1)).alias("copies"))
                   .filter("copies > 1").drop("copies"), "first")
    copies = found.join(first, ["n", "r1", "r2"]).filter(F.struct("doc", "s") > F.col("at"))
    lost = copies.select("doc", F.explode(F.sequence("s", "e")).alias("line")).distinct()
    gap = F.col("line") - F.coalesce(F.lag("line").over(Window.partitionBy("doc").orderBy("line")), F.lit(-1)) - 1
    part = lost.withColumn("part", F.concat(F.array_repeat(F.lit(False), gap), F.array(F.lit(True))))
    masks = part.groupBy("doc").agg(F.flatten(F.sort_array(F.collect_list(F.struct("line", "part")))["part"]).alias("mask"))
    keys = active.select("doc", "doc_id", "h").distinct()
    return masks.join(keys, "doc").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("mask").alias("_mask"))


def dedup_lines(docs: DataFrame, min_chars: int = 60, names: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from ``text``, and two further
    columns: the lines before and the lines deleted, called ``names`` or else ``_lines`` and
    ``_lost`` (or a like name that is free)."""
    names = names or (fresh_name(docs, "_lines"), fresh_name(docs, "_lost"))
    lost = later_copies(docs, min_chars)
    text = F.col("text").cast("string")
    own, h, mask = fresh_name(docs, "_id"), fresh_name(docs, "_h"), fresh_name(docs, "_mask")
    lost = lost.select(F.col("_id").alias(own), F.col("_h").alias(h), F.col("_mask").alias(mask))
    on = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(h))
    kept = F.array_join(F.filter(_lines(text), lambda x, i: ~F.coalesce(F.get(F.col(mask), i), F.lit(False))), "\n")
    out = F.when(F.col(mask).isNull(), text).otherwise(kept)
    columns = [out.cast(docs.schema["text"].dataType).alias("text") if c == "text" else qcol(c) for c in docs.columns]
    n = F.when(text.isNull(), 0).otherwise(F.size(_lines(text)))
    gone = F.coalesce(F.size(F.filter(mask, lambda x: x)), F.lit(0))
    return docs.join(lost, on, "left").select(*columns, n.cast("long").alias(names[0]), gone.cast("long").alias(names[1]))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 60) -> DataFrame:
    """``docs`` without later copies of runs of lines; a document that loses all its words so is
    a copy itself and goes; ``n_chars`` follows the text."""
    names = fresh_name(docs, "_lines"), fresh_name(docs, "_lost")
    gone = F.col(names[1])
    rows = dedup_lines(docs, min_chars, names).filter((gone == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    chars = lambda c: F.when(gone > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return rows.select(*[chars(c) if c == "n_chars" else qcol(c) for c in docs.columns])
