"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoreline.operators._util import fresh_name, qcol
from shoreline.session import materialize, scratch_folder

__all__ = ["TEXT_ROWS", "batches_of", "components", "fresh_name", "gapless_index", "ordered_index", "ordered_rank", "qcol",
           "release_memory", "scratch", "ship", "stored", "table", "word_count"]

#: whole texts that go to a Python worker at once: it holds a batch and the next one, and the executor's JVM its buffers of both
TEXT_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started: once an
    application, its source files go to the executors as a zip file."""
    sc = spark.sparkContext
    if getattr(sc, "_shoreline_shipped", None):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.TemporaryDirectory()  # on the driver, whose file server hands it out; goes with the context
    path = os.path.join(folder.name, f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)
    sc._shoreline_shipped = folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, deleted when the application ends."""
    return scratch_folder(spark, f"llm/{name}")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run in this block send Python workers at most ``rows`` rows at once (or the session's own number, if lower)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = int(spark.conf.get(key))
    spark.conf.set(key, min(rows, was) if was > 0 else rows)  # 0 or less: any number
    try:
        yield
    finally:
        spark.conf.set(key, was)


def release_memory() -> None:
    """Give what a Python worker has freed back to the system (which Arrow and the C library else keep for it), for
    the worker waits for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None  # the GNU C library has it
    if trim:
        trim(0)


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to a scratch folder and read it back: computed once, lineage cut,
    safe against lost executors, columns still prunable.  ``batch_rows``: the most rows that a
    Python worker gets at once."""
    path = scratch(df.sparkSession, name)
    if batch_rows is None:
        return materialize(df, path)
    with batches_of(df.sparkSession, batch_rows):
        return materialize(df, path)


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def gapless_index(df: DataFrame, keys: list[str], spread: list[str], order: list[str],
                  into: str = "_index", buckets: int = 64) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... without gathering a key in one task.

    Rows of a key are dealt to ``buckets`` by a hash of the ``spread`` columns and
    ordered by ``order`` within a bucket; a bucket's offset is the number of rows of
    the key in earlier buckets.  NULL keys form a key of their own.
    """
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)))
    sizes = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)],
                           F.col("_bucket").alias("_b"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = b.withColumn("_row", F.row_number().over(
        Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    on = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    return (numbered.join(offsets, on)
            .withColumn(into, (F.col("_offset") + F.col("_row")).cast("long"))
            .drop("_bucket", "_row", "_offset", "_b", *[f"_k_{i}" for i in range(len(keys))]))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges (u, v)`` of longs.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step
    is an aggregate, stored, and a join with it on the node, so that the links of a
    node with very many can be split.  Edges are rewritten until they form stars.
    Returns ``(u, v)``: every node that is not the smallest of its component, with
    that smallest node.
    """
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"),
                                                 F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = stored(large, "large")
        low2 = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low2, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").filter("u <> v").distinct()
        edges = stored(small, "edges")
        was, mark = mark, _mark(edges)
        if was == mark:
            break
    return edges


def ordered_rank(df: DataFrame, order: list[Column], into: str, name: str) -> DataFrame:
    """``df`` stored with a long that grows in ``order``, unique but with gaps, from a
    distributed sort."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(sorted_rows.withColumn(into, F.monotonically_increasing_id()), name)


def ordered_index(df: DataFrame, order: list[Column], into: str, name: str) -> DataFrame:
    """``df`` with each row's place 0, 1, 2, ... in ``order``, without sorting in one task."""
    ranked = ordered_rank(df, order, "_rank", name)
    part = F.shiftright("_rank", 33)
    sizes = ranked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (ranked.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(into, (F.col("_offset") + F.col("_rank").bitwiseAND(F.lit((1 << 33) - 1))).cast("long"))
            .drop("_rank", "_part", "_offset"))
