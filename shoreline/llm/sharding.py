"""Sharding by sampled splitters: near-equal bytes in every shard, equal texts together.

Rows are ordered by a hash of their text.  A size-weighted sample of the distinct texts
gives quantile boundaries that cut this order into many ranges of about equal bytes; the
exact bytes of the ranges then decide which consecutive ranges make a shard.  A range that
turns out overfull is subdivided.  Texts whose copies fill a noticeable part of a shard
are ranges of their own: they are placed whole on the emptiest shard, and subdivided by
row only if they don't fit into it.

Defined cases: NULL text counts no bytes and has CRC 0, as an empty one has, and both go
together; a NULL ``doc_id`` is a value like any other; repeated rows each get a slot; an
empty table gives an empty result; with fewer texts than shards some shards stay empty;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.llm.common import gapless_index, ship, stored

#: bytes that a record needs besides its text
OVERHEAD = 16


def records(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32, key)``: key is a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("key"))


def splitters(keys: np.ndarray, weights: np.ndarray, ranges: int) -> np.ndarray:
    """Boundaries that cut weighted keys into ranges of equal weight: a key goes to the
    range numbered by how many boundaries are below it."""
    if not len(keys):
        return np.empty(0, np.int64)
    order = np.argsort(keys)
    total = np.cumsum(weights[order])
    at = np.searchsorted(total, total[-1] * np.arange(1, ranges) / ranges)
    return np.unique(keys[order][np.minimum(at, len(keys) - 1)])


def place_heavy(heavy: list[tuple[int, int]], shards: int, share: float) -> tuple[dict[int, int], list[float]]:
    """Shard by key for the groups ``(key, size)`` that fit whole, largest first on the
    emptiest shard; and the bytes so placed."""
    load, placed = [0.0] * shards, {}
    for key, size in sorted(heavy, key=lambda x: (-x[1], x[0])):
        k = min(range(shards), key=lambda s: (load[s], s))
        if load[k] + size <= share:
            load[k] += size
            placed[key] = k
    return placed, load


def fill(sizes: np.ndarray, load: list[float], share: float) -> np.ndarray:
    """Shard of consecutive ranges of ``sizes``: each shard takes what it has room for."""
    room = np.cumsum(np.maximum(0.0, share - np.array(load)))
    middle = (np.cumsum(sizes) - sizes / 2) * (room[-1] / max(1.0, float(sizes.sum())))
    return np.minimum(np.searchsorted(room, middle, side="right"), len(load) - 1)


def shard_by_bytes(docs: DataFrame, shards: int = 40, ranges_per_shard: int = 128, sample_per_range: int = 8,
                   heavy_share: float = 0.01, max_bucket_rows: int = 1_000_000) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row.

    What reaches the driver is bounded by parameters: the sample (``shards *
    ranges_per_shard * sample_per_range`` keys on average), the ranges' sizes, and the at
    most ``shards / heavy_share`` groups of over ``heavy_share`` of a shard.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = stored(records(docs), "records")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    share = total / shards
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    heavy = sorted((r["key"], r["size"]) for r in groups.filter(F.col("size") > share * heavy_share).collect())
    placed, load = place_heavy(heavy, shards, share)
    ranges = shards * ranges_per_shard
    rate = ranges * sample_per_range / max(1, total)
    luck = F.shiftrightunsigned(F.xxhash64(F.lit("splitters"), "key"), 11) / F.lit(float(1 << 53))
    drawn = (groups.filter((F.col("size") <= share * heavy_share) & (luck < F.col("size") * rate))
             .select("key", F.greatest(F.col("size").cast("double"), F.lit(1 / rate)).alias("w")).toPandas())
    cuts = splitters(drawn["key"].to_numpy(np.int64), drawn["w"].to_numpy(float), ranges)
    alone = np.array([k for k, _ in heavy], np.int64)

    def into_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(b.schema.get_field_index("key")).to_numpy()
            at = np.searchsorted(cuts, key)
            if len(alone):
                own = np.minimum(np.searchsorted(alone, key), len(alone) - 1)
                at = np.where(alone[own] == key, len(cuts) + 1 + own, at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], [*b.schema.names, "range"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ranged = rows.mapInArrow(into_range, f"doc_id {kind}, size long, text_crc32 long, key long, range int")
    found = {r["range"]: r["size"] for r in ranged.groupBy("range").agg(F.sum("size").alias("size")).collect()}
    most = max(1.0, share / ranges_per_shard)
    # parts of overfull ranges: of many texts by text, of one text by row
    parts = []
    for at, size in found.items():
        if at <= len(cuts):
            parts.append((at, max(1, round(size / most)) if size > 2 * most else 1, False))
        else:
            parts.append((at, 1 if int(alone[at - len(cuts) - 1]) in placed else -(-size // int(most)), True))
    divided = spark.createDataFrame(parts, "range int, parts int, by_row boolean")
    pieces = (ranged.join(F.broadcast(divided), "range")  # a row a range
              .withColumn("part", F.pmod(F.when(F.col("by_row"), F.xxhash64("key", "doc_id")).otherwise(F.xxhash64("key")),
                                         F.col("parts")).cast("int")))
    if parts:
        sizes = sorted((r["range"], r["part"], r["size"]) for r in pieces.groupBy("range", "part").agg(F.sum("size").alias("size")).collect())
    else:
        sizes = []
    fixed = {len(cuts) + 1 + i: placed[k] for i, k in enumerate(alone.tolist()) if k in placed}
    loose = [x for x in sizes if x[0] not in fixed]
    homes = fill(np.array([x[2] for x in loose], float), load, share) if loose else []
    where = [(a, p, int(s)) for (a, p, _), s in zip(loose, homes)] + [(a, p, fixed[a]) for a, p, _ in sizes if a in fixed]
    homes_df = spark.createDataFrame(where, "range int, part int, shard int")
    sharded = pieces.join(F.broadcast(homes_df), ["range", "part"]).select("doc_id", "size", "text_crc32", "key", "shard")
    buckets = max(64, -(-n // (shards * max_bucket_rows)))
    return (gapless_index(sharded, ["shard"], ["key", "doc_id"], ["key", "doc_id"], "slot", buckets)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))
