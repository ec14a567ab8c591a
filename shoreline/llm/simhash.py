"""SimHash near-duplicate classes.

Every text gets a 64-bit SimHash of its word shingles.  Distinct fingerprints are
dealt to blocks by the population counts of their two halves; every pair of blocks
whose counts allow a distance within the radius is compared exactly in one task, tile
by tile, with numpy exclusive-or and bit counts, skipping tile pairs whose population
counts (of the four quarters) differ beyond the radius.  A task returns a spanning
forest of the links that it finds, and connected components join the forests.

Defined cases: a text that is NULL or has no word has fingerprint 0 and links like any
other; shorter texts than a shingle hash their whole word sequence; repeated rows share
fingerprint and class; a NULL ``doc_id`` gets a class too but never names one, unless the
class holds no other id (then its ``component_id`` is NULL); an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoreline.llm.common import TEXT_ROWS, components, fresh_name, qcol, release_memory, ship, stored

#: rows of the tiles that are compared at once
TILE_A, TILE_B = 128, 1024


def simhash(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash: words of the ASCII-lower-cased text, shingles of
    ``shingle`` words joined by a space, XXH64 with seed 42; a bit is set if it is set
    in over half of the shingle hashes."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1:].tolist())], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(bits), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, key: Column | None = None) -> DataFrame:
    """``(doc_id, fp)``: the SimHash of every row's text, as a signed long; and the string ``key``, if given."""
    carried = [F.col("doc_id")] if key is None else [F.col("doc_id"), key.alias("key")]
    names = ["doc_id", "fp"] if key is None else ["doc_id", "key", "fp"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle) for t in b.column(0)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps.view(np.int64))], names)
        release_memory()

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, fp long" if key is None else f"doc_id {kind}, key string, fp long"
    return docs.select(F.col("text").cast("string"), *carried).mapInArrow(each, schema)


def _boxes(counts: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(counts), tile)
    return np.minimum.reduceat(counts, at, axis=0), np.maximum.reduceat(counts, at, axis=0)


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view("<u2").reshape(-1, 4)).astype(np.int16)


def _sorted(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fp = np.ascontiguousarray(fp)
    q = _quarters(fp)
    order = np.lexsort((fp, q[:, 3], q[:, 2], q[:, 1], q[:, 0]))
    return fp[order], q[order]


def _merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the sets of ``i`` and ``j`` in ``parent`` (every entry points at its root)."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        high, low = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        np.minimum.at(parent, high, low)
        while not np.array_equal(parent[parent], parent):
            parent[:] = parent[parent]


def links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within ``radius`` bits between two arrays of distinct
    fingerprints, or within ``left`` if ``right`` is None: node and root of its tree."""
    a, qa = _sorted(left)
    b, qb = (a, qa) if right is None else _sorted(right)
    nodes = a if right is None else np.concatenate([a, b])
    shift = 0 if right is None else len(a)
    parent = np.arange(len(nodes))
    if len(a) and len(b):
        (la, ha), (lb, hb) = _boxes(qa, TILE_A), _boxes(qb, TILE_B)
        for t in range(len(la)):
            gap = np.maximum(0, np.maximum(la[t] - hb, lb - ha[t])).sum(axis=1)
            rows = a[t * TILE_A:(t + 1) * TILE_A, None]
            for u in np.flatnonzero(gap <= radius):
                if right is None and (u + 1) * TILE_B <= t * TILE_A:
                    continue  # both orders of a pair: one is enough
                near = np.bitwise_count(rows ^ b[None, u * TILE_B:(u + 1) * TILE_B]) <= radius
                i, j = np.nonzero(near)
                if len(i):
                    _merge(parent, i + t * TILE_A, j + u * TILE_B + shift)
    at = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[at], nodes[parent[at]]


def _plan(counts: list[tuple[int, int, int]], blocks: int) -> list[tuple]:
    """Blocks over the population counts of both halves: consecutive count pairs up to the
    mean size; a pair with more rows is dealt to several blocks by a hash.  Rows
    ``(left, right, first block, blocks)``."""
    mean = max(1, -(-sum(n for *_, n in counts) // blocks))
    out, block, room = [], 0, mean
    for left, right, n in sorted(counts):
        if n > room and room < mean:
            block, room = block + 1, mean
        parts = max(1, round(n / mean))
        out.append((left, right, block, parts))
        if parts > 1 or n >= room:
            block, room = block + parts, mean
        else:
            room -= n
    return out


def near_links(fps: DataFrame, radius: int = 4, blocks: int = 32, max_block_rows: int = 1_000_000) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints (column ``fp``, distinct) that connect
    all that lie within ``radius`` bits.

    The number of blocks is at least ``blocks`` and grows so that none holds much over
    ``max_block_rows``: a task's memory is bounded.  What goes to the driver are at most
    33 x 33 counts, and the block pairs.
    """
    spark = fps.sparkSession
    half = lambda name, c: F.bit_count(c).alias(name)
    keyed = fps.select("fp", half("l", F.shiftrightunsigned("fp", 32)), half("r", F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))))
    counts = [tuple(x) for x in keyed.groupBy("l", "r").count().collect()]
    blocks = max(blocks, -(-sum(n for *_, n in counts) // max_block_rows))
    plan = _plan(counts, blocks)
    boxes: dict[int, list[int]] = {}
    for left, right, first, parts in plan:
        for k in range(first, first + parts):
            x = boxes.setdefault(k, [left, left, right, right])
            x[:] = [min(x[0], left), max(x[1], left), min(x[2], right), max(x[3], right)]
    gap = lambda x, y: max(0, x[0] - y[1], y[0] - x[1]) + max(0, x[2] - y[3], y[2] - x[3])
    pairs = [(a, b) for a in boxes for b in boxes if a <= b and gap(boxes[a], boxes[b]) <= radius]
    ends = [(k, n, k == b, a == b) for n, (a, b) in enumerate(pairs) for k in {a, b}]
    places = spark.createDataFrame(plan, "l int, r int, first int, parts int")
    partners = spark.createDataFrame(ends, "block int, pair int, second boolean, alone boolean")
    dealt = (keyed.join(F.broadcast(places), ["l", "r"])  # at most 33 x 33 rows
             .select("fp", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int").alias("block"))
             .join(F.broadcast(partners), "block")  # two rows a block pair
             .select("pair", "fp", "second", "alone"))

    def compare(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        second = group.column("second").to_numpy()
        alone = group.column("alone")[0].as_py()
        u, v = links(fp, None, radius) if alone else links(fp[~second], fp[second], radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return dealt.groupBy("pair").applyInArrow(compare, "u long, v long")


def _classes(nodes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``nodes`` (with distinct ``fp``) and the fingerprint ``root`` that stands for their class."""
    roots = components(near_links(nodes.select("fp"), radius, blocks))
    return (nodes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
            .withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, blocks: int = 32) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs (doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` that links of at most ``radius`` differing
    bits reach, itself included.
    """
    fps = stored(fingerprints(docs, shingle), "fingerprints", TEXT_ROWS)
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    rooted = _classes(nodes, radius, blocks)
    names = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(names, "root").select("fp", "component_id")
    return (fps.join(classes, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4, blocks: int = 32) -> DataFrame:
    """One row of each class of near duplicates: that of the smallest ``doc_id`` (a missing one
    comes last), then the smallest hash of its text, then the first by its columns.

    Classes are told by their texts alone, so a ``doc_id`` that is missing or stands on
    several texts may stay several times, once a class.
    """
    text_hash = lambda: F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit(""))
    fps = fingerprints(docs, shingle, text_hash())
    # rows of one id and text are in one class: their number tells whether one must be picked
    texts = fps.groupBy("fp", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n"))
    nodes = stored(texts.groupBy("fp").agg(first.alias("rep")), "nodes", TEXT_ROWS)
    own, hashed, n, at = (fresh_name(docs, c) for c in ("_kept", "_hash", "_rows", "_at"))
    kept = (_classes(nodes, radius, blocks).groupBy("root").agg(F.min("rep").alias("rep"))
            .select(F.col("rep.doc_id").alias(own), F.col("rep.key").alias(hashed), F.col("rep.n").alias(n)))
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)) & (text_hash() == F.col(hashed)))
    columns = [qcol(c) for c in docs.columns]
    single = rows.filter(F.col(n) == 1).select(*columns)
    order = [qcol(f.name) for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    first = (rows.filter(F.col(n) > 1)
             .withColumn(at, F.row_number().over(Window.partitionBy(own, hashed).orderBy(*order)))
             .filter(F.col(at) == 1).select(*columns))
    return single.unionByName(first)
