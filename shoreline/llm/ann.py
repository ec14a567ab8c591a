"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to unit length and their two halves quantised separately, with
codebooks fitted on a bounded sample; a cell is a pair of centroids.  A query visits cells
in the order of its summed distance to both centroids, kept in a heap, until the cells
visited hold a certain share of all entries; a cell is taken whole.  The share is measured:
the one at which queries of the sample find ``recall`` of their nearest neighbours in the
sample, so clustered vectors need little of the index and vectors without any structure much
of it.  The entries of the visited cells are ranked by their cosine, in double precision on the
original vectors.  The number of centroids grows with the fourth root of the table, that of cells with the
square root; the codebooks are fitted on the bounded sample at every size.

Every row is indexed.  Cells are packed into blocks of at most ``block_rows`` entries, and
larger cells split; queries are dealt to buckets of about ``bucket_rows``, and a block goes once to each
bucket that visits it: a task holds a bounded number of vectors and of queries.  Each block
returns the best ``k`` ids of a query.

Defined cases: vectors that are NULL, zero, or hold a NULL or non-finite component take no
part, nor do those whose length is not the most frequent one (the smallest of the most
frequent); rows with a NULL ``vec_id`` take no part; ties go to the smaller ``vec_id``; a
repeated query row is one query; repeated candidate rows are one candidate; an id on several unequal
vectors is one candidate with its best score, and as a query asks with each of them; with fewer
than ``k`` candidates all are returned; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoreline.llm.common import ship, stored


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)``: distinct rows with usable vectors, as doubles."""
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)))
    lengths = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.filter(F.size("v") == (lengths["n"] if lengths else 0)).dropDuplicates(["vec_id", "v"])


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def codebook(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """At most ``k`` centroids of the rows of ``x`` (Lloyd's algorithm)."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None])


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i:i + 4096], c).argmin(axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def visit(first: np.ndarray, second: np.ndarray, entries: np.ndarray, candidates: int) -> list[int]:
    """Cells in the order of summed distance until they hold ``candidates`` entries.

    The multi-sequence walk: the heap holds the pairs whose predecessors in both sorted
    centroid lists were visited."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, found = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and found < candidates:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if entries[cell]:
            out.append(cell)
            found += int(entries[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def fewer(eid: np.ndarray, e: np.ndarray, most: int) -> np.ndarray:
    """Places of the entries of which any may be among the ``most - 1`` nearest of a query: of equal
    vectors those with the ``most`` smallest ids."""
    _, same = np.unique(np.ascontiguousarray(e).view([("", e.dtype)] * e.shape[1]).ravel(), return_inverse=True)
    order = np.lexsort((eid, same))
    start = np.searchsorted(same[order], same[order])
    return np.sort(order[np.arange(len(order)) - start < most])


def best(queries: tuple[np.ndarray, np.ndarray], entries: tuple[np.ndarray, np.ndarray], k: int,
         allowed: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """The ``k`` ids of largest cosine for each query but itself, among the entries that the
    matrix ``allowed`` marks: (query, entry, score), an id once a query row, with its best score."""
    (qid, q), (eid, e) = queries, entries
    out = []
    if not len(eid):
        return out
    qs, es = q / np.abs(q).max(axis=1, keepdims=True), e / np.abs(e).max(axis=1, keepdims=True)
    en = np.sqrt((es * es).sum(axis=1))
    enough = k * int(np.unique(eid, return_counts=True)[1].max())  # so many entries hold k ids
    for lo in range(0, len(qid), 256):
        part = qs[lo:lo + 256]
        score = part @ es.T / (np.sqrt((part * part).sum(axis=1))[:, None] * en[None])
        score[qid[lo:lo + 256, None] == eid[None]] = -np.inf
        if allowed is not None:
            score[~allowed[lo:lo + 256]] = -np.inf
        # everything that may tie with the last
        least = np.partition(score, -enough, axis=1)[:, -enough] if score.shape[1] > enough else np.full(len(part), -2.0)
        rows, cols = np.nonzero((score >= least[:, None] - 1e-12) & np.isfinite(score))
        # pairs again one by one, so that a score doesn't depend on its block
        exact = cosine(q[lo + rows], e[cols])
        order = np.lexsort((-exact, eid[cols], rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:] != rows[:-1]) | (eid[cols[1:]] != eid[cols[:-1]])
        rows, cols, exact = rows[first], cols[first], exact[first]
        order = np.lexsort((eid[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        start = np.searchsorted(rows, np.arange(len(part)))
        top = np.arange(len(rows)) - start[rows] < k
        out += zip(qid[lo + rows[top]].tolist(), eid[cols[top]].tolist(), exact[top].tolist())
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of matching rows; scaled first, so that squares neither over- nor underflow."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def needed_share(x: np.ndarray, books: list[np.ndarray], k: int, recall: float, queries: int = 256) -> float:
    """Share of the sample ``x`` (unit vectors) that the cells before a neighbour's hold, and its own,
    for the share ``recall`` of the ``k`` nearest neighbours of some of its vectors."""
    half, width = books[0].shape[1], len(books[1])
    cell = nearest(x[:, :half], books[0]) * width + nearest(x[:, half:], books[1])
    held = np.bincount(cell, minlength=len(books[0]) * width)
    shares = []
    for q in range(min(queries, len(x))):
        score = x @ x[q]
        score[q] = -np.inf
        near = np.argsort(-score, kind="stable")[:min(k, len(x) - 1)]
        d = distances(x[q:q + 1, :half], books[0])[0], distances(x[q:q + 1, half:], books[1])[0]
        seen = np.cumsum(held[(order := np.argsort((d[0][:, None] + d[1][None]).ravel(), kind="stable"))])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        shares += (seen[place[cell[near]]] / len(x)).tolist()
    return float(np.quantile(shares, recall)) if shares else 1.0


def blocks_of(held: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block of each cell and its number of blocks: neighbouring cells share a block of at most
    ``block_rows`` entries, a larger cell has some of its own."""
    first, parts = np.zeros(len(held), np.int64), np.ones(len(held), np.int64)
    block, used = 0, 0
    for c, n in enumerate(held.tolist()):
        if n > block_rows:
            block, used = block + (used > 0), 0
            first[c], parts[c] = block, -(-n // block_rows)
            block += int(parts[c])
        else:
            if used + n > block_rows:
                block, used = block + 1, 0
            first[c] = block
            used += n
    return first, parts


def search(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = 0.95, sample: int = 20_000,
           centroids: int = 48, block_rows: int = 4096, share: float | None = None, bucket_rows: int = 8192) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for every row that
    ``is_query`` selects, among all rows of ``vectors (vec_id, embedding)`` but its own.

    ``share`` of the entries to visit, if given, replaces the measured one; ``centroids`` is the least
    number of centroids of a half."""
    spark = vectors.sparkSession
    ship(spark)
    clean = stored(usable(vectors), "vectors")
    n = clean.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    luck = F.shiftrightunsigned(F.xxhash64("vec_id"), 11) / F.lit(float(1 << 53))
    drawn = clean.filter(luck < sample / n) if n > sample else clean
    fit = drawn.orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * sample).select("v").toArrow()
    x = unit(matrix(fit.column(0)))
    half = x.shape[1] // 2 or x.shape[1]
    centroids = max(centroids, round(3.2 * n**0.25))
    books = [codebook(x[:, :half], centroids), codebook(x[:, half:], centroids) if x.shape[1] > half else np.zeros((1, 0))]
    width = len(books[1])
    wanted = (needed_share(x, books, k, recall) if share is None else share) * n

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = unit(matrix(b.column(1)))
            at = nearest(u[:, :half], books[0]) * width + nearest(u[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], ["vec_id", "v", "cell"])

    index = stored(clean.mapInArrow(cells, "vec_id long, v array<double>, cell int"), "index")
    held = np.zeros(len(books[0]) * width, np.int64)
    for r in index.groupBy("cell").count().collect():  # a row a pair of centroids
        held[r["cell"]] = r["count"]
    first, parts = blocks_of(held, min(block_rows, max(256, n // 64)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                some = b.slice(lo, 64)
                u = unit(matrix(some.column(1)))
                d = distances(u[:, :half], books[0]), distances(u[:, half:], books[1])
                rows, block, inside = [], [], []
                for i in range(some.num_rows):
                    visited = np.sort(np.array(visit(d[0][i], d[1][i], held, int(wanted) + 1), np.int64))  # its own entry is none
                    many = visited[parts[visited] > 1]
                    for c in many.tolist():
                        for part in range(parts[c]):
                            rows.append(i)
                            block.append(int(first[c]) + part)
                            inside.append([c])
                    few = visited[parts[visited] == 1]
                    at, start = np.unique(first[few], return_index=True)
                    rows += [i] * len(at)
                    block += at.tolist()
                    inside += [x.tolist() for x in np.split(few, start[1:])] if len(at) else []
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(take), some.column(1).take(take), pa.array(block, pa.int32()),
                     pa.array(inside, pa.list_(pa.int32()))], ["vec_id", "v", "block", "cells"])

    queries = clean.filter(is_query)
    buckets = 1 + queries.count() // bucket_rows
    bucket = F.pmod(F.xxhash64("vec_id", "v"), F.lit(buckets)).cast("int").alias("bucket")
    asked = stored(queries.mapInArrow(walk, "vec_id long, v array<double>, block int, cells array<int>")
                   .select("*", bucket), "asked")
    visited_by = stored(asked.select("block", "bucket").distinct(), "visits")
    where = spark.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(first, parts))], "cell int, first int, parts int")
    entries = (index.join(F.broadcast(where), "cell")  # a row a pair of centroids
               .select("vec_id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int").alias("block"))
               .join(visited_by, "block"))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            eid, e, cell = right.column("vec_id").to_numpy(), matrix(right.column("v")), right.column("cell").to_numpy()
            keep = fewer(eid, e, k + 1)
            eid, e, cell = eid[keep], e[keep], cell[keep]
            here, of = np.unique(cell, return_inverse=True)
            for lo in range(0, left.num_rows, 1024):
                some = left.slice(lo, 1024)
                inside = np.zeros((some.num_rows, len(here) + 1), bool)
                lists = some.column("cells").combine_chunks()
                row = np.repeat(np.arange(some.num_rows), lists.value_lengths().to_numpy())
                at = np.searchsorted(here, c := lists.flatten().to_numpy())
                inside[row, np.where(np.append(here, -1)[at] == c, at, len(here))] = True
                found += best((some.column("vec_id").to_numpy(), matrix(some.column("v"))), (eid, e), k, inside[:, of])
        q, e, s = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(e, pa.int64()), "score": pa.array(s, pa.float64())})

    near = (asked.groupBy("block", "bucket").cogroup(entries.groupBy("block", "bucket"))
            .applyInArrow(rank, "query_id long, vec_id long, score double"))
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
