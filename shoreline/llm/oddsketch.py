"""MinHash near-duplicate classes with odd sketches.

The ``samples`` MinHash values of a text's shingle set are cut into bands, whose equality names
candidates.  Odd sketches verify them: bitmaps in which every sampled value flips one bit, so that the
exclusive-or of two has a bit for each value that only one of the sets has, but for bits that are hit
twice; its population count never exceeds the number of differing values.  There are two:

* the coarse one folds the MinHash values: a sample in which the sets differ flips at most two bits;
* the fine one folds the shingles themselves, of large sets only every 2nd, 4th, ... by hash, so
  that it holds about ``FINE_VALUES`` at most; its counts bound the symmetric difference, so it
  tells similarities near the bound apart to a percent or two.

Candidates with too high a count cannot be linked; all others are confirmed on their full sets.

Texts of equal sets are one node.  No bucket is gathered or paired up: every node of a bucket
is first held against the bucket's smallest and largest node only, which joins groups of copies of any
size.  Pairs of nodes that are in one class by then need no check.  For the others, buckets
that still hold several classes (of several with equal nodes one) are cut into blocks of at most
``block_rows`` nodes, a large class into blocks of its own; pairs of blocks (but for two of the same class)
are compared in tasks, sketch by sketch, and what remains is confirmed like before.

A link is lost only if no band agrees or a sample differs more than the bounds allow: with 96 samples in 24
bands and a similarity of exactly 0.85, 2e-8, and at most 1e-8 by the sketches; at higher similarities far fewer.

Defined cases: a text that is NULL or has no word has an empty set and is linked with nothing, so its
class is its own ``doc_id``; a shorter text than a shingle is its whole word sequence;
repeated rows are in one class; a NULL ``doc_id`` gets a class too but never names one, unless the
class holds no other id (then ``component_id`` is NULL and its rows are kept); rows that repeat
the ``doc_id`` of their class are all kept; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.llm.common import components, ship, stored

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: most values in a fine sketch (about), and its bits
FINE_VALUES, FINE_BITS = 2048, 2048


def mix(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit numbers from others, one to one."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


#: for every byte its value in a word's hash: 0 for white space, that of the small letter for A to Z
_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
_VALUES[65:91] = _VALUES[97:123]
_VALUES[[32, *range(9, 14)]] = 0
_SPACE = _VALUES == 0
_PART = 1 << 18
_STEPS = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def _powers(many: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64."""
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(many - 1, _ODD, np.uint64))])[:many]


_POWERS = _powers(64)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word: its bytes' values, times powers by their places, added and mixed.  Long
    texts are read in parts that end with a word."""
    raw, out, lo = np.frombuffer(text, np.uint8), [], 0
    while lo < len(raw):
        hi = lo + _PART
        while hi < len(raw) and not _SPACE[raw[hi - 1]]:
            gap = np.flatnonzero(_SPACE[raw[hi:hi + _PART]])
            hi = hi + int(gap[0]) + 1 if len(gap) else hi + _PART
        part = raw[lo:hi]
        lo = hi
        space = _SPACE[part]
        first = ~space
        first[1:] &= space[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        spans = np.diff(starts, append=len(part))
        place = np.arange(starts[0], len(part)) - np.repeat(starts, spans)
        powers = _POWERS if spans.max() <= len(_POWERS) else _powers(int(spans.max()))
        out.append(np.add.reduceat(_VALUES[part[starts[0]:]] * powers[place], starts - starts[0]))
    return mix(np.concatenate(out)) if out else np.empty(0, np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of the ASCII-lower-cased text; a shorter text's
    whole word sequence."""
    h = word_hashes(text.encode()) if text else np.empty(0, np.uint64)
    if not len(h):
        return h
    size = min(shingle, len(h))
    many = len(h) - size + 1
    joined = np.full(many, size, np.uint64)  # sequences of different lengths differ
    for i in range(size):
        joined += h[i:i + many] * _STEPS[i % len(_STEPS)] if size <= len(_STEPS) else mix(h[i:i + many] + np.uint64(i))
    return np.unique(mix(joined))


class Sketcher:
    """MinHash values, band keys and odd sketches of sets of 64-bit hashes."""

    def __init__(self, bands: int = 24, rows: int = 4, bits: int = 512):
        self.bands, self.rows, self.bits = bands, rows, bits
        n = np.arange(1, bands * rows + 1, dtype=np.uint64)
        self.factor = mix(n * _ODD) | np.uint64(1)
        self.plus = mix(n * _MIX)

    def minima(self, x: np.ndarray) -> np.ndarray:
        low = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for lo in range(0, len(x), 256):
            part = x[lo:lo + 256, None] * self.factor
            part += self.plus
            np.minimum(low, part.min(axis=0), out=low)
        return low

    def keys(self, low: np.ndarray) -> np.ndarray:
        """One 64-bit key a band, different bands apart."""
        return mix((low * self.factor).reshape(self.bands, self.rows).sum(axis=1) + self.factor[:self.bands])

    def sketch(self, low: np.ndarray) -> np.ndarray:
        """The coarse odd sketch."""
        return parity(mix(low + self.factor), self.bits)


def parity(values: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap in which each value flips one bit."""
    odd = np.bincount((values % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def halvings(n):
    """How often a set of ``n`` values is halved for its fine sketch: an array or a number."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / FINE_VALUES))).astype(np.int64)


def fine_sketches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fine odd sketch of a set, and that for comparison with sets that are halved once more (zeros
    where no set of similar size is)."""
    values, halved = mix(x + _MIX), int(halvings(len(x)))
    out = []
    for h in (halved, halved + 1):
        if h > halved and halvings(2 * len(x)) == halved:
            out.append(np.zeros(FINE_BITS // 64, "<u8"))
        else:
            out.append(parity(values[(values >> np.uint64(64 - h)) == 0] if h else values, FINE_BITS))
    return out[0], out[1]


def fine_bound(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """The most bits in which the fine sketches of linked sets of these sizes differ; -1 where the sizes forbid a link.

    Linked sets differ in at most (100 - percent) / (100 + percent) of their sizes' sum; of a sample of
    these, more than 6.5 deviations and 10 above the mean are not met in 1e-9 of cases."""
    differ = (n_a + n_b) * (100 - percent) // (100 + percent)
    h_a, h_b = halvings(n_a), halvings(n_b)
    halved = np.maximum(h_a, h_b)
    mean = differ / 2.0**halved
    bound = np.where(halved > 0, mean + 6.5 * np.sqrt(mean) + 10, differ)
    bound = np.where(np.abs(h_a - h_b) > 1, np.inf, bound)  # no sketches to compare: not ruled out
    return np.where(100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b), bound, -1)


def odd_bound(samples: int, percent: int, lost: float = 1e-8) -> int:
    """The least count of differing sketch bits that all but the share ``lost`` of pairs of ``percent``
    similarity keep to: each sample that differs flips at most two bits."""
    p, chance, differ = percent / 100, 0.0, samples
    while differ > 0:  # the chance that this many samples or more differ
        more = math.comb(samples, differ) * (1 - p) ** differ * p ** (samples - differ)
        if chance + more > lost:
            break
        chance, differ = chance + more, differ - 1
    return 2 * differ


def _text_key() -> Column:
    return F.md5(F.col("text").cast("string").cast("binary"))


def signatures(docs: DataFrame, shingle: int, sketcher: Sketcher) -> DataFrame:
    """``(doc_id, key, n, name, bands, odd)`` of every row: the text's hash, its set's size and 128-bit
    name, band keys and sketches, coarse and fine ones in one array (NULL for an empty set)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                n, name, bands, odd = [], [], [], []
                for t in some.column(0):
                    x = shingle_set(t.as_py(), shingle)
                    n.append(len(x))
                    if len(x):
                        low = sketcher.minima(x)
                        name.append(xxhash.xxh3_128_hexdigest(x.tobytes()))
                        bands.append(sketcher.keys(low).view(np.int64))
                        odd.append(np.concatenate([sketcher.sketch(low), *fine_sketches(x)]).view(np.int64))
                    else:
                        name.append(None), bands.append(None), odd.append(None)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[1:], pa.array(n, pa.int64()), pa.array(name, pa.string()), pa.array(bands, longs),
                     pa.array(odd, longs)], ["doc_id", "key", "n", "name", "bands", "odd"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("text").cast("string"), "doc_id", _text_key().alias("key")).mapInArrow(
        each, f"doc_id {kind}, key string, n long, name string, bands array<long>, odd array<long>")


def may_link(n_a: np.ndarray, odd_a: np.ndarray, n_b: np.ndarray, odd_b: np.ndarray, bits: int, bound: int, percent: int) -> np.ndarray:
    """Which pairs of matching rows (set sizes and sketches) are not ruled out by the sketches."""
    coarse, fine = bits // 64, FINE_BITS // 64
    limit = fine_bound(n_a, n_b, percent)
    out = np.zeros(len(n_a), bool)
    at = np.flatnonzero((limit >= 0) & (np.bitwise_count(odd_a[:, :coarse] ^ odd_b[:, :coarse]).sum(axis=1, dtype=np.int64) <= bound))
    if len(at):
        up = (halvings(n_b[at]) > halvings(n_a[at])).astype(np.int64), (halvings(n_a[at]) > halvings(n_b[at])).astype(np.int64)
        a, b = (np.take_along_axis(odd[at, coarse:].reshape(len(at), 2, fine), u[:, None, None], axis=1)[:, 0]
                for odd, u in zip((odd_a, odd_b), up))
        out[at] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= limit[at]
    return out


def _odd_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1)


def _close(pairs: DataFrame, nodes: DataFrame, test: Callable[..., np.ndarray]) -> DataFrame:
    """The ``pairs (u, v)`` that their sketches do not rule out."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                some = b.slice(lo, 2048)
                c = some.column
                near = pa.array(test(c(2).to_numpy(), _odd_matrix(c(3)), c(4).to_numpy(), _odd_matrix(c(5))))
                yield pa.RecordBatch.from_arrays([c(0).filter(near), c(1).filter(near)], ["u", "v"])

    u = nodes.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("odd").alias("odd_u"))
    v = nodes.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("odd").alias("odd_v"))
    return pairs.join(u, "u").join(v, "v").select("u", "v", "n_u", "odd_u", "n_v", "odd_v").mapInArrow(each, "u long, v long")


def blocks(buckets: DataFrame, block_rows: int) -> DataFrame:
    """``(g, second, alone, node, class)``: the nodes of ``buckets (b, node, class)`` that hold several classes,
    by pairs ``g`` of blocks that are to be compared: within it (``alone``), or first with second."""
    mark = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
    sizes = buckets.groupBy("b", "class").agg(F.count(F.lit(1)).alias("n"), mark.alias("mark"))
    whole = (sizes.groupBy("b").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("classes"), F.sum("mark").alias("mark"))
             .filter("classes > 1").groupBy("m", "mark").agg(F.min("b").alias("b")))  # one of those with equal nodes
    large = (F.col("n") > block_rows // 2) & (F.col("m") > block_rows)
    sizes = stored(sizes.join(whole.select("b", "m"), "b").select("b", "class", "n", F.when(large, F.col("class")).alias("own")), "sizes")
    parts = sizes.groupBy("b", "own").agg(F.ceil(F.sum("n") / F.lit(block_rows)).cast("int").alias("parts"))
    where = sizes.select("b", "class", "own").join(
        parts.select(F.col("b").alias("_b"), F.col("own").alias("_own"), "parts"),
        (F.col("b") == F.col("_b")) & F.col("own").eqNullSafe(F.col("_own"))).select("b", "class", "own", "parts")
    split = parts.select("b", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    one = split.withColumn("block", F.xxhash64("b", "own", "part"))  # one a bucket but for large ones
    two = one.select(F.col("b").alias("_b"), F.col("own").alias("_own"), F.col("block").alias("other"))
    same = F.coalesce(F.col("own") == F.col("_own"), F.lit(False))
    both = one.join(two, (F.col("b") == F.col("_b")) & (F.col("block") <= F.col("other")) & ~same)
    ends = both.select("b", F.xxhash64("block", "other").alias("g"), (F.col("block") == F.col("other")).alias("alone"), F.explode(
        F.array_distinct(F.array(F.struct(F.col("block"), F.lit(False).alias("second")),
                                 F.struct(F.col("other").alias("block"), (F.col("block") != F.col("other")).alias("second"))))).alias("e"))
    dealt = buckets.join(where, ["b", "class"]).select("node", "class", F.xxhash64(
        "b", "own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("block"))
    return dealt.join(ends.select("g", "alone", "e.block", "e.second"), "block").select("g", "second", "alone", "node", "class")


def compare_blocks(rows: DataFrame, nodes: DataFrame, test: Callable[..., np.ndarray]) -> DataFrame:
    """``(u, v)``, u < v: nodes of different classes in one group of ``blocks`` that pass ``test`` of sizes and sketches."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        g, second, alone, node, of, n = (t.column(c).to_numpy() for c in ("g", "second", "alone", "node", "class", "n"))
        odd = _odd_matrix(t.column("odd"))
        ends, at = np.searchsorted(g, g, side="right"), np.arange(len(g))
        for shift in range(1, len(g)):
            i = at[ends - at > shift]
            if not len(i):
                return
            i = i[(of[i] != of[i + shift]) & (alone[i] | (second[i] != second[i + shift]))]
            for lo in range(0, len(i), 4096):
                k = i[lo:lo + 4096]
                k = k[test(n[k], odd[k], n[k + shift], odd[k + shift])]
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[k], node[k + shift])),
                                                      pa.array(np.maximum(node[k], node[k + shift]))], ["u", "v"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None  # the rows of a group that may go on in the next batch
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                t = pa.Table.from_batches([b.slice(lo, 2048)])
                t = t if kept is None else pa.concat_tables([kept, t])
                g = t.column("g").to_numpy()
                cut = int(np.searchsorted(g, g[-1]))
                if cut:
                    yield from pairs(t.slice(0, cut))
                kept = t.slice(cut)
        if kept is not None:
            yield from pairs(kept)

    sketched = rows.join(nodes.select("node", "n", "odd"), "node").select("g", "second", "alone", "node", "class", "n", "odd")
    return sketched.repartition("g").sortWithinPartitions("g").mapInArrow(each, "u long, v long").distinct()


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, part_shingles: int = 100_000) -> DataFrame:
    """The ``pairs (u, v)`` of ``texts (node, n, text)`` with 100 * intersection >= ``percent`` * union of
    their shingle sets.  A node's partners are split where they have many shingles."""
    size = texts.select(F.col("node").alias("v"), "n")
    parts = pairs.join(size, "v").groupBy("u").agg((1 + F.floor(F.sum("n") / F.lit(part_shingles))).cast("int").alias("parts"))
    right = pairs.join(parts, "u").select("u", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), "v", F.lit(False).alias("own"))
    left = parts.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("u").alias("v"), F.lit(True).alias("own"))
    rows = left.unionByName(right).join(texts.select(F.col("node").alias("v"), "text"), "v").select("u", "part", "own", "v", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.empty(0, np.uint64)
        for b in batches:
            u, own, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            links = []
            for i in range(b.num_rows):
                x = shingle_set(b.column(4)[i].as_py(), shingle)
                if own[i]:
                    first = x
                    continue
                both = len(np.intersect1d(first, x, assume_unique=True))
                if 100 * both >= percent * (len(first) + len(x) - both):
                    links.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(u[links], pa.int64()), pa.array(v[links], pa.int64())], ["u", "v"])

    ordered = rows.repartition("u", "part").sortWithinPartitions("u", "part", F.desc("own"))
    return ordered.mapInArrow(each, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, bands: int = 24, rows: int = 4, bits: int = 512,
                    block_rows: int = 512) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs (doc_id, text)``: classes of
    texts linked by ``percent`` similarity of their sets of distinct shingles."""
    ship(docs.sparkSession)
    test = partial(may_link, bits=bits, bound=odd_bound(bands * rows, percent), percent=percent)
    signed = stored(signatures(docs, shingle, Sketcher(bands, rows, bits)), "signatures")
    named = signed.filter(F.col("name").isNotNull())
    nodes = stored(named.groupBy("name").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"),
                                             F.first("odd").alias("odd"), F.min("doc_id").alias("rep"))
                   .withColumn("node", F.monotonically_increasing_id()), "nodes")
    spread = nodes.select("node", F.explode("bands").alias("b"))
    lead = spread.groupBy("b").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    buckets = stored(spread.join(stored(lead, "leaders"), "b"), "buckets")
    ends = buckets.select("node", F.explode(F.array_distinct(F.array("least", "most"))).alias("u")).filter("node <> u")
    first = stored(_close(ends.select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct(), nodes, test), "pairs")
    # the texts of all nodes that have a candidate, one row each
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "n", "key")
    texts = stored(docs.select(_text_key().alias("key"), F.col("text").cast("string").alias("text")).join(wanted, "key")
                   .groupBy("node", "n").agg(F.min("text").alias("text")), "texts")
    links = stored(confirm(first, texts, shingle, percent), "links")
    classes = components(links)
    placed = buckets.join(classes.select(F.col("u").alias("node"), F.col("v").alias("class")), "node", "left")
    placed = stored(placed.select("b", "node", F.coalesce("class", "node").alias("class")), "placed")
    rest = stored(compare_blocks(blocks(placed, block_rows), nodes, test).join(first, ["u", "v"], "left_anti"), "pairs")
    more = confirm(rest, texts, shingle, percent)
    if not rest.isEmpty():
        # between classes: a link of their roots
        root = classes.withColumnRenamed("v", "root")
        over = (more.join(root.select(F.col("u"), F.col("root").alias("ru")), "u", "left")
                .join(root.select(F.col("u").alias("v"), F.col("root").alias("rv")), "v", "left")
                .select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")))
        higher = components(over).select(F.col("u").alias("v"), F.col("v").alias("top"))
        linked = classes.unionByName(higher.select(F.col("v").alias("u"), F.col("v")))
        classes = stored(linked.join(higher, "v", "left").select("u", F.coalesce("top", "v").alias("v")), "classes")
    root = F.coalesce("v", "node").alias("root")
    rooted = stored(nodes.select("name", "node", "rep").join(classes, F.col("node") == F.col("u"), "left").select("name", root, "rep"), "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = rooted.join(least, "root").select("name", "component_id")
    own = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return (signed.select("doc_id", "n", "name").join(final, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), own)
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
