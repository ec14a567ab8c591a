"""Language identification by prediction by partial matching (PPM).

Per language, a context tree of byte contexts of up to ``order`` bytes holds frozen
counts; a byte is coded in its longest known context, escaping (method C, with exclusion)
to shorter ones.  The language with the shortest code of the whole text is predicted.

Only the model is fitted on a bounded sample: for each language the texts of smallest
hash (of a hash), at most ``sample_rows`` and ``sample_bytes``, of rows that may be learned from; a long text
gives spread windows of at most a twentieth of ``sample_bytes``, so every labelled language is learned.  The
trees of all languages share one table of contexts (at most ``max_contexts``, the most
frequent; None: all), in which each cell holds the exact code length of a byte after a context per
language, so that scoring a text is a few array look-ups a byte.  Texts are scored whole, in
windows of ``_CHUNK`` bytes that carry their contexts on: memory is bounded whatever the rows'
number or length.

Defined cases: a text that is NULL, empty or has no letter gets ``und`` with score 0, and
so does every text if nothing can be learned (empty table, no labels); a NULL ``doc_id``
is not held out and never learned from; repeated rows get equal answers; ties go to the
first language by code point; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoreline.llm.common import TEXT_ROWS, fresh_name, qcol, release_memory, ship, stored

UND = "und"
#: bytes scored at once
_CHUNK = 1 << 17


@dataclass
class Ppm:
    """``child[context, class]``: the context one class longer, or the last row for none;
    ``bits[context * classes + class]``: code lengths by language; ``classes`` of bytes."""

    langs: list[str]
    order: int
    byte_class: np.ndarray
    child: np.ndarray
    bits: np.ndarray


def train(samples: dict[str, list[bytes]], order: int = 3, max_contexts: int | None = 16384) -> Ppm | None:
    """Fit the trees on ``samples``: texts by language."""
    langs = sorted(k for k, v in samples.items() if any(v))
    if not langs:
        return None
    joined = {k: np.frombuffer(b"\n" + b"\n".join(samples[k]), np.uint8) for k in langs}
    seen = np.zeros(256, bool)
    for x in joined.values():
        seen[x] = True
    byte_class = np.where(seen, np.cumsum(seen), 0).astype(np.int64)  # 0: any other byte
    width = int(seen.sum()) + 1
    grams: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []
    for k in range(1, order + 2):
        grams.append({})
        for name, x in joined.items():
            c, code = byte_class[x], 0
            for j in range(k):
                code = code * width + c[j:len(c) - k + 1 + j]
            grams[-1][name] = np.unique(code, return_counts=True)
    # contexts of all languages: those seen often enough for the table to fit
    totals = []
    for k in range(order):
        codes, where = np.unique(np.concatenate([v[0] for v in grams[k].values()]), return_inverse=True)
        totals.append((codes, np.bincount(where, np.concatenate([v[1] for v in grams[k].values()]))))
    least = 2 if max_contexts else 1
    while max_contexts and 1 + sum(int((n >= least).sum()) for _, n in totals) > max_contexts:
        least += 1
    known = [c[n >= least] for c, n in totals]
    first = np.cumsum([1, *map(len, known)])
    none = int(first[-1])  # also the number of contexts
    depth = np.zeros(none, np.int64)
    shorter = np.zeros(none, np.int64)
    child = np.full((none + 1, width), none, np.int32)

    def place(codes: np.ndarray, k: int) -> np.ndarray:
        """Contexts of length k by code; ``none`` where unknown."""
        if k == 0:
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(known[k - 1], codes), len(known[k - 1]) - 1)
        return np.where(known[k - 1][at] == codes, first[k - 1] + at, none) if len(known[k - 1]) else np.full(len(codes), none)

    for k in range(1, order + 1):
        ids = np.arange(first[k - 1], first[k])
        depth[ids] = k
        shorter[ids] = place(known[k - 1] % width ** (k - 1), k - 1)
        over = place(known[k - 1] // width, k - 1)
        child[over, known[k - 1] % width] = ids
    child[none] = none
    shorter[shorter == none] = 0
    others = 256 - (width - 1)
    bits = np.empty((none, width, len(langs)), np.float32)
    for n, name in enumerate(langs):
        counts = np.zeros((none, width), np.int32)
        for k in range(order + 1):
            codes, found = grams[k][name]
            at = place(codes // width, k)
            ok = at < none
            counts[at[ok], (codes % width)[ok]] = found[ok]
        for lo in range(0, none, 2048):
            at = np.arange(lo, min(lo + 2048, none))
            out = np.zeros((len(at), width), np.float64)
            escape = np.zeros((len(at), 1))
            left = np.ones((len(at), width), bool)
            for _ in range(order + 1):
                c = np.where(left, counts[at], 0)
                total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
                whole = np.maximum(total + kinds, 1)
                hit = c > 0
                out = np.where(hit, escape - np.log2(np.maximum(c, 1) / whole), out)
                escape = escape + np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / whole), 0)
                left &= ~hit
                root = at == 0
                at = shorter[at]
                if root.all():
                    break
            rest = np.where(left[:, 1:], 1, 0).sum(axis=1, keepdims=True) + others
            out = np.where(left, escape + np.log2(np.maximum(rest, 1)), out)
            bits[lo:lo + len(out), :, n] = out
    return Ppm(langs, order, byte_class, child.reshape(-1), bits.reshape(none * width, len(langs)))


def code_lengths(model: Ppm, texts: list[bytes]) -> np.ndarray:
    """Bits of every text under every language: array (texts, languages)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return scored(model, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))


def scored(model: Ppm, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bits of the texts ``raw[starts[i]:starts[i + 1]]``, each coded as if after a line break."""
    width = int(model.byte_class.max()) + 1
    none = model.bits.shape[0] // width
    total = np.zeros((len(starts) - 1, len(model.langs)))
    filled = np.flatnonzero(np.diff(starts))  # texts of some length, each with its own first byte
    firsts = starts[filled]
    line = int(model.child[model.byte_class[10]])  # the context of a line break
    before_first = line if line < none else 0
    carry: list[int] = [none] * model.order
    carried = 0
    for lo in range(int(starts[0]), int(starts[-1]), _CHUNK):
        c = model.byte_class[raw[lo:min(lo + _CHUNK, int(starts[-1]))]]
        some = slice(*np.searchsorted(firsts, [lo, lo + len(c)]))
        heads = firsts[some] - lo
        context = np.zeros(len(c), np.int64)
        node = model.child[c].astype(np.int64)  # contexts of one byte
        for k in range(model.order):
            if k:
                longer = np.empty(len(c), np.int64)
                longer[1:] = model.child[node[:-1] * width + c[1:]]
                longer[0] = model.child[carry[k - 1] * width + c[0]]
                longer[heads] = model.child[(line if k == 1 else none) * width + c[heads]]
                carry[k - 1], node = int(node[-1]), longer
            np.copyto(context, node, where=node < none)
        carry[-1] = int(node[-1])
        before = np.empty(len(c), np.int64)
        before[1:], before[0] = context[:-1], carried
        before[heads] = before_first
        carried = int(context[-1])
        before *= width
        before += c
        cuts = np.concatenate([[0], heads[heads > 0]]).astype(np.int64)
        doc = filled[int(np.searchsorted(firsts, lo, side="right")) - 1:some.stop]
        for n in range(model.bits.shape[1]):
            total[doc, n] += np.add.reduceat(model.bits[:, n][before], cuts, dtype=np.float64)
    return total


def may_learn(doc_id: Column) -> Column:
    """Documents of which crc32(doc_id as text) mod 4 is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def excerpt(text: Column, most: int, windows: int = 8) -> Column:
    """A text, or ``windows`` spread parts of one of over ``most`` characters, of that length together."""
    part = max(1, most // windows)
    step = (F.length(text) - F.lit(part)) / F.lit(float(windows - 1))
    spread = [F.substring(text, (F.floor(step * i) + 1).cast("int"), F.lit(part)) for i in range(windows)]
    return F.when(F.length(text) > most, F.concat_ws("\n", *spread)).otherwise(text)


def sample(docs: DataFrame, learn: Column, sample_rows: int, sample_bytes: int) -> dict[str, list[bytes]]:
    """Excerpts of distinct texts of smallest hash by language, within both bounds."""
    most = max(8, sample_bytes // 20)
    labelled = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    size = F.least(F.octet_length("text"), F.lit(most))
    sizes = stored(labelled.groupBy("lang", "h").agg(F.max(size).alias("size")), "sizes")
    # far more than enough of the smallest hashes, so that no language is ranked whole in one task
    luck = F.shiftrightunsigned(F.xxhash64("h"), 11) / F.lit(float(1 << 53))
    share = sizes.groupBy("lang").agg((F.lit(4.0 * sample_rows + 100) / F.count(F.lit(1))).alias("share"))
    few = sizes.join(F.broadcast(share), "lang").filter(luck < F.col("share")).withColumn("luck", luck)  # a row a language
    ranked = (few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("luck", "h")))
              .filter(F.col("n") <= sample_rows))
    before = Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    # the last one may overrun the bound, and is cut below
    chosen = ranked.withColumn("used", F.coalesce(F.sum("size").over(before), F.lit(0))).filter(F.col("used") < sample_bytes)
    texts = (labelled.join(F.broadcast(chosen.select("lang", "h", "n")), ["lang", "h"])  # sample_rows a language
             .groupBy("lang", "n").agg(F.min(excerpt(F.col("text"), most)).alias("text")).collect())
    out: dict[str, list[bytes]] = {}
    room: dict[str, int] = {}
    for r in sorted(texts, key=lambda r: (r["lang"], r["n"])):
        t = r["text"].encode()[:room.setdefault(r["lang"], sample_bytes)]
        room[r["lang"]] -= len(t)
        out.setdefault(r["lang"], []).append(t)
    return out


def _text_slices(column: pa.Array, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``rows`` rows and, but for single texts, ``_CHUNK`` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    lo = 0
    while lo < len(sizes):
        upto = np.cumsum(sizes[lo:lo + rows], dtype=np.int64)
        hi = lo + max(1, int(np.searchsorted(upto, _CHUNK, side="right")))
        yield lo, hi
        lo = hi


def judge_texts(model: Ppm | None, column: pa.Array) -> tuple[list[str], list[float], list[float]]:
    """Language, posterior probability and bits a byte of every text; ``und``, 0 and 0 without a letter."""
    pred, score, rate = [UND] * len(column), [0.0] * len(column), [0.0] * len(column)
    for lo, hi in _text_slices(column) if model else ():
        texts, lettered = [], []
        for n in range(lo, hi):
            t = column[n].as_py()
            if t and any(map(str.isalpha, t)):
                lettered.append(n)
                texts.append(t.encode())
        if not lettered:
            continue
        bits = code_lengths(model, texts)
        low = bits.min(axis=1)
        post = 1 / np.exp2(-(bits - low[:, None])).sum(axis=1)
        for n, k, p, b, t in zip(lettered, bits.argmin(axis=1), post, low, texts):
            pred[n], score[n], rate[n] = model.langs[k], float(p), float(b) / len(t)
    return pred, score, rate


def identify(docs: DataFrame, learn: Column | None = None, order: int = 3, max_contexts: int | None = 16384,
             sample_rows: int = 400, sample_bytes: int = 300_000, keep: list[str] | None = None,
             names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, bits_per_byte)`` for every row of ``docs (doc_id, text, lang)``.

    ``learn`` tells which rows the model may be fitted on (default: ``may_learn``);
    ``score`` is the posterior probability of the predicted language, ``bits_per_byte`` the text's
    code length under it, 0 for ``und``.  With ``keep``, these columns of ``docs`` come instead of the first two;
    ``names`` are those of the last three.
    """
    ship(docs.sparkSession)
    learn = may_learn(F.col("doc_id")) if learn is None else learn
    model = train(sample(docs, learn, sample_rows, sample_bytes), order, max_contexts)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_contexts
    # carried columns go by place, as their names may be any; a text that is carried goes once
    carried = [F.col("doc_id"), held] if keep is None else [qcol(c) for c in keep]
    called = ["doc_id", "held_out"] if keep is None else list(keep)
    at = called.index("text") if "text" in called and docs.schema["text"].dataType == T.StringType() else len(carried)
    extra = [F.col("text").cast("string")] if at == len(carried) else []
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate([*carried, *extra])])
    schema = T.StructType([*rows.schema.fields[:len(carried)], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    out = schema.names

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, rate = judge_texts(shipped.value, b.column(at))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(out) - 3], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], out)
        release_memory()

    return rows.mapInArrow(each, schema).toDF(*called, *names)


def rate_bounds(rated: DataFrame, quantiles: tuple[float, float] = (0.5, 0.95), times: float = 10.0, steps: int = 64,
                min_rows: int = 20) -> DataFrame:
    """``(lang, bound)``: the most bits a byte of texts of each language, from ``rated (lang, rate)``: the
    upper quantile and ``times`` its distance from the lower one, but at most the 8 of raw bytes.  One count a language and
    step of a ``steps``-th bit goes over the network; languages of under ``min_rows`` rows share the
    counts of all."""
    step = F.ceil(F.col("rate") * steps).cast("long")
    counts = rated.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    both = counts.unionByName(counts.groupBy("step").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")))
    upto = Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    share = both.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    low, high = (F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("step"))) / F.lit(float(steps)) for q in quantiles)
    bounds = share.groupBy("lang").agg(F.least(F.lit(8.0), high + F.lit(times) * (high - low)).alias("bound"), F.max("all").alias("rows"))
    every = bounds.filter(F.col("lang").isNull()).select(F.max("bound")).scalar()
    few = F.col("rows") < min_rows
    return bounds.filter(F.col("lang").isNotNull()).select("lang", F.when(few, F.greatest("bound", every)).otherwise(F.col("bound")).alias("bound"))


def keep_identified(docs: DataFrame, min_score: float = 0.5, learn: Column | None = None, slack_bytes: int = 64, **how) -> DataFrame:
    """The rows of ``docs`` whose language is predicted with at least ``min_score`` and whose text is
    coded about as short as texts of that language are; a missing ``lang`` is filled in.

    The bits a byte of a text may exceed the bound of its language (``rate_bounds``, over all
    labelled rows that may be learned from and are predicted as labelled) by as much as ``slack_bytes`` bytes of
    eight bits make up, so short texts are only judged by their score.
    """
    learn = may_learn(F.col("doc_id")) if learn is None else learn
    pred, score, rate = (fresh_name(docs, c) for c in ("lang_pred", "score", "bits_per_byte"))
    own = fresh_name(docs, "_learn")
    marked = docs.withColumn(own, learn)
    scored_rows = stored(identify(marked, learn, keep=marked.columns, names=(pred, score, rate), **how), "identified", TEXT_ROWS)
    labelled = scored_rows.filter(qcol(own) & (F.col("lang").cast("string") == qcol(pred)) & (F.octet_length("text") >= 4 * slack_bytes))
    bounds = rate_bounds(labelled.select(qcol(pred).alias("lang"), qcol(rate).alias("rate")))
    limit = bounds.select(F.col("lang").alias("_limit_of"), F.col("bound").alias("_limit"))
    joined = scored_rows.join(F.broadcast(limit), qcol(pred) == F.col("_limit_of"), "left")  # a row a learned language
    size = F.octet_length(F.col("text").cast("string"))
    short = qcol(rate) * size <= F.coalesce("_limit", F.lit(8.0)) * size + F.lit(8.0 * slack_bytes)
    lang = F.coalesce(F.col("lang"), qcol(pred).cast(docs.schema["lang"].dataType)).alias("lang")
    return (joined.filter((qcol(pred) != UND) & (qcol(score) >= min_score) & short)
            .select(*[lang if c == "lang" else qcol(c) for c in docs.columns]))
