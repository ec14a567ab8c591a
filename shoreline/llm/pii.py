"""Personal data: rules, and boosted trees over what lenient generators propose.

The base spans of each kind are those of strict patterns and checks.  Lenient generators
propose further spans, which may overlap: gradient-boosted trees over format and context
features score every proposal, and those above a threshold calibrated per kind, that touch no
base span, are added; of overlapping additions the better one stays.

The trees are fitted on a bounded sample of proposals, as many of each kind, labelled by whether a base span of the
kind covers them; the features leave out what the base rules check last (a leading plus,
the card checksum, the range of address parts), so the trees tell spans that look and stand
like personal data.  A proposal that has the base form itself but that the base rules passed over, since their leftmost match
ran on into its neighbour and failed, is neither an example nor a counterexample.
The threshold of a kind is the lowest score above which, among all proposals that the trees were
not fitted on, the share of base spans is at least ``precision``: by its lower confidence bound (Wilson's), or, for kinds
with few, by the share shrunk towards the bound of all kinds together, which counts as ``prior`` proposals.

DataFrame operations only; fitted trees become column expressions.  Defined cases: a NULL text
is an empty one, without spans; a NULL ``doc_id`` is a value like any other; repeated rows
get equal answers; equal scores go to the proposal that starts first, then the longer one,
then by kind as listed; an empty table gives an empty result and fits nothing; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoreline.llm.common import fresh_name, qcol, stored

#: fixed patterns of the base spans, by kind in their order
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: the same matches, found in linear time and without recursion on long runs: a match begins at the
#: start of a run of its first characters, or where the last match ended, and nothing is given back
SCANNED = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": BASE["phone"],
}
KINDS = list(BASE)
#: lenient proposals: pattern and the kinds that it may be
PROPOSALS = [
    (r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++\x20?(?:@|[(\[]at[)\]])\x20?[\p{L}0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[\p{L}0-9-]++)++", ["email"]),
    (r"[0-9]{1,4}(?:[.,][0-9]{1,4}){3}", ["ip"]),
    (r"\+?[(0-9][0-9()\x20./-]{5,28}[0-9]", ["card", "phone"]),
    # numbers written in groups, within a longer run of digits and marks
    (r"(?<![0-9+])\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", ["phone"]),
    (r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?![0-9])", ["card"]),
]
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """The check that a match of the base pattern must pass."""
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """All matches from the left, not overlapping: array of (s, e, m, before, after) in code
    points; ``before`` and ``after`` are the text up to 24 characters around."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(gaps, found, lambda g, m: F.struct(
        F.length(g).cast("long").alias("gap"), F.right(g, F.lit(24)).alias("before"), F.left(g, F.lit(24)).alias("lead"), m.alias("m")))
    empty = F.array().cast("array<struct<s:bigint,e:bigint,m:string,before:string,lead:string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["lead"].alias("lead"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def chunked(p: Column) -> Column:  # growing an array copies it, so it is grown in chunks
        chunk = lambda c: F.aggregate(F.slice(p, c * _CHUNK + 1, F.lit(_CHUNK)), start, add)
        last = F.floor((F.size(p) - 1) / _CHUNK).cast("int")
        return _let(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), chunk), shifted)

    def shifted(chunks: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        starts = F.aggregate(chunks, zero, lambda acc, c: F.struct(
            (acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, starts, lambda c, by: F.transform(c["out"], lambda x: F.struct(
            (x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["lead"].alias("lead")))))

    def finish(out: Column) -> Column:  # the text after a match begins the next part
        following = F.slice(out, 2, F.greatest(F.size(out) - 1, F.lit(0)))
        return F.zip_with(out, following, lambda x, y: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before"), y["lead"].alias("after")))

    return F.filter(_let(_let(parts, chunked), finish), lambda x: x["m"].isNotNull())


#: matches of a chunk
_CHUNK = 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _when_any(text: Column, needs: str, spans: Column, kind: str) -> Column:
    """``spans`` only for texts with a character that they need."""
    return F.when(text.rlike(needs), spans).otherwise(F.array().cast(kind))


_SPAN = "array<struct<kind:int,s:bigint,e:bigint>>"
_FEATURES = ["kind", "chars", "digits", "seps", "dots", "blanks", "dashes", "parens", "groups", "first_digit",
             "letter_before", "digit_before", "mark_before", "letter_after", "digit_after", "mark_after"]
_PROPOSAL = "array<struct<kind:int,s:bigint,e:bigint,f:array<double>,form:boolean>>"


def base_spans(text: Column) -> Column:
    parts = []
    for k, kind in enumerate(KINDS):
        good = F.filter(located(text, SCANNED[kind]), lambda x: valid(kind, x["m"]))  # noqa: B023
        spans = F.transform(good, lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))  # noqa: B023
        parts.append(_when_any(text, "@" if kind == "email" else "[0-9]", spans, _SPAN))
    return F.concat(*parts)


def features(kind: int, x: Column) -> Column:
    """Format and context of a proposal, in the order of ``_FEATURES``."""
    m = x["m"]
    count = lambda p: F.regexp_count(m, F.lit(p))
    flag = lambda c, p: F.coalesce(c.rlike(p), F.lit(False)).cast("double")
    body = F.regexp_replace(m, r"^\+", "")
    return F.array(*[c.cast("double") for c in (
        F.lit(kind), F.length(body), count("[0-9]"), F.regexp_count(body, F.lit("[^0-9]")), count(r"\."), count(r"\x20"), count("-"),
        count("[()]"), count("[0-9]+"), F.coalesce(F.regexp_extract(m, "([0-9])", 1).try_cast("double"), F.lit(-1.0)),
        flag(x["before"], r"\p{L}$"), flag(x["before"], "[0-9]$"), flag(x["before"], r"[^\p{L}0-9\s]$"),
        flag(x["after"], r"^\p{L}"), flag(x["after"], "^[0-9]"), flag(x["after"], r"^[^\p{L}0-9\s]"))])


def proposals(text: Column) -> Column:
    parts = []
    for pattern, kinds in PROPOSALS:
        for kind in kinds:
            k = KINDS.index(kind)
            spans = F.transform(located(text, pattern), lambda x: F.struct(  # noqa: B023
                F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), features(k, x).alias("f"),  # noqa: B023
                (x["m"].rlike(f"^(?:{SCANNED[kind]})$") & valid(kind, x["m"])).alias("form")))  # noqa: B023
            parts.append(_when_any(text, "@|at[)\\]]" if kind == "email" else "[0-9]", spans, _PROPOSAL))
    return F.concat(*parts)


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, proposed)``: spans of every row, without its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", base_spans(text).alias("base"), proposals(text).alias("proposed"))


@dataclass
class Model:
    """Column expressions: score of a proposal's features, and thresholds by kind."""

    trees: list
    thresholds: dict[int, float]

    def score(self, f: Column) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, limit, low, high = node
            return F.when(F.get(f, F.lit(feature)) <= limit, walk(low)).otherwise(walk(high))

        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + F.lit(weight) * walk(tree)
        return total


def _tree(node):
    """Nested (feature, limit, low, high), leaves as numbers."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    return (int(node.split().featureIndex()), float(node.split().threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def fit(scanned: DataFrame, sample: int = 20_000, trees: int = 12, depth: int = 3, precision: float = 0.98, confidence: float = 0.9) -> Model:
    """Boosted trees on at most ``sample`` proposals, a quarter of those of each kind or less;
    thresholds on all others."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    one = scanned.select("doc_id", "base", F.explode("proposed").alias("p"))
    covered = F.exists("base", lambda b: (b["kind"] == F.col("p.kind")) & (b["s"] <= F.col("p.e") - 1) & (F.col("p.s") <= b["e"] - 1))
    passed_over = F.col("p.form") & ~F.exists("base", lambda b: _touch(b, F.col("p")))
    luck = F.xxhash64("doc_id", "p.kind", "p.s", "p.e")
    one = one.filter(~passed_over)
    rows = one.select("p.f", F.col("p.kind").alias("kind"), covered.cast("double").alias("label"), luck.alias("h"))
    sizes = one.groupBy(F.col("p.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a kind
    if not sizes:
        return Model([], {})
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["kind"], min(0.25, sample / len(KINDS) / r["n"]))])
    drawn = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.element_at(share, F.col("kind"))
    order = ["h", "kind", "f", "label"]  # one hash may stand for many rows without an id
    learn = stored(rows.filter(drawn).orderBy(*order).limit(sample), "sample")
    if learn.select("label").distinct().count() < 2:
        return Model([], {})
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=11).fit(
        learn.orderBy(*order).select("label", array_to_vector("f").alias("features")))
    model = Model([(float(w), _tree(t._java_obj.rootNode())) for w, t in zip(fitted.treeWeights, fitted.trees)], {})
    model.thresholds.update(calibrate(rows.filter(~drawn).select("kind", "label", model.score(F.col("f")).alias("score")), precision, confidence))
    return model


def calibrate(scored: DataFrame, precision: float, confidence: float, prior: float = 20.0) -> dict[int, float]:
    """The threshold of each kind of ``scored (kind, label, score)``, in steps of 1/1024."""
    step = F.floor(F.col("score") * 1024) / F.lit(1024.0)
    steps = scored.groupBy("kind", step.alias("score")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    down = F.desc("score")
    of_kind = Window.partitionBy("kind").orderBy(down).rowsBetween(Window.unboundedPreceding, 0)
    of_all = Window.orderBy(down).rangeBetween(Window.unboundedPreceding, 0)  # few steps: trees give few scores
    sums = steps.select("kind", "score", *[F.sum(c).over(w).alias(c + tail) for c in ("good", "n") for w, tail in ((of_kind, ""), (of_all, "_all"))])
    z = NormalDist().inv_cdf(confidence)

    def bound(good: Column, n: Column) -> Column:
        p = good / n
        return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    shrunk = (F.col("good") + prior * bound(F.col("good_all"), F.col("n_all"))) / (F.col("n") + prior)
    enough = (bound(F.col("good"), F.col("n")) >= precision) | (shrunk >= precision)
    return {r["kind"]: r["least"] for r in sums.filter(enough).groupBy("kind").agg(F.min("score").alias("least")).collect()}


def _touch(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def select(scanned: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, base, added)`` with the additions of the model."""
    if not model.thresholds:
        return scanned.select("doc_id", "base", F.array().cast(_SPAN).alias("added"))
    least = F.create_map(*[F.lit(x) for kv in model.thresholds.items() for x in kv])
    scored = F.transform("proposed", lambda p: F.struct(
        p["kind"].alias("kind"), p["s"].alias("s"), p["e"].alias("e"), model.score(p["f"]).alias("score")))
    passed = scanned.select("doc_id", "base", F.filter(scored, lambda p: p["score"] >= F.element_at(least, p["kind"])).alias("passed"))
    # most are base spans themselves: those go by hash before any span is held against another
    plain = lambda p: F.struct(p["kind"].alias("kind"), p["s"].alias("s"), p["e"].alias("e"))
    new = passed.withColumn("new", F.array_except(F.transform("passed", plain), F.col("base")))
    good = F.filter("passed", lambda p: F.array_contains("new", plain(p)) & ~F.exists("base", lambda b: _touch(b, p)))
    # two generators may propose the same span
    rows = new.select("doc_id", "base", F.when(F.size("new") > 0, F.array_distinct(good)).otherwise(F.slice("passed", 1, 0)).alias("good"))
    better = lambda q, p: F.struct(-q["score"], q["s"], -q["e"], q["kind"]) < F.struct(-p["score"], p["s"], -p["e"], p["kind"])
    alone = F.filter("good", lambda p: ~F.exists("good", lambda q: _touch(p, q) & better(q, p)))
    return rows.select("doc_id", "base", F.transform(alone, lambda p: F.struct(p["kind"], p["s"], p["e"])).cast(_SPAN).alias("added"))


def find(docs: DataFrame, **how) -> DataFrame:
    """``(doc_id, base, added)``: arrays of (kind, s, e), kind as an index of ``KINDS``."""
    scanned = stored(scan(docs), "scanned")
    return select(scanned, fit(scanned, **how))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``."""
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[n(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
                        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        listed(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; rows are matched by
    ``doc_id``, which must be unique."""
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def add(acc: Column, x: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")),
                         F.lit("["), F.get(names, x["kind"]), F.lit("]"))
        free = x["s"] >= acc["at"]
        return F.struct(F.when(free, piece).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], -x["e"]).alias("at"))

    own, all_ = fresh_name(docs, "_id"), fresh_name(docs, "_spans")
    joined = docs.join(found.select(F.col("doc_id").alias(own), spans.alias(all_)), F.col("doc_id").eqNullSafe(F.col(own)), "left")
    tail = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    text = F.when(F.size(all_) > 0, F.aggregate(all_, start, add, tail)).otherwise(F.col("text"))
    return joined.select(*[text.alias("text") if c == "text" else qcol(c) for c in docs.columns])
