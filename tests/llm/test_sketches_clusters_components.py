"""Odd sketches, bisector clustering and exact whitening against brute force, and on odd rows."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoreline.llm import clustering, common, oddsketch, queries, whitening

SF = "/root/testdata/sf0.001"


# --- odd sketches

def plain_set(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_classes(rows, percent=85):
    """(doc_id, set size, class, kept) of (doc_id, text) rows."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    found = [least.get(find(i)) for i in range(len(rows))]
    return Counter((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, found))


def classes(df, **how):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in oddsketch.near_duplicates(df, **how).collect())


def frame(spark, rows):
    clash = ["key", "n", "name", "bands", "odd", "node", "b", "u", "v", "class", "component_id", "kept"]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash)
    return spark.createDataFrame([(*r, *["x"] * len(clash)) for r in rows], schema)


def altered(rng, words, share):
    words = list(words)
    for i in rng.choice(len(words), int(round(share * len(words))), replace=False):
        words[i] = f"w{rng.integers(1 << 40)}"
    return " ".join(words)


def test_near_duplicates_of_the_documents(spark):
    docs = common.table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = queries.op11_minhash_near_dedup(spark, SF).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found) == plain_classes(rows)


def test_near_duplicates_of_odd_rows(spark):
    long = "palabra y otra " * 40_000
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "One  two"), (7, "one two three"), (8, long),
            (9, long), (9, long), (None, "no id here at all"), (None, "no id here at all"), (None, "no id HERE at all "), (10, "no id here at all"),
            (None, "nobody names this text"), (11, "ünï wörter"), (12, "ÜNÏ wörter"), (3, "three two one zero")]
    assert classes(frame(spark, rows)) == plain_classes(rows)
    assert classes(frame(spark, rows).limit(0)) == Counter()


def test_groups_of_near_copies_and_borderline_pairs(spark):
    # a dense group, chains, pairs on both sides of the bound; blocks of 4 nodes, so groups are cut up
    rng = np.random.default_rng(5)
    rows = []
    for share, many in ((0.004, 60), (0.02, 25), (0.03, 25), (0.06, 25)):
        base = [f"w{rng.integers(1 << 40)}" for _ in range(250)]
        rows += [(len(rows) + i, altered(rng, base, share)) for i in range(many)]
    chain = [f"c{i}" for i in range(300)]
    rows += [(len(rows) + i, " ".join(chain[8 * i:8 * i + 150])) for i in range(15)]
    rng.shuffle(rows)
    rows = [(int(d), str(t)) for d, t in rows]
    expect = plain_classes(rows)
    assert 20 < sum(n for (_, _, _, kept), n in expect.items() if kept) < len(rows) - 60
    assert classes(frame(spark, rows), block_rows=4) == expect
    assert classes(frame(spark, rows)) == expect


def test_blocks_pair_every_two_nodes_of_different_classes(spark):
    rng = np.random.default_rng(2)
    members = [(1, n, 0 if n < 30 else 100 + n % 5) for n in range(50)] + [(2, n, n) for n in range(3)] + [(3, n, 7) for n in range(9)]
    members += [(4, n, c) for b, n, c in members if b == 1]  # equal nodes: compared once
    buckets = spark.createDataFrame(members, "b long, node long, class long")
    nodes = spark.createDataFrame([(n, n, [int(rng.integers(1 << 60))]) for n in range(50)], "node long, n long, odd array<long>")
    all_of_them = lambda n_a, odd_a, n_b, odd_b: np.ones(len(n_a), bool)
    got = {(r["u"], r["v"]) for r in oddsketch.compare_blocks(oddsketch.blocks(buckets, 6), nodes, all_of_them).collect()}
    assert got == {(m, n) for b, m, c in members for a, n, d in members if a == b and m < n and c != d}
    groups = oddsketch.blocks(buckets, 6)
    assert groups.select("g").distinct().count() == groups.filter("not second").select("g").distinct().count()
    assert groups.groupBy("g").count().agg(F.max("count")).first()[0] <= 40  # hashes deal blocks, so two of 6 may be larger


def plain_words(text):
    return [w.lower() for w in text.encode().split()]


def test_word_hashes_tell_words_apart_and_nothing_else(monkeypatch):
    text = "A b a\tB\x0bäÄ ab ba aab " + "long" * 40 + "  x" * 500 + " " + "y" * 3000 + "\n"
    h = oddsketch.word_hashes(text.encode())
    words = plain_words(text)
    assert len(h) == len(words) and len(set(zip(h.tolist(), words))) == len(set(h.tolist())) == len(set(words))
    for part in (1, 7, 100):
        monkeypatch.setattr(oddsketch, "_PART", part)
        assert np.array_equal(h, oddsketch.word_hashes(text.encode()))
    assert len(oddsketch.word_hashes(b" \n ")) == 0 == len(oddsketch.shingle_set(None, 3))
    assert len({int(oddsketch.shingle_set(t, 3)[0]) for t in ("a", "a b", "a b c", "b a c", "ab", "a a")}) == 6


@pytest.mark.parametrize("n", [3, 400, 2000, 2040, 5000, 20_000])
def test_sketches_never_rule_out_linked_sets(n):
    rng = np.random.default_rng(n)
    s, bound = oddsketch.Sketcher(), oddsketch.odd_bound(96, 85)
    ruled_out = 0
    for trial in range(60):
        size = int(n * rng.uniform(0.9, 1.1)) + 1
        both = rng.integers(1 << 63, size=size, dtype=np.uint64)
        more = int(size * 15 / 85 * (trial % 2 or rng.uniform(0.2, 1)))
        cut = rng.integers(0, more + 1)
        own = rng.integers(1 << 63, size=more, dtype=np.uint64)
        pair = [np.unique(np.concatenate([both, own[:cut]])), np.unique(np.concatenate([both, own[cut:]]))]
        linked = 100 * len(both) >= 85 * (len(both) + more)
        far = np.unique(np.concatenate([both, rng.integers(1 << 63, size=int(size * 0.5) + 1, dtype=np.uint64)]))
        args = lambda x: (np.array([len(x)]), np.concatenate([s.sketch(s.minima(x)), *oddsketch.fine_sketches(x)])[None])
        ask = lambda a, b: bool(oddsketch.may_link(*args(a), *args(b), 512, bound, 85)[0])
        assert not linked or (ask(*pair) and ask(*pair[::-1]))
        ruled_out += not ask(pair[0], far)
    assert ruled_out == 60


# --- clustering

def plain_clusters(rows, k=8, rounds=10, dims=64):
    rows = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    if not rows:
        return Counter()
    x = [v for _, v in rows]
    hashed = [(i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in rows]
    c = [v for *_, v in sorted(hashed)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        best = [near(v)[1] for v in x]
        for j in range(len(c)):
            mine = [v for v, b in zip(x, best) if b == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(i, *near(v)) for i, v in rows]
    total = Counter()
    for _, d, j in out:
        total[j] += d
    return Counter((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
                   for i, d, j in out)


def clusters(df, **how):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return Counter(tuple(r[n] for n in names) for r in clustering.cluster(df, **how).collect())


VECTORS = "vec_id long, embedding array<float>, x string, cluster string, distance string"


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS.replace("float", kind))


def test_clusters_of_the_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in common.table(spark, SF, "embeddings").collect()]
    found = queries.op12_centroid_clustering(spark, SF)
    assert Counter(tuple(r[n] for n in ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
                   for r in found.collect()) == plain_clusters(rows)


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 3, 4).astype(float).tolist()) for i in range(40)]
    rows += [(40, None), (41, []), (42, [1.0, None, 0.0, 0.0]), (43, [1.0, float("nan"), 0.0, 0.0]), (44, [float("inf")] * 4), (45, [1.0] * 5),
             (None, [0.5, 0.25, 0.0, -1.0]), (None, [0.5, 0.25, 0.0, -1.0]), (7, [2.0, 2.0, 2.0, 2.0]), (7, [2.0, 2.0, 2.0, 2.0])]
    assert clusters(vectors(spark, rows), dims=4) == plain_clusters(rows, dims=4)
    few = rows[:3] + rows[:1]  # fewer vectors than centroids, and a repeated row
    assert clusters(vectors(spark, few), dims=4) == plain_clusters(few, dims=4)
    assert clusters(vectors(spark, rows).limit(0), dims=4) == Counter()
    assert clusters(vectors(spark, rows[40:46]), dims=4) == Counter()
    beyond = [(0, [1e30, 0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0])]
    assert {r[0]: r[1:3] for r in clusters(vectors(spark, beyond), dims=4)} == {0: (None, None), 1: (0, 0)}


def test_sign_tests_find_the_nearest_at_the_largest_components():
    rng = np.random.default_rng(6)
    top = clustering.MOST
    c = rng.integers(-top, top, (9, 64))
    c[5] = c[2]
    x = np.concatenate([rng.integers(-top, top, (200, 64)), c, (c[:4] + c[1:5]) // 2, np.full((1, 64), top), np.full((1, 64), -top)])
    expect = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))[1] for v in x]
    assert clustering.winners(x, *clustering.bisectors(c)).tolist() == expect


# --- whitening

def plain_whitening(rows, k=16):
    x = np.array([np.floor(64 * np.array(v, float)) + 1_000_000 for v in rows])
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    e, q = np.linalg.eigh(centred.T @ centred / len(fit))
    e, q = e[::-1], q[:, ::-1]
    return x, fit, e, q, ((x - fit.mean(axis=0)) @ q[:, :k]) / np.sqrt(np.maximum(e[:k], 1e-300))


def test_whitened_embeddings(spark):
    rows = {r["vec_id"]: r["embedding"] for r in common.table(spark, SF, "embeddings").collect()}
    got = queries.op13_whitening(spark, SF).toPandas()
    assert len(got) == 16 * len(rows) and (got["n"] == len({tuple(np.floor(64 * np.array(v, float))) for v in rows.values()})).all()
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    x, fit, e, _, expect = plain_whitening(list(rows.values()))
    found = got.pivot(index="vec_id", columns="component", values="whitened").loc[list(rows)].to_numpy()
    assert np.abs(found * np.sign((found * expect).sum(axis=0)) - expect).max() < 1e-7
    assert np.abs(got.groupby("component")["explained"].first().to_numpy() / (e[:16] / e.sum()) - 1).max() < 1e-9
    n, total = len(fit), [int(s) for s in fit.sum(axis=0)]
    deviation = got[got["component"] == 1].set_index("vec_id")["deviation"]
    for i, v in zip(rows, x):
        assert deviation[i] == sum((n * int(a) - s) ** 2 for a, s in zip(v, total))


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(9)
    good = [(i, [float(a), float(b), float(a) + 2 * float(b), 3.0]) for i, (a, b) in enumerate(rng.integers(-9, 9, (30, 2)))]  # rank 2
    bad = [(90, None), (91, []), (92, [1.0, None, 1.0, 3.0]), (93, [float("nan")] * 4), (94, [float("-inf"), 0.0, 0.0, 0.0]), (95, [1.0, 2.0]),
           (96, [1e30, 0.0, 0.0, 0.0])]
    odd = [*good, *bad, (None, good[0][1]), (3, good[3][1]), (3, good[4][1])]
    got = whitening.whiten(vectors(spark, odd)).toPandas()
    kept = [v for i, v in odd if i not in range(90, 97)]
    assert sorted(got["component"].unique()) == [1, 2] and len(got) == 2 * len(kept)
    assert got["vec_id"].isna().sum() == 2 and got["identity_error"].iloc[0] < 1e-10
    x, fit, e, _, expect = plain_whitening(kept, 2)
    assert (got["n"] == len(fit)).all()
    for c in (1, 2):
        found = np.sort(np.abs(got[got["component"] == c]["whitened"]))
        assert np.abs(found - np.sort(np.abs(expect[:, c - 1]))).max() < 1e-9
    assert whitening.whiten(vectors(spark, odd).limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).count() == 0
    large = [(i, [float(v) * 1e8 for v in rng.normal(size=3)]) for i in range(20)]
    wide = whitening.whiten(vectors(spark, large, "double")).toPandas()
    assert wide["deviation"].isna().all() and wide["identity_error"].iloc[0] < 1e-6


def test_repeated_eigenvalues_have_orthonormal_components(spark):
    # the corners of a cube: one eigenvalue of multiplicity 3
    corners = [(i, [float(i >> b & 1) for b in range(3)]) for i in range(8)]
    got = whitening.whiten(vectors(spark, corners)).toPandas()
    assert sorted(got["component"].unique()) == [1, 2, 3] and got["identity_error"].iloc[0] < 1e-12
    assert np.allclose(got["explained"], 1 / 3, rtol=1e-12)


def test_characteristic_polynomial_is_exact(spark):
    rng = np.random.default_rng(10)
    for d, rank, size in ((1, 1, 5), (4, 4, 9), (6, 3, 1 << 20), (7, 7, 1 << 30)):
        a = rng.integers(-size, size, (d, rank)).astype(object)
        m = a @ a.T
        m[0] = m[0] * 1  # Python integers
        # Faddeev and LeVerrier in fractions
        expect, b = [Fraction(1)], np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
        for k in range(1, d + 1):
            b = m @ b if k == 1 else m @ (b + expect[-1] * np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object))
            expect.append(-sum(b[i, i] for i in range(d)) / k)
        assert whitening.characteristic_polynomial(spark, m) == [int(c) for c in reversed(expect)]


@pytest.mark.parametrize("roots", [[0, 0, 3, 3, 3, 100], [1, 2, 3, 4, 5], [0], [7, 7], [0, 1, 1 << 60, (1 << 60) + 1]])
def test_roots_are_counted_and_isolated(roots):
    poly = [1]
    for r in roots:
        poly = [(poly[i - 1] if i else 0) - r * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    for a in {0, *roots, *(r - 1 for r in roots if r)}:
        assert whitening.roots_beyond(poly, a) == sum(r > a for r in roots)
    for number, r in enumerate(sorted(roots, reverse=True), 1):
        a, bits, above, many = whitening.isolate(poly, number, sum(roots))
        assert abs(Fraction(a, 1 << bits) - r) <= Fraction(1, 1 << bits) and bits + sum(roots).bit_length() >= whitening.PRECISION - 1
        assert above == sum(x > r for x in roots) and many == roots.count(r)
