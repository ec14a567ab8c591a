"""Neighbours of repeated ids, PII that the base rules pass over."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoreline.llm import ann, common, pii
from test_llm_operators import frame, plain_spans

SF = "/root/testdata/sf0.001"


def plain_neighbours(rows, queries, k):
    out = {}
    for q in queries:
        best = {}
        for a in [v for i, v in rows if i == q]:
            for i, v in rows:
                if i != q:
                    a_, v_ = np.array(a, float), np.array(v, float)
                    best[i] = max(best.get(i, -2), float(a_ @ v_ / np.sqrt((a_ @ a_) * (v_ @ v_))))
        out[q] = sorted(best, key=lambda i: (-best[i], i))[:k]
    return out


@pytest.mark.parametrize("how", [{}, {"block_rows": 4}, {"bucket_rows": 2, "block_rows": 8}])
def test_an_id_on_many_vectors_takes_one_place(spark, how):
    rng = np.random.default_rng(1)
    near = [1.0, 0.0, 0.0, 0.0]
    rows = [(0, near)] + [(1, [1.0, 0.001 * i, 0.0, 0.0]) for i in range(1, 9)]
    rows += [(2 + i, rng.normal(size=4).tolist()) for i in range(20)] + [(50, [0.5, 0.5, 0.0, 0.1]), (50, [0.1, 0.0, 0.9, 0.0]), (100, near)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df, F.col("vec_id") % 50 == 0, 5, share=1.0, **how).collect()
    expect = plain_neighbours(rows, [0, 50, 100], 5)
    got = {q: [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] for q in expect}
    assert got == expect
    assert all([r["rank"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == [1, 2, 3, 4, 5] for q in expect)


def test_buckets_of_queries_do_not_change_the_result(spark):
    df = common.table(spark, SF, "embeddings")
    key = lambda **how: sorted(map(tuple, ann.search(df, F.col("vec_id") % 5 == 0, 5, share=0.5, centroids=6, **how).collect()))
    assert key() == key(bucket_rows=3) and key() == key(block_rows=7)


# --- PII

def planted(n=400, seed=3):
    """Phones and cards that stand alone, some that run on into a number, and numbers that are neither."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    phone = lambda: f"+1 ({digits(3)}) 555-{digits(4)}"

    def card():
        d = "4" + digits(14)
        return next(d + c for c in "0123456789" if plain_spans(d + c))

    rows, hidden = [], {}
    for i in range(n):
        rows.append((i, f"some words {phone()} and more of them {card()} here", "en", "a"))
    for i in range(n, n + 40):
        p = phone() if i % 2 else card()
        text = f"some words {p} {'190.137.22.204' if i % 2 else digits(7)} go on"
        if not any(s <= 11 < e for _, s, e in plain_spans(text)):
            hidden[i] = ("phone" if i % 2 else "card", 11, 11 + len(p))
        rows.append((i, text, "en", "a"))
    for i in range(n + 40, 2 * n):
        rows.append((i, f"page {digits(5)} of {digits(3)}-{digits(9)}-{digits(2)} at {digits(2)}.{digits(2)} in {digits(8)} words", "en", "a"))
    return rows, hidden


@pytest.mark.parametrize("n", [60, 400])
def test_spans_that_the_base_rules_pass_over_are_added(spark, n):
    rows, hidden = planted(n)
    assert len(hidden) > 20
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(frame(spark, rows, clash=False))).collect()}
    added = {(d, x) for d, t, *_ in rows for x in filter(None, found[d].split(",")) if x not in {f"{k}:{s}:{e}" for k, s, e in plain_spans(t)}}
    right = {(d, f"{k}:{s}:{e}") for d, (k, s, e) in hidden.items()}
    assert len(added & right) >= 0.9 * len(right)
    assert len(added & right) >= 0.95 * len(added)
