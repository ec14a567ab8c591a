"""The registered queries of this subpackage: thin calls over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.llm import ann, clustering, langid, linededup, mixing, oddsketch, packing, pii, quality, sharding, simhash, warc, whitening
from shoreline.llm.common import scratch, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(warc.page_records(table(spark, sf_dir, "pages")), path)
    return warc.page_digests(spark, path)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=60)
    return rows.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_lost").alias("n_removed"), "text")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(table(spark, sf_dir, "documents"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16, scale=64, shift=1_000_000)


def _clustering_sql(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """Every round as one query of the last."""
    usable = "len(embedding) = {d} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0".format(d=dims)
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, [CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
                 FROM embeddings WHERE {usable})""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, x
                 FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))"""]
    near = """a{n} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min((d, k)) AS best FROM (SELECT v.vec_id, v.x, c.k,
                  CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN [[z[1], z[2]] FOR z IN list_zip(v.x, c.x)]]) AS BIGINT) AS d
                  FROM v CROSS JOIN c{n} c) GROUP BY vec_id)"""
    for n in range(rounds):
        parts += [near.format(n=n), f"""c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (
                 SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
                     SELECT best[2] AS k, i, sum(x[i]) AS s, count(*) AS n FROM a{n}, range(1, {dims + 1}) r(i) GROUP BY ALL)
                 GROUP BY k) m USING (k))"""]
    parts.append(near.format(n=rounds))
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance,
               CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} c ON c.k = best[2]"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash_near_dedup, op2_language_id, op3_sharding, op4_warc, op5_line_dedup, op6_pii,
        op7_best_fit_packing, op8_quality_rules, op9_nearest_neighbours, op10_mixing, op11_minhash_near_dedup,
        op12_centroid_clustering, op13_whitening)
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest,
                          CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
             o AS (SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> original THEN original END AS refers_to
        FROM p LEFT JOIN o USING (payload_digest)""",
    # lines are told apart by value; a run is named by its text
    "op5_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
             x AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
             c AS (SELECT doc_id, l, i, sum(length(l[i])) OVER w AS upto, length(l[i]) AS n FROM x
                   WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
             f AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b
                   ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - (a.upto - a.n) >= 60 GROUP BY ALL),
             g AS (SELECT a.doc_id, max(b.i) AS s, a.i AS e FROM c a JOIN c b
                   ON a.doc_id = b.doc_id AND b.i <= a.i AND a.upto - (b.upto - b.n) >= 60 GROUP BY ALL),
             w AS (SELECT doc_id, s, e, l[s:e] AS run FROM (FROM f UNION FROM g) JOIN d USING (doc_id)),
             r AS (SELECT doc_id, s, e, row(doc_id, s) > min(row(doc_id, s)) OVER (PARTITION BY run) AS later FROM w),
             z AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM r WHERE later),
             lost AS (SELECT doc_id, list(i) AS gone FROM z GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               CASE WHEN gone IS NULL THEN documents.text ELSE array_to_string(
                   [y.v FOR y IN list_zip(l, range(1, len(l) + 1)).list_transform(lambda q: {'v': q[1], 'i': q[2]})
                    IF NOT list_contains(gone, y.i)], chr(10)) END AS text
        FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN lost USING (doc_id)""",
    # copies are linked like any others, and the classes are all that can be reached
    "op11_minhash_near_dedup": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS MATERIALIZED (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS g FROM t),
             x AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS q FROM s),
             e AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.q = b.q AND a.doc_id <> b.doc_id
                 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
             r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.other = e.u)
        SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
        FROM s JOIN r USING (doc_id) GROUP BY doc_id, g""",
    "op12_centroid_clustering": _clustering_sql(k=8, rounds=10, dims=64, scale=1024, seed=3),
}
