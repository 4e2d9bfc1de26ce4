"""Queries of this package over the given tables, and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canopy.llm import (
    bpe, centroids, importance, jaccard_join, legacy_archive, lm_scoring, mixing, posting_lists, quality_rules, run_index,
    secret_scan, simhash, toxicity,
)
from canopy.llm.common import read


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(read(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(read(spark, sf_dir, "documents"))


def op5_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.search(read(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.repeat_report(read(spark, sf_dir, "documents"))


def op7_warc_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return legacy_archive.archive_pages(read(spark, sf_dir, "pages")).select(*columns)


def op8_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(read(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(read(spark, sf_dir, "embeddings"))


def _rounds_sql(rounds: int = 5, k: int = 40) -> str:
    """Lloyd rounds over ``v(row, vec_id, c)``, one pair of table expressions a round."""
    near = """n{r} AS MATERIALIZED (SELECT row, arg_min(i, (d, i)) AS i, min(d) AS d FROM (
            SELECT row, i, list_sum(list_transform(range(1, 65), lambda j: (v.c[j] - k.c[j]) * (v.c[j] - k.c[j]))) AS d
            FROM v CROSS JOIN k{r} k) GROUP BY row)"""
    step = """k{s} AS MATERIALIZED (SELECT i, coalesce(m.c, k.c) AS c FROM k{r} k LEFT JOIN (
            SELECT i, list((t - (t % n + n) % n) // n ORDER BY j) AS c FROM (
                SELECT n{r}.i, j, sum(v.c[j])::BIGINT AS t, count(*) AS n FROM v JOIN n{r} USING (row), range(1, 65) AS g(j) GROUP BY n{r}.i, j)
            GROUP BY i) m USING (i))"""
    parts = [x for r in range(rounds) for x in (near.format(r=r), step.format(r=r, s=r + 1))] + [near.format(r=rounds)]
    return ",\n        ".join(parts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_posting_lists": op5_posting_lists,
    "op6_run_length_index": op6_run_length_index,
    "op7_warc_legacy": op7_warc_legacy,
    "op8_log_bilinear_lm": op8_log_bilinear_lm,
    "op9_source_mixing": op9_source_mixing,
    "op10_toxicity_chain": op10_toxicity_chain,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
    "op13_centroid_clustering": op13_centroid_clustering,
}
ORACLES: dict[str, str] = {
    "op6_run_length_index": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, unnest(range(octet_length(b) - 199)) AS p, b FROM d WHERE octet_length(b) >= 200),
        k AS (SELECT doc_id, p, md5_number(b[p + 1 : p + 200]) AS m FROM w),
        r AS (SELECT doc_id, p FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)),
        g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM r),
        n AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
        s AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS e FROM n GROUP BY ALL),
        t AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
        c AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(e) AS last,
                     sum(e - a) AS gone, count(*) AS runs FROM t JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
               CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
        FROM d LEFT JOIN c USING (doc_id)""",
    "op7_warc_legacy": """
        WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM r""",
    # CRC-32 from its table, which is made by shifting; once for each distinct word.
    "op11_importance_resampling": """
        WITH crc AS (SELECT list(list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t
                     FROM range(256) AS g(i)),
        texts AS (SELECT doc_id, text, true AS own FROM documents UNION ALL SELECT NULL, text, false FROM benchmark),
        rows AS (SELECT row_number() OVER () AS row, doc_id, own, regexp_extract_all(translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts),
        occ AS (SELECT row, own, unnest(words) AS w FROM rows),
        bytes AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM occ)),
        hashed AS (SELECT w, xor(4294967295, list_reduce(list_transform(range(length(h) // 2),
                       lambda j: (instr('0123456789ABCDEF', substr(h, 2 * j + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * j + 2, 1)) - 1),
                       lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295)) % 10000 AS b FROM bytes, crc),
        found AS (SELECT row, own, b FROM occ JOIN hashed USING (w)),
        sums AS (SELECT b, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM found GROUP BY b),
        whole AS (SELECT sum(s) AS s, sum(t) AS t FROM sums),
        gain AS (SELECT b, CAST(floor(1000 * ln((sums.t + 1.0::DOUBLE) * (whole.s + 10000)::DOUBLE
                     / ((sums.s + 1.0::DOUBLE) * (whole.t + 10000)::DOUBLE))) AS BIGINT) AS g FROM sums, whole),
        summed AS (SELECT row, count(*) AS n, sum(g) AS total FROM found JOIN gain USING (b) WHERE own GROUP BY row),
        weighed AS (SELECT doc_id, coalesce(n, 0) AS n, CAST(coalesce((total - (total % n + n) % n) // n, 0) AS BIGINT) AS weight,
                        sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
                    FROM rows LEFT JOIN summed USING (row) WHERE own),
        drawn AS (SELECT *, list_reduce(list_transform(range(1, 9), lambda j: CAST(instr('0123456789abcdef', substr(h, j, 1)) - 1 AS BIGINT)),
                      lambda x, y: x * 16 + y) AS u FROM weighed),
        scored AS (SELECT doc_id, n, weight, weight + CAST(floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM drawn),
        placed AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
                       count(*) FILTER (n >= 20) OVER () AS able FROM scored)
        SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN n >= 20 AND place <= 10 * able // 100 THEN place END AS rank
        FROM placed""",
    "op12_ngram_jaccard_join": """
        WITH RECURSIVE d AS MATERIALIZED (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT row, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                           lambda i: array_to_string(w[i : i + 4], ' '))) AS t FROM d WHERE len(w) > 0),
        n AS MATERIALIZED (SELECT row, count(*) AS n FROM s GROUP BY row),
        met AS (SELECT a.row AS a, b.row AS b, count(*) AS c FROM s a JOIN s b USING (t) WHERE a.row <> b.row GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM met JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        reach AS (SELECT row AS a, row AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        least AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON d.row = b GROUP BY a)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
        FROM d LEFT JOIN n USING (row) JOIN least ON a = d.row""",
    "op13_centroid_clustering": f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
            FROM embeddings WHERE len(embedding) = 64
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, c) - 1 AS i, c FROM (
            SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, c FROM v ORDER BY h, c LIMIT 40)),
        {_rounds_sql()},
        s AS (SELECT i, sum(d) AS own FROM n5 GROUP BY i)
        SELECT vec_id, CAST(n5.i AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(own AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k5.c, ',')) AS centroid_sha256
        FROM n5 JOIN v USING (row) JOIN s ON s.i = n5.i JOIN k5 ON k5.i = n5.i""",
}
