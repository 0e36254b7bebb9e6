"""The registered query of each operator, over its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.llm import bpe, decontamination, exact_dedup, hard_negatives, html_extraction, language_id, lm_scoring, mixing, phrases, pii, simhash_dedup, toxicity, url_filter
from voxelspark.llm.common import table


def op1_gated_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op2_cuckoo_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_tree_model_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op7_markov_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_simhash_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_groups(table(spark, sf_dir, "documents"))


def op3_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_hyperdimensional_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and benchmark item; clean documents have no row."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bpe_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op11_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_hash_threshold_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_gated_lm_scoring": op1_gated_lm_scoring,
    "op2_cuckoo_exact_dedup": op2_cuckoo_exact_dedup,
    "op3_ftrl_toxicity": op3_ftrl_toxicity,
    "op4_boosted_pii": op4_boosted_pii,
    "op5_hyperdimensional_language_id": op5_hyperdimensional_language_id,
    "op6_tree_model_extraction": op6_tree_model_extraction,
    "op7_markov_url_filter": op7_markov_url_filter,
    "op8_simhash_deletion_variants": op8_simhash_deletion_variants,
    "op9_cgk_decontamination": op9_cgk_decontamination,
    "op10_bpe_distinct_words": op10_bpe_distinct_words,
    "op11_phrase_stripes": op11_phrase_stripes,
    "op12_cover_tree_negatives": op12_cover_tree_negatives,
    "op13_hash_threshold_mixing": op13_hash_threshold_mixing,
}

ORACLE: dict[str, str] = {
    "op2_cuckoo_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
    "op11_phrase_stripes": r"""
        WITH p AS (
            SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w
            FROM (SELECT coalesce(lang, 'und') AS lang,
                         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[.,;:!?\x0A-\x0D]')) AS piece
                  FROM documents)),
        g AS (
            SELECT lang, m, w[i : i + m - 1] AS g, count(*) AS a
            FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, 6) AS r(m) WHERE len(w) >= m)
            GROUP BY ALL),
        n AS (SELECT lang, sum(a) AS n FROM g WHERE m = 1 GROUP BY lang),
        c AS (SELECT * FROM g WHERE a >= 100),
        -- A longer candidate around a phrase that is as frequent has one of a single word more.
        e AS (
            SELECT lang, part, max(a) AS most
            FROM (SELECT lang, a, unnest([g[1 : m - 1], g[2 : m]]) AS part FROM c WHERE m >= 3) GROUP BY ALL),
        k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c WHERE m >= 2),
        s AS (
            SELECT k.lang, array_to_string(k.g, ' ') AS phrase, k.k, k.a, l.a AS l, r.a AS r, n.n,
                   (1000::HUGEINT * k.a * n.n) // (l.a::HUGEINT * r.a) AS score
            FROM k JOIN n ON n.lang = k.lang
            JOIN c l ON l.lang = k.lang AND l.g = k.g[1 : k.k]
            JOIN c r ON r.lang = k.lang AND r.g = k.g[k.k + 1 : k.m]
            LEFT JOIN e ON e.lang = k.lang AND e.part = k.g
            WHERE e.most IS NULL OR e.most < k.a
            QUALIFY row_number() OVER (PARTITION BY k.lang, k.g ORDER BY score, k.k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
               CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
    """,
    "op12_cover_tree_negatives": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                   CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
            FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        p AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank,
               other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
    """,
    "op13_hash_threshold_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key
            FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
            FROM d GROUP BY source),
        -- Sources reach their limit in the order of size by weight; a share is what those before leave.
        o AS (
            SELECT *, coalesce(sum(source_size) OVER before, 0) AS gone, sum(weight) OVER rest AS weights,
                   sum(source_size) OVER () AS whole
            FROM s
            WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   rest AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        m AS (
            SELECT 3 * whole - 4 * gone AS share, 2 * weights AS shared FROM o
            WHERE 4 * source_size * weights > weight * (3 * whole - 4 * gone)
            ORDER BY gone LIMIT 1),
        t AS (
            SELECT source, source_size,
                   CASE WHEN share IS NULL OR 2 * source_size * shared <= weight * share THEN CAST(2 * source_size AS DOUBLE)
                        ELSE CAST(weight * share AS DOUBLE) / CAST(shared AS DOUBLE) END AS target
            FROM s LEFT JOIN m ON true),
        w AS (
            SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
            FROM t),
        k AS (
            SELECT source, key, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) AS through
            FROM d GROUP BY source, key),
        e AS (
            SELECT k.source, key AS edge, (target - whole * source_size - (through - words)) * 2 >= words AS ends
            FROM k JOIN w ON k.source IS NOT DISTINCT FROM w.source
            WHERE target - whole * source_size > 0
              AND through - words <= target - whole * source_size AND target - whole * source_size < through)
        SELECT d.doc_id, d.size, w.source_size, w.target,
               CAST(d.size * (w.whole + CASE WHEN d.key < e.edge OR (d.key = e.edge AND e.ends) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
    """,
}
