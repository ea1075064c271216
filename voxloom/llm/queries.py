"""The queries of this subpackage, with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import embedding_dedup, html_extract, line_dedup, minhash_dedup, mixing, packing, pii, quality_rules, toxicity, url_filter
from voxloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"), (5, 2, 1), 3)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, numerator=80, denominator=100)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"), least_documents=10, least_length=1)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("rule"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_toxicity, op2_embedding_near_dedup, op3_mixing, op4_packing, op5_html_extraction, op6_minhash_near_dedup, op7_line_dedup, op8_url_filter, op9_pii, op10_quality_rules)}

_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), u AS (
            SELECT vec_id, label, e FROM v
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
              AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0
        ), p AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), r(id, seen) AS (
            SELECT DISTINCT a, a FROM p UNION SELECT r.id, p.b FROM r JOIN p ON r.seen = p.a
        ), c AS (SELECT id, min(seen) AS component FROM r GROUP BY id),
        n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
        SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component, v.vec_id) AS component_id,
               v.vec_id IS NOT DISTINCT FROM coalesce(c.component, v.vec_id) AS kept
        FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.id = v.vec_id""",
    "op3_mixing": rf"""
        WITH d AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {_WORD})), 0) AS BIGINT) AS size,
                   substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS rank
            FROM documents
        ), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s),
        c AS (SELECT *, CASE place % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, 3e0 * source_size AS cap FROM w),
        h AS (
            SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER ()
                       - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
                      / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
            FROM c
        ), l AS (SELECT share FROM h WHERE share * weight < cap ORDER BY cap / weight, place LIMIT 1),
        t AS (SELECT source, source_size, place, weight, least(cap, coalesce((SELECT share FROM l) * weight, cap)) AS target FROM h),
        q AS (
            SELECT row_number() OVER () AS r, d.doc_id, d.size, t.source_size, t.target, t.place, t.weight,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.rank, d.doc_id NULLS FIRST, d.size
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), e AS (
            SELECT r, place, size, CAST(before + size + lap * source_size AS DOUBLE) / weight AS finish FROM q, range(3) laps(lap) WHERE size > 0
        ), o AS (
            SELECT r, size, (SELECT sum(size) FROM d) - coalesce(sum(size) OVER (ORDER BY finish, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM e
        ), k AS (SELECT r, sum(greatest(0, least(size, room))) AS taken FROM o GROUP BY r)
        SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (r)""",
    "op6_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), {_WORD}) AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
        ), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
        x AS (SELECT doc_id, unnest(s) AS g FROM s),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        p AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
        r(id, seen) AS (SELECT DISTINCT a, a FROM p UNION SELECT r.id, p.b FROM r JOIN p ON r.seen = p.a),
        c AS (SELECT id, min(seen) AS component FROM r GROUP BY id)
        SELECT n.doc_id, n.n AS n_shingles, coalesce(c.component, n.doc_id) AS component_id, n.doc_id = coalesce(c.component, n.doc_id) AS kept
        FROM n LEFT JOIN c ON c.id = n.doc_id""",
    "op7_line_dedup": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        x AS (SELECT r, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
        k AS (SELECT r, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_FOLD}) AS k FROM x),
        hot AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
        j AS (SELECT k.r, k.pos, k.line, hot.k IS NOT NULL AS gone FROM k LEFT JOIN hot ON hot.k = k.k),
        o AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE gone) AS m, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM j GROUP BY r)
        SELECT d.doc_id, CAST(o.n AS BIGINT) AS n_lines, CAST(o.m AS BIGINT) AS n_dropped, sha256(o.kept) AS kept_sha256
        FROM d JOIN o ON o.r = d.r""",
}
