"""The operators' queries over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import read


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.html import extract_main_text

    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.secrets import secret_report

    return secret_report(read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.urls import judge_urls

    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.quality import score_quality

    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.near_text import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.katz import katz_scores

    return katz_scores(read(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.mixing import mix_sources

    return mix_sources(read(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.pieces import piece_report

    return piece_report(read(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.near_vectors import near_vectors

    return near_vectors(read(spark, sf_dir, "embeddings"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.media import text_media

    return text_media(read(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.align import align_tokenizers

    return align_tokenizers(read(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.exact import exact_duplicates

    return exact_duplicates(read(spark, sf_dir, "documents")).drop("member")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestry.llm.fim import fim_digests

    return fim_digests(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_secret_scan, op3_url_filter, op4_quality_classifier, op5_minhash_near_dedup, op6_lm_scoring, op7_source_mixing, op8_sentencepiece, op9_embedding_near_dedup, op10_media_columns, op11_cross_tokenizer_alignment, op12_exact_dedup, op13_fill_in_middle)}

ORACLES = {
    "op3_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict FROM h JOIN r
      ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN f ON h.page_id = f.page_id
""",
    "op12_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
""",
    "op13_fill_in_middle": r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS x, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
v AS (SELECT doc_id, text, x, len(x) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(x) + 1) AS i, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(x) + 1) AS j,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
                  WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT doc_id, text, n, form, coalesce(array_to_string(x[1:least(i, j)], ''), '') AS p, coalesce(array_to_string(x[least(i, j) + 1:greatest(i, j)], ''), '') AS m,
             coalesce(array_to_string(x[greatest(i, j) + 1:], ''), '') AS s FROM v)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256 FROM c
""",
}
