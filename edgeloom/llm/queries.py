"""The thin opN_<name> queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_dedup

    return near_dedup(read(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_dedup

    return embedding_dedup(read(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    return pseudonymise(read(spark, sf_dir, "documents"), "edgeloom").select("doc_id", F.col("__entities").alias("n_entities"), "text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_decode

    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .language_id import identify

    return identify(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    done = dedup_lines(read(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_license_scan": op4_license_scan,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op10_line_dedup": """
        WITH line AS (
            SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
        ), full_line AS (
            SELECT doc_id, i, trim(x, ' ' || chr(9) || chr(13)) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r
            FROM line WHERE trim(x, ' ' || chr(9) || chr(13)) <> ''
        ), win AS (
            SELECT a.doc_id, a.i AS start, c.i AS stop, row_number() OVER (PARTITION BY a.x, b.x, c.x ORDER BY a.doc_id, a.i) AS nth
            FROM full_line a JOIN full_line b ON b.doc_id = a.doc_id AND b.r = a.r + 1 JOIN full_line c ON c.doc_id = a.doc_id AND c.r = a.r + 2
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS i FROM win WHERE nth > 1
        ), marked AS (
            SELECT l.doc_id, l.i, l.x, g.i IS NOT NULL AS gone FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
               md5(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_md5
        FROM marked GROUP BY doc_id
        UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
    """,
}
