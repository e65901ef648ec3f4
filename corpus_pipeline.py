"""Corpus pipeline: language ID, line dedup, MinHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents.
Nulls, empty tables, ties and repeated rows are as the operators define them; an empty table passes through
all stages, and other columns do whatever their names. Near-dedup keeps each different text of a kept id. ORACLE_SQL is None: language ID and tokenisation can't be expressed in SQL, so the tests compare
the stages with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm import byte_bpe, language_id, line_dedup, minhash, mixing
from edgeloom.llm.tables import Workspace, free_names, read

LANGUAGE_PIECES = "byte_bpe_multi_50k.tiktoken"
RANKS = "byte_bpe_50k.tiktoken"
LEAST_SCORE = 0.5

ORACLE_SQL = None


def _texts_changed(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of docs; n_chars, where there is one, follows the text."""
    if "n_chars" not in docs.columns:
        return changed.select(*docs.columns)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go, and those that no language explains better than all others together."""
    ranks = public_tokenizers.path(LANGUAGE_PIECES)
    langs, p = language_id.train(docs, ranks)
    lang, score = free_names(docs, "lang_found", "score_found")
    found = language_id.predict(docs, ranks, langs, p, names=(lang, score))
    kept = found.filter((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go, and documents of which nothing is left."""
    lines, removed = free_names(docs, "lines_found", "lines_removed")
    done = line_dedup.dedup_lines(docs, names=(lines, removed))
    left = done.filter((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _texts_changed(docs, left)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, and all that have no id. Of rows with one id, which are one document, each
    different text stays once."""
    kept = minhash.near_dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    once = docs.join(kept, docs["doc_id"].cast("long") == kept["kept_id"], "left_semi")
    (nth,) = free_names(docs, "nth")
    first = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).orderBy(F.lit(0)))
    named = once.withColumn(nth, first).filter(F.col(nth) == 1).select(*docs.columns)
    return named.unionByName(docs.filter(F.col("doc_id").cast("long").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that the mix takes, as often as it takes them."""
    return _texts_changed(docs, mixing.mixed_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=False)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("minhash_dedup", dedup_documents), ("mixing", mix_sources), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = read(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return docs
