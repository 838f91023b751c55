"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import (
    decontaminate,
    divergence,
    exact_dedup,
    html_extract,
    license_scan,
    line_dedup,
    lm_score,
    minhash,
    mixing,
    pii,
    simhash,
    token_alignment,
    toxicity,
)
from leafloom.llm.common import stored
from leafloom.llm.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

#: A sentencepiece model on the driver's machine; a session's ``VOCABULARY_CONF`` names another.
VOCABULARY, VOCABULARY_CONF = "/opt/tokenizers/piece_bpe_32k.model", "spark.leafloom.vocabulary"
#: A byte-level vocabulary there, and the setting that names another.
BYTE_LEVEL, BYTE_LEVEL_CONF = "/opt/tokenizers/byte_bpe_50k.json", "spark.leafloom.byte_level"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_common_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("ld_lines").alias("n_lines"),
        F.col("ld_dropped").alias("n_dropped"),
        F.sha2("ld_kept", 256).alias("kept_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given labels are 0 and 1, so ``grade`` and ``severity`` above 1 follow from the model's own
    features (see ``toxicity.train``); ``p_toxic`` is what the labels teach."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(spark, docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(spark, docs, model).select(
        F.col("row.id").alias("doc_id"), "severity", "grade", "p_toxic", (F.col("p_toxic") > 0.5).alias("toxic")
    )


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find_personal_data(spark, docs, pii.train(spark, docs))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    index = exact_dedup.DigestIndex(spark, buckets=exact_dedup.buckets_for(docs.count()))
    try:
        index.add(docs)
        marked = exact_dedup.mark_copies(docs, index).select(
            "doc_id",
            F.col("xd_keep_id").alias("keep_id"),
            F.col("xd_size").alias("group_size"),
            F.col("xd_kept").alias("kept"),
            F.lower(F.hex("xd_digest")).alias("text_sha256"),
        )
        return stored(spark, marked, "exact-marked")
    finally:
        index.drop()  # it served this query only


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"), percent=85)
    return found.select(
        F.col("row.id").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.col("row.id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(spark, _table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row.id").alias("doc_id"), "item_id", "score", "end_word")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(spark, _table(spark, sf_dir, "documents"), vocabulary=spark.conf.get(VOCABULARY_CONF, VOCABULARY))


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(spark, _table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(spark, _table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {"byte_level": spark.conf.get(BYTE_LEVEL_CONF, BYTE_LEVEL), "pieces": spark.conf.get(VOCABULARY_CONF, VOCABULARY)}
    return token_alignment.align_tokenizers(spark, _table(spark, sf_dir, "documents"), **files)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_html_extract": op3_html_extract,
    "op4_license_scan": op4_license_scan,
    "op5_pii": op5_pii,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_minhash": op7_minhash,
    "op8_mixing": op8_mixing,
    "op9_decontaminate": op9_decontaminate,
    "op10_lm_score": op10_lm_score,
    "op11_fingerprint": op11_fingerprint,
    "op12_divergence": op12_divergence,
    "op13_token_alignment": op13_token_alignment,
}
