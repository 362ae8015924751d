"""The queries of this subpackage: its operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, decontam, hamming, html, jaccard, langid, negatives, pii, quality, resample, secrets, sql, substrings, toxicity
from glyphmill.llm.common import fold_of, read

LANG_FOLDS, LANG_HELD = 3, 1
LABEL_FOLDS, LABEL_HELD = 4, 2
QUERY_STEP = 50
NEIGHBOURS = 10


def held_out(folds: int, held: int) -> F.Column:
    """Whether a row is in the held-out fold; rows without an id are not."""
    return F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    learned = langid.learn(docs.where(F.coalesce(fold_of(F.col("doc_id"), LANG_FOLDS), F.lit(0)) != LANG_HELD))
    return langid.identify(docs.select("doc_id", "text"), learned).select("doc_id", held_out(LANG_FOLDS, LANG_HELD), "lang_pred", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), with_ids=False, digests=True).drop("text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), folds=LABEL_FOLDS, held=LABEL_HELD)
    return toxicity.score(docs, model).select("doc_id", held_out(LABEL_FOLDS, LABEL_HELD), "score", "predicted")


def op4_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors, by the Hamming distance of their sign bits, of every vector whose id is divisible by 50."""
    codes = hamming.checkpoint(hamming.binary_codes(read(spark, sf_dir, "embeddings")))
    width = codes.agg(F.max(F.octet_length("code"))).first()[0] or 2
    return hamming.search(codes, codes.where(F.col("vec_id") % QUERY_STEP == 0), NEIGHBOURS, width // 2)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.detect(docs, pii.learn(docs)).drop("text")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judge(decontam.find(documents(spark, sf_dir), read(spark, sf_dir, "benchmark")))
    digest = F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    weights = quality.train(docs, read(spark, sf_dir, "labels"), folds=LABEL_FOLDS, held=LABEL_HELD)
    return quality.score(docs, weights).select("doc_id", held_out(LABEL_FOLDS, LABEL_HELD), "score", "predicted")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir)).drop("text")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(read(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage, by name."""
    return {
        f.__name__: f
        for f in (
            op1_language_id, op2_bpe, op3_toxicity, op4_hamming_top_k, op5_pii, op6_decontamination, op7_jaccard_join, op8_quality, op9_html, op10_secrets,
            op11_resampling, op12_hard_negatives, op13_substring_dedup,
        )
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express."""
    return {
        "op4_hamming_top_k": sql.HAMMING, "op6_decontamination": sql.DECONTAMINATION, "op7_jaccard_join": sql.JACCARD,
        "op11_resampling": sql.RESAMPLING, "op12_hard_negatives": sql.NEGATIVES, "op13_substring_dedup": sql.SUBSTRINGS,
    }
