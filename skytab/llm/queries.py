"""The opN queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, language, lines, mixing, near_text, near_vectors, nearest_vectors, quality, resampling, tokens, toxicity, url_rules
from .oracle import MIX, ORACLE_SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train_language_model(docs.filter(_remainder(3) != 1))
    held = (_remainder(3) == 1).alias("held_out")
    return language.identify_language(docs, model).select("doc_id", held, "lang_pred", "score", "accepted")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train_toxicity_model(docs, labels.filter(_remainder(4) != 2))
    held = (_remainder(4) == 2).alias("held_out")
    return toxicity.score_toxicity(docs, model).select("doc_id", held, "score", "predicted")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), MIX)
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), F.round("margin_error", 4).alias("margin_error"), "selected")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules).drop("matches")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.quality_rules(docs, labels, carry=["doc_id"]).drop("rejected_by")


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.training_order(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokens.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), "anchor_id % 100 = 0")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors.nearest_vectors(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_embedding_near_dedup,
        op3_training_order,
        op4_language_id,
        op5_toxicity,
        op6_source_mixing,
        op7_url_filter,
        op8_line_dedup,
        op9_packing,
        op10_quality_rules,
        op11_hard_negatives,
        op12_importance_resampling,
        op13_nearest_neighbours,
    )
}
