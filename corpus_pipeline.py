"""A corpus pipeline of five stages, each one operator of skytab.llm over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytab.checkpoints import cut, forget, scratch
from skytab.llm import lines, mixing, near_text, quality, tokens


def _restored(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], keep: tuple[str, ...] = ()) -> DataFrame:
    """The stage's rows with the columns of ``docs``: those the operator might replace go through it under other names."""
    plain = ("doc_id", "text", "lang", "source", *keep)
    names = {c: f"__kept_{k}" for k, c in enumerate(docs.columns) if c not in plain}
    return stage(docs.withColumnsRenamed(names)).select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: under 50 words (null and empty texts too), mostly repeated words, or beyond
    a cutoff that the labelled good documents of their language allow. Repeated rows are judged each; null doc_ids
    stay; without labels only the base rules act; an empty table gives no rows. Columns of the operator's own names
    that ``docs`` brings keep their values."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _restored(docs, lambda rows: quality.quality_rules(rows, labels).filter("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, but for the largest doc_id that holds them; all documents stay, a null text
    as an empty one. Rows without a doc_id keep their lines; rows that share one count as one document. n_chars, where
    there is one, follows the text; columns of the operator's own names keep their values; no rows give none."""
    done = _restored(docs, lines.dedup_lines)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    Where doc_ids are null or repeat, every row is a document by itself, under a number of its own, and the
    row with the least doc_id of each group stays (rows without one come last; of a tie the first as stored). Texts
    without a word are groups of their own; very long texts are compared whole; no rows give none.
    """
    if docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        kept = near_text.near_duplicates(docs).filter("kept").select("doc_id")
        return docs.join(kept.hint("merge"), "doc_id", "left_semi").select(docs.columns)  # texts move alike at every size
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = near_text.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__row")).alias("least")
    kept = rows.select("__row", "doc_id").join(groups, "__row").groupBy("component_id").agg(least).select("least.__row")
    return rows.join(kept, "__row", "left_semi").select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated sample leaves out go. Null sources and languages are values of their own; rows that
    share a doc_id share their fate; null and empty texts count one token; columns of the operator's own names keep
    their values, a column topic being taken for the margin of that name; no rows give none."""
    return _restored(docs, lambda rows: mixing.mix_sources(rows).filter("selected"), keep=("topic",))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a training sequence; every row is packed, repeated ones and those
    without a doc_id too, and a null or empty text as its end id; no rows give none."""
    pieces = tokens.pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Consistent sampling and packing by tokens have no SQL form; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's rows are written and read again. What a stage wrote on the way is deleted
    when it ends, and so is then the table that it read; only the last one's rows stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            done = keep(stage(spark, docs, sf_dir), name)
        forget(docs)
        docs = done
    return docs
