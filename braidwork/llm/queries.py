"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, embed_dedup, lang_id, line_dedup, lm_score, minhash, mixing, quality, suffix_dedup
from ._work import bounded_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    root = str(Path(__file__).resolve().parents[2])
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):  # the workers import this package
        held = spark.sparkContext.environment.get("PYTHONPATH", "")
        spark.sparkContext.environment["PYTHONPATH"] = root if held in ("", root) else f"{root}{os.pathsep}{held}" if root not in held else held
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = lang_id.held_out(F.col("doc_id"))
    model = lang_id.fit(docs.where(~out))
    return lang_id.identify(docs, *model).withColumn("held_out", out)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_read(spark, sf_dir, "embeddings"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the texts labelled as of good quality; background: all texts."""
    docs, labels = (_read(spark, sf_dir, t) for t in ("documents", "labels"))
    good = labels.where("quality = 1").select("doc_id").hint("merge")
    return lm_score.score(docs, docs.join(good, "doc_id", "left_semi").select("text"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    return chat_format.format_preferences(turns, chat_format.neighbours(turns))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_read(spark, sf_dir, t) for t in ("documents", "labels"))
    out = quality.held_out(F.col("doc_id"))
    model = quality.fit(docs, labels.where(~out).select("doc_id", F.col("quality").alias("label")))
    return quality.score(docs, model).withColumn("held_out", out)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pipeline as stages

    return stages.run(spark, sf_dir)


_QUERIES = (
    op1_language_id, op2_embedding_near_dedup, op3_lm_score, op4_suffix_dedup, op5_minhash_near_dedup, op6_chat_format,
    op7_decontamination, op8_line_dedup, op9_mixing, op10_quality, pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": embed_dedup.SQL, "op5_minhash_near_dedup": minhash.SQL, "op6_chat_format": chat_format.SQL, "op7_decontamination": decontam.SQL}
