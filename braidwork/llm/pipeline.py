"""Cleaning pipeline over ``documents``: each stage works on what the one before kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a frame.  All stages but the last return the columns of
``documents``, whatever these are called.  ``run`` writes each stage's result to
the cluster's shared folder and reads it back, so a lost executor costs one
stage at most, and deletes it once the next one is written.  All stages give an
empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import decontam, lang_id, line_dedup, minhash, mixing
from ._work import Workspace, without
from .queries import _read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language (null, or without a letter); the label ``lang`` is only learnt from.

    Ids play no part: rows with a null or repeated ``doc_id`` are judged by their texts.
    """
    return lang_id.keep_identified(docs, *lang_id.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; drops texts of which no line with words is left.

    Rows that repeat a ``doc_id`` and its text lose the same lines and stay.
    """
    own = {c: f"__own_{c}" for c in ("n_lines", "removed") if c in docs.columns}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(own))
    emptied = (F.size("removed") > 0) & ~F.col("text").rlike(mixing.WORDS)
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest ``doc_id`` of each component; null ids stay.

    Rows that share the ``doc_id`` kept are one document and stay.
    """
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return without(docs, gone, "doc_id").select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item, each row by its own text; ids play no part."""
    return decontam.drop_leaking(docs, _read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy of a document in the mix, numbered from 1 in ``copy``.

    Each row appears as often as it was drawn.  Rows with one ``doc_id``, source
    and text have their draws dealt out in turn.  An own column named ``copy``
    is replaced.
    """
    text = F.col("text").cast("string")
    key = lambda h: F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), h.alias("h"))
    plan = mixing.mix(docs).groupBy(key(F.col("text_hash")).alias("__key")).agg(F.sort_array(F.collect_list(F.col("copies").cast("int")), asc=False).alias("__drawn"))
    kept = [c for c in docs.columns if c != "copy"]
    rows = docs.select(*kept).withColumn("__key", key(F.xxhash64(text))).join(plan.hint("merge"), "__key")
    rows = rows.withColumn("__copies", F.element_at("__drawn", F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0)))))
    return rows.where("__copies > 0").select(*kept, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", leaks),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the mix."""
    work = Workspace(spark, "pipeline")
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        work.keep_only(docs)
    return docs


#: No SQL: language inference, hashing and dependent rounding are checked against brute force in tests/llm.
ORACLE_SQL = None
