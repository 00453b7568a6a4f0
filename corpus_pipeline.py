"""The corpus pipeline: stages that each apply one training-data operator to what the stage before kept.

``run`` applies STAGES to the documents table; every stage's result is a table of its own in the shared folder before the
next begins, so a lost executor repeats part of one stage. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.llm import language, mixing, nearcopies, packing, templates
from tidewrack.llm.rows import OTHERS, shielded
from tidewrack.session import forget, stored, table, tables


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of ``docs`` and drops texts of no language: null ones and those without a letter."""
    rows, restored = shielded(docs, "doc_id", "text", "lang")
    return restored(language.identify(rows).filter(F.col("lang_pred") != language.UNKNOWN))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines but for their first place; n_chars follows the text. Every document stays, if with less text."""
    rows, restored = shielded(docs, "doc_id", "text", "n_chars")
    kept = templates.drop_recurring(rows)
    return restored(kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies: five-word shingles, similarity 0.8; SimHash
    trie links, verified, and the exact join of what is left between their components."""
    return nearcopies.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, once or twice."""
    rows, restored = shielded(docs, "doc_id", "text", "source")
    keyed = rows.withColumn("digest", F.xxhash64("text"))
    times = mixing.mix(keyed, keep=("digest",)).groupBy("doc_id", "digest").agg(F.sum("copies").alias("copies"))
    times = times.filter("copies > 0").withColumnsRenamed({"doc_id": "t_id", "digest": "t_digest"})
    taken = keyed.join(times, F.col("doc_id").eqNullSafe(F.col("t_id")) & F.col("digest").eqNullSafe(F.col("t_digest")))
    # Rows equal in id and text have been counted together: one of them stands for all.
    one = taken.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("source", F.xxhash64(OTHERS)))).filter("nth = 1")
    return restored(one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("pack", pack),
]

#: SQL can express neither the automata nor the tokenizer; tests hold run() against the operators applied one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), tables()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
            forget(spark, mark, docs)  # what the stages so far have made on the way
    return docs
