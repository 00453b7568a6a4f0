"""Tables on disk: digests by day, seen ids by month, weekly rollups; JSON for sites; validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that ``df`` has, and no other: a rerun of a day overwrites that day."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_partition(spark: SparkSession, path: str, by: str, value: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col(by) == value)


def partitions(spark: SparkSession, path: str, by: str) -> DataFrame:
    """Partition values, newest first."""
    return spark.read.parquet(path).select(by).distinct().orderBy(F.col(by).desc())


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row, without null fields."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)


def escape(c) -> F.Column:
    """Text for HTML."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def safe_url(c) -> F.Column:
    return F.when(c.rlike("(?i)^https?://"), c)


def violations(digest_items: DataFrame, clusters: DataFrame) -> DataFrame:
    """rule, n: what a digest may not hold: missing fields, scores out of range, members that don't exist, repeated ids."""
    members = clusters.select(F.explode("member_ids").alias("item_id")).distinct()
    bad = lambda rule, df: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    out = bad("no title", digest_items.filter(F.coalesce("title", F.lit("")) == ""))
    out = out.union(bad("score out of range", digest_items.filter("score < 0 OR score > 100 OR score IS NULL")))
    out = out.union(bad("repeated id", digest_items.groupBy("item_id").count().filter("count > 1")))
    out = out.union(bad("item without cluster", digest_items.join(members, "item_id", "left_anti")))
    return out.union(bad("unsafe url", digest_items.filter(safe_url(F.col("url")).isNull())))
