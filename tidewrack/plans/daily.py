"""Whole days: the daily digest over all items, from duplicates to summaries, every step on the rows of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.urls import item_id
from tidewrack.operators import daily
from tidewrack.plans.digest import RULES, SENTENCES
from tidewrack.plans.items import LEXICON, items

#: What items report beside their own text; they take these in turn, and the sentences with facts in another.
NEWS = (
    "Pfizer acquires Biogen for $1.2 billion, shares said.",
    "Genentech announced results for trastuzumab in HER2 breast cancer.",
    "Nothing else is known.",
    "BlueRock Therapeutics raised $150 million in a Series B financing.",
    "A study of KRAS and EGFR inhibition with osimertinib.",
)
MAJOR = ("src0", "src10")


def day_items(spark, sf_dir: str) -> DataFrame:
    """Items as a run gets them: a day's copies share URLs, some lack a title, some were delivered before."""
    d, k = items(spark, sf_dir), F.col("doc_id")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs)).cast("int") + 1)
    url = F.concat(F.lit("https://"), F.col("source_id"), F.lit(".example.com/a/"), (k % 5).cast("string"))
    d = d.withColumns(
        {
            "digest_date": F.col("day"),
            "title": F.when(k % 37 != 0, F.when(k % 41 == 0, F.concat(F.lit("Author Correction: "), "title")).otherwise(F.col("title"))),
            "canonical_url": F.when(k % 43 != 0, url),
            "body": F.concat(pick(SENTENCES, F.floor(k / 3)), F.lit(" "), pick(NEWS, F.floor(k / 2)), F.lit(" "), "body"),
            "body_provenance": F.when(k % 3 == 0, "abstract").otherwise("full"),
            "doi": F.lit(None).cast("string"),
            "nct_ids": F.array().cast("array<string>"),
            "published_at": F.when(k % 29 != 0, F.col("published_at") - F.make_dt_interval(days=(k % 9).cast("int"))),
            "is_new": k % 4 != 0,
            "delivered_before": k % 17 == 0,
            "lane_hints": F.create_map(F.lit("aging-omics"), (k % 3) / F.lit(4.0)),
        }
    )
    return d.withColumn("item_id", item_id(F.col("canonical_url")))


def _digest(spark, sf_dir: str):
    now = F.date_add("digest_date", 1).cast("timestamp")
    return daily.daily_digest(day_items(spark, sf_dir), RULES, now, LEXICON, MAJOR)


def daily_digest(spark, sf_dir: str) -> DataFrame:
    """Every item of every day that is no copy: score, lane, story, why it dropped or its place, and its summary."""
    table, alerts, _ = _digest(spark, sf_dir)
    found = alerts.groupBy("day_item").agg(F.array_join(F.array_sort(F.collect_set("entry_id")), ",").alias("alerts"))
    return table.join(found, "day_item", "left").select(
        F.col("digest_date").cast("string").alias("digest_date"), F.col("arrival_pos").alias("doc_id"), "score", "primary_lane", "cluster_id", F.col("publisher_count").cast("long").alias("publishers"),
        F.col("watch_count").cast("long").alias("watched"), F.array_join("events", ",").alias("events"), "reason", F.col("pos").cast("long").alias("pos"),
        F.size("summary.digest").cast("long").alias("sentences"), F.col("summary.source").alias("summary_source"), "alerts",
    )


def daily_stats(spark, sf_dir: str) -> DataFrame:
    """Each day's counts: what was fetched is kept or dropped."""
    table, _, counts = _digest(spark, sf_dir)
    found = daily.stats(table, counts, day_items(spark, sf_dir))
    dropped = F.array_join(F.transform(F.array_sort(F.map_entries("dropped")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.select(F.col("digest_date").cast("string").alias("digest_date"), "fetched", "kept", "clusters", "median_score", dropped.alias("dropped"))


QUERIES = {"daily_digest": daily_digest, "daily_stats": daily_stats}
SQL: dict[str, str] = {}
