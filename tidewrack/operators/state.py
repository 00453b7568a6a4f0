"""State across runs as tables: first-seen with a bounded horizon, deliveries, source health, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = 30
MEDIAN_LEAST = 3
LOOKBACK_MONTHS = 2
REPEAT_DAYS = 7
PREVIOUS_DAYS = 10


def first_seen(items: DataFrame, seen: DataFrame, day: Column) -> DataFrame:
    """``items`` with first_seen and is_new. ``seen``: item_id, first_seen, month; three months, this one included, count.
    The month filter prunes partitions."""
    since = F.date_format(F.add_months(F.trunc(day, "month"), -LOOKBACK_MONTHS), "yyyy-MM")
    known = seen.filter(F.col("month") >= since).groupBy("item_id").agg(F.min("first_seen").alias("known_"))
    out = items.join(known, "item_id", "left")
    return out.withColumns({"first_seen": F.coalesce("known_", day), "is_new": F.col("known_").isNull()}).drop("known_")


def update_seen(seen: DataFrame, items: DataFrame) -> DataFrame:
    """``seen`` with the new items of a run; write it with dynamic partition overwrite, so only touched months change."""
    fresh = items.filter("is_new").select("item_id", "first_seen", F.date_format("first_seen", "yyyy-MM").alias("month"))
    return seen.select("item_id", "first_seen", "month").union(fresh).groupBy("item_id", "month").agg(F.min("first_seen").alias("first_seen")).select("item_id", "first_seen", "month")


def delivered_before(items: DataFrame, delivered: DataFrame, day: Column, days: int = REPEAT_DAYS) -> DataFrame:
    """``items`` with delivered_before: carried in a digest of the ``days`` before ``day``."""
    recent = delivered.filter((F.col("digest_date") >= F.date_sub(day, days)) & (F.col("digest_date") < day)).select("item_id").distinct()
    return items.join(recent.withColumn("d_", F.lit(True)), "item_id", "left").withColumn("delivered_before", F.coalesce("d_", F.lit(False))).drop("d_")


def previous_run(runs: DataFrame, digests: DataFrame, days: int = PREVIOUS_DAYS) -> DataFrame:
    """run_date, previous: the latest digest before a run, at most ``days`` back, else null. Each digest is sent to the runs that
    may look back to it, so the join is on equal days, however long the history."""
    spread = digests.select(F.col("digest_date").alias("previous")).distinct().withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(days))))
    reach = spread.select(F.date_add("previous", F.col("ahead")).alias("run_date"), "previous").groupBy("run_date").agg(F.max("previous").alias("previous"))
    return runs.select("run_date").distinct().join(reach, "run_date", "left")


def window_start(run: Column, previous: Column) -> Column:
    """A run covers what came since the digest before it, or three days."""
    return F.coalesce(previous.cast("timestamp"), run.cast("timestamp") - F.expr("interval 3 days"))


def source_history(runs: DataFrame, ring: int = RING) -> DataFrame:
    """Adds recent (the last counts, this run included), failures (in a row) and last_success to ``runs``: source_id, run_at,
    status, n. A run that brought nothing or failed counts 0."""
    along = Window.partitionBy("source_id").orderBy("run_at")
    ok = F.col("status").isin("ok", "not-modified", "degraded").cast("int")
    out = runs.withColumn("recent", F.collect_list(F.when(F.col("status").isin("failed", "not-modified"), 0).otherwise(F.col("n")).cast("int")).over(along.rowsBetween(-(ring - 1), 0)))
    out = out.withColumn("ok_", ok).withColumn("island_", F.sum("ok_").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("source_id", "island_").orderBy("run_at").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("failures", F.sum(1 - F.col("ok_")).over(inside))
    return out.withColumn("last_success", F.last(F.when(F.col("ok_") == 1, F.col("run_at")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("ok_", "island_")


def trailing_median(runs: DataFrame, ring: int = RING, least: int = MEDIAN_LEAST) -> DataFrame:
    """Adds median: the upper median of the counts of the ``ring`` runs before, from ``least`` runs on."""
    before = Window.partitionBy("source_id").orderBy("run_at").rowsBetween(-ring, -1)
    ordered = F.array_sort(F.collect_list(F.col("n").cast("int")).over(before))
    return runs.withColumn("o_", ordered).withColumn("median", F.when(F.size("o_") >= least, F.get("o_", F.floor(F.size("o_") / 2).cast("int")))).drop("o_")


def health_status(n: Column, median: Column, failed: Column, not_modified: Column, share: float = 0.3) -> Column:
    """A source that brings under 30 % of its usual count is degraded."""
    return F.when(failed, "failed").when(not_modified, "not-modified").when(n == 0, "degraded").when(n < median * share, "degraded").otherwise("ok")


def merge_history(old: DataFrame, new: DataFrame, ring: int = RING) -> DataFrame:
    """source_id, recent: a run's counts (source_id, n) appended to the stored rings; sources without a run keep theirs."""
    both = old.select("source_id", F.col("recent").alias("old_")).join(new.select("source_id", "n"), "source_id", "full")
    joined = F.concat(F.coalesce("old_", F.array().cast("array<int>")), F.when(F.col("n").isNull(), F.array().cast("array<int>")).otherwise(F.array(F.col("n").cast("int"))))
    return both.select("source_id", F.reverse(F.slice(F.reverse(joined), 1, ring)).alias("recent"))


def neighbours(days: DataFrame) -> DataFrame:
    """day, older, newer: each distinct day with those before and after it. A row a day, so one ordered window holds them."""
    along = Window.orderBy("day")
    return days.select("day").distinct().select("day", F.lag("day").over(along).alias("older"), F.lead("day").over(along).alias("newer"))
