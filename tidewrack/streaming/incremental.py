"""The digest's incremental state as Structured Streaming plans; each takes a streaming frame and returns one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.session import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def weekly_counts(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Tumbling weeks, Monday to Sunday."""
    week = F.window("ts", "7 days", "7 days", "4 days")
    return events.withWatermark("ts", late).groupBy(week, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def first_arrivals(events: DataFrame, key: list[str], horizon: str | None = None) -> DataFrame:
    """The first row of each key; with a horizon, state older than it goes and a key counts as new again."""
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(key) if horizon else events.dropDuplicates(key)


def linked_within(left: DataFrame, right: DataFrame, on: str, hours: int = 72) -> DataFrame:
    """Pairs of two streams with an equal key at most ``hours`` apart; the bounds let state expire."""
    a = left.withWatermark("ts", f"{hours} hours").alias("a")
    b = right.withWatermark("ts", f"{hours} hours").alias("b")
    near = F.expr(f"a.ts BETWEEN b.ts - INTERVAL {hours} HOURS AND b.ts + INTERVAL {hours} HOURS")
    return a.join(b, (F.col(f"a.{on}") == F.col(f"b.{on}")) & near)


def smoothed(shares: DataFrame, alpha: float = 0.25) -> DataFrame:
    """Running term baseline: state is a term's smoothed share. ``shares``: term, week, share."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values("week")
        for share in rows["share"]:
            value = alpha * share + (1 - alpha) * value
        state.update((float(value),))
        yield pd.DataFrame({"term": [key[0]], "ewma": [value]})

    return shares.groupBy("term").applyInPandasWithState(update, "term string, ewma double", "ewma double", "update", "NoTimeout")


def health_ring(runs: DataFrame, ring: int = 30) -> DataFrame:
    """Source health as state: the last ``ring`` counts, failures in a row, the last success. ``runs``: source_id, run_at, status, n;
    a run that failed or brought nothing new counts 0. One row a source whenever it has run."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent, failures, success = state.get if state.exists else ([], 0, None)
        recent = list(recent)
        for r in pd.concat(list(frames)).sort_values("run_at").itertuples(index=False):
            recent = [*recent, 0 if r.status in ("failed", "not-modified") else int(r.n)][-ring:]
            failures = failures + 1 if r.status == "failed" else 0
            success = success if r.status == "failed" else int(r.run_at.value // 1000)
        state.update((recent, failures, success))
        yield pd.DataFrame({"source_id": [key[0]], "recent": [recent], "failures": [failures], "last_success_us": pd.array([success], "Int64")})

    shape = "recent array<int>, failures int, last_success_us long"
    return runs.groupBy("source_id").applyInPandasWithState(update, f"source_id string, {shape}", shape, "update", "NoTimeout")


def delivered_repeats(items: DataFrame, delivered: DataFrame, days: int = 7) -> DataFrame:
    """``items`` (item_id, digest_date), a stream, with delivered_before: whether a digest of the ``days`` before carried them. The static
    side is sent to the days that may look back at it, so the join is on equal days."""
    reach = delivered.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(days)), lambda k: F.date_add("digest_date", k))).alias("digest_date")).distinct()
    return items.join(reach.withColumn("d_", F.lit(True)), ["item_id", "digest_date"], "left").withColumn("delivered_before", F.coalesce("d_", F.lit(False))).drop("d_")


def run_to_table(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote. A batch overwrites what an earlier try of itself wrote,
    so a restart repeats nothing."""
    import uuid

    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")
