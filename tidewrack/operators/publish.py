"""What readers get of a digest: items as cards, mail, manifests, run status, weekly terms, checks of live items."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.functions.display import badges, facts_line, kind_label
from tidewrack.operators.rollup import title_terms

HEADLINES = ("approval", "ma-large", "phase3-readout")


def _shown(mentions: str) -> Column:
    return F.filter(F.coalesce(F.col(mentions), F.array()), lambda m: m["confidence"] != "stem-only")


def key_facts() -> Column:
    """struct of an item's facts, as one field, over the columns that extraction adds."""
    companies = F.transform(F.slice(_shown("companies"), 1, 4), lambda m: F.struct(m["canonical"].alias("name"), F.coalesce(m["role"], F.lit("mentioned")).alias("role"), m["detail"].alias("ticker")))
    drugs = F.transform(F.slice(_shown("drugs"), 1, 4), lambda m: F.struct(m["text"].alias("name"), m["detail"].alias("modality")))
    indication = F.get(_shown("indications"), F.lit(0))["canonical"]
    return F.struct(companies.alias("companies"), drugs.alias("drugs"), indication.alias("indication"), "phase", "nct", "enrollment", "results", "outcome", "regulatory", "deal", "evidence_level")


def digest_items(table: DataFrame) -> DataFrame:
    """Kept items of ``daily.daily_digest`` as a digest stores them, with the lines that cards show."""
    kept = table.filter("pos IS NOT NULL").withColumn("key_facts", key_facts())
    why = F.array_join(F.transform(F.slice("factors", 1, 2), lambda f: f["key"]), " · ")
    return kept.select(
        "digest_date", "pos", "item_id", F.coalesce("cluster_id", "item_id").alias("cluster_id"), "title", "canonical_url", "source_id", "publisher_group", "source_kind", "published_at", "is_new",
        F.col("summary.digest").alias("digest"), F.col("summary.source").alias("digest_source"), "key_facts", "events", "lanes", "primary_lane", "score", "factors", "penalties",
        F.col("source_kind").isin("journal", "preprint").alias("is_academic"), "article_class", facts_line(F.col("key_facts")).alias("facts_line"), why.alias("why_line"),
        kind_label(F.col("source_kind"), F.col("article_class")).alias("kind_label"), badges(F.col("events")).alias("badges"),
    )


def alert_items(alerts: DataFrame, items: DataFrame, most: int = 15, key: str = "item_id") -> DataFrame:
    """The items that alerts are about, each once, best first: so many a day. ``items``: digest_date, key, score."""
    order = Window.partitionBy("digest_date").orderBy(F.col("score").desc(), key)
    return items.join(alerts.select(key).distinct(), key, "left_semi").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)


def headlines(items: DataFrame) -> DataFrame:
    """digest_date, headline: the title of a day's best item with one of three events. ``items``: digest_date, title, score, events, pos."""
    strong = F.arrays_overlap("events", F.array(*[F.lit(e) for e in HEADLINES]))
    return items.filter(strong).groupBy("digest_date").agg(F.max_by("title", F.struct("score", -F.col("pos"))).alias("headline"))


def top(items: DataFrame, most: int = 10) -> list:
    """The best items for a console."""
    return items.orderBy(F.col("score").desc(), "item_id").limit(most).collect()


def item_terms() -> Column:
    """An item's terms for a week: shown drugs, companies, indications, modalities, targets and words of the title, distinct."""
    low = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda m: F.lower(m["canonical"]))
    return F.array_distinct(F.concat(F.transform(_shown("drugs"), lambda m: m["canonical"]), low("companies"), low("indications"), low("modalities"), low("targets"), title_terms(F.col("title"))))


def new_phase3(trials: DataFrame, most: int = 12, key: str = "week") -> DataFrame:
    """week, nct, title, sponsor, nth: the first trials of a week's registry items. ``trials``: week, arrival_pos, nct (array), title, sponsor."""
    order = Window.partitionBy(key).orderBy("arrival_pos")
    named = trials.filter(F.size("nct") > 0).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
    return named.select(key, F.get("nct", F.lit(0)).alias("nct"), "title", "sponsor", "nth")


def manifest(days: DataFrame, weeks: DataFrame, build: str = "dev") -> DataFrame:
    """One row: latest, days, weeks and years, newest first, empty if there are none. ``days``: digest_date; ``weeks``: week."""
    newest = lambda c: F.sort_array(F.collect_set(c), asc=False)
    d = days.agg(newest(F.col("digest_date").cast("string")).alias("days"), newest(F.year("digest_date")).alias("years"))
    w = weeks.agg(newest(F.col("week")).alias("weeks"))
    both = d.join(F.broadcast(w), F.lit(True))  # one row and one row
    return both.select(F.coalesce(F.get("days", F.lit(0)), F.lit("")).alias("latest"), "days", "weeks", "years", F.lit(build).alias("build"))


def run_status(spark: SparkSession, day: date, health: DataFrame, kept: int, run_id: str | None = None) -> DataFrame:
    """One row on a run, to be appended: outcome 'ok', or 'unusable' if nothing is kept or under half of the sources are fine."""
    counted = health.agg(F.count_if(F.col("status").isin("ok", "not-modified")).alias("sources_ok"), F.count("*").alias("sources_total"))
    fine = (F.lit(kept) > 0) & (F.col("sources_ok") >= F.col("sources_total") * 0.5) & (F.col("sources_total") > 0)
    message = F.format_string("only %d/%d sources healthy, %d items kept", "sources_ok", "sources_total", F.lit(kept))
    return counted.select(F.lit(run_id).alias("run_id"), F.lit(day).alias("date"), F.when(fine, "ok").otherwise("unusable").alias("outcome"), F.when(~fine, message).alias("message"), "sources_ok", "sources_total", F.lit(kept).alias("items_kept"))


def health_table(health: DataFrame) -> str:
    """Markdown, a line a source; the registry is small. ``health``: source_id, status, items_kept, detail."""
    detail = F.substring(F.replace(F.regexp_replace(F.coalesce("detail", F.lit("")), r"\s*[\r\n]+\s*", " "), F.lit("|"), F.lit("\\|")), 1, 160)
    rows = health.orderBy("source_id").select("source_id", "status", "items_kept", F.when(detail == "", "—").otherwise(detail).alias("detail")).collect()
    return "\n".join(["| Source | Status | Items | Detail |", "| --- | --- | --- | --- |", *[f"| {r.source_id} | {r.status} | {r.items_kept} | {r.detail} |" for r in rows]])


def stale(digest_date: Column, outcome: Column, now: Column) -> Column:
    """Two days old or more, counted from noon, or left by a run that failed."""
    age = F.floor((F.unix_micros(now) - F.unix_micros(digest_date.cast("timestamp"))) / 86_400_000_000 - 0.5)
    return (age >= 2) | F.coalesce(outcome != "ok", F.lit(False))


def done(spark: SparkSession, path: str, day: date, by: str = "digest_date", force: bool = False) -> bool:
    """Whether a day's partition is there, so a run has nothing to do unless forced."""
    if force:
        return False
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={day.isoformat()}")
    return bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder))


def live_problems(items: DataFrame) -> DataFrame:
    """source_id, problem, n: what items fresh from a source must not show."""
    title, url = F.coalesce("title", F.lit("")), F.coalesce("canonical_url", F.lit(""))
    found = F.array(
        F.when(title == "", "no title"),
        F.when(title.contains("[object"), "object leaked into title"),
        F.when(url.rlike("/resource/|/premium/"), "sponsored URL survived"),
        F.when(url.rlike("[?&](utm_|rss=)"), "tracking parameter survived"),
        F.when(F.col("published_at").isNull(), "no date"),
    )
    return items.select("source_id", F.explode(F.array_compact(found)).alias("problem")).groupBy("source_id", "problem").agg(F.count("*").alias("n"))
