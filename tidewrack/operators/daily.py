"""A day's digest from its items, or many days' at once: duplicates, facts, clusters, score, gates, caps, summaries, alerts.

Every step works on the rows that the step before left. ``digest_date`` is the key throughout: items meet, and keys are rare
or common, among those of their day. Materialised between the parts that are read twice; only the last choice of a day, after
all gates, looks at a day as one group.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack import config
from tidewrack.extract import entities, facts
from tidewrack.operators import clusters, digest, lanes, summary, watchlist
from tidewrack.session import cut, lookup, stored

ACADEMIC = ("journal", "preprint")
#: Why an item isn't in the digest, in the order in which items drop.
REASONS = ("no-title", "no-url", "duplicate", "editorial-notice", "too-old", "below-threshold", "over-cap")


def unique(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row an item and day, by the fold of copies; and digest_date, reason, n of what dropped."""
    named = digest.drop_reason(items)
    blank = named.filter("drop_reason IS NOT NULL").groupBy("digest_date", F.col("drop_reason").alias("reason")).agg(F.count("*").alias("n"))
    keyed = named.filter("drop_reason IS NULL").drop("drop_reason").withColumn("day_item", F.concat_ws("|", F.col("digest_date").cast("string"), "item_id"))
    once = digest.dedupe_fold(keyed, "day_item")
    copies = once.groupBy("digest_date").agg(F.sum(F.col("copies") - 1).alias("n")).filter("n > 0").select("digest_date", F.lit("duplicate").alias("reason"), "n")
    return once.drop("copies"), blank.union(copies)


def enriched(items: DataFrame, major: Collection[str] = config.MAJOR_JOURNALS) -> DataFrame:
    """Entities and facts; journals' and preprints' notices are marked by article_class."""
    return facts.extract(entities.extract(items), major)


def clustered(items: DataFrame) -> DataFrame:
    """``items`` with cluster_id and publisher_count of their story among the items of their day."""
    own = items.select(F.col("day_item").alias("item_id"), "digest_date", "title", "canonical_url", "published_at", "source_kind", "keys", "publisher_group", "authority", F.length("body").alias("body_length"))
    ready = cut(clusters.prepared(own).select("item_id", "digest_date", "canonical_url", "published_at", "source_kind", "keys", "title_shingles", "hash", "publisher_group", "authority", "body_length"))
    linked = cut(clusters.links(ready, within="digest_date"))
    found = clusters.clusters(ready, linked).select(F.explode("member_ids").alias("day_item"), "cluster_id", "publisher_count")
    return items.join(found, "day_item")


def scored(items: DataFrame, rules: list[watchlist.Rule], now: Column, lexicon: dict[str, dict[str, float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """``items`` with lanes, primary_lane, watch_count, priority_hit and score; and the hits. The first lane is what topics are
    held against; it doesn't depend on hits."""
    hinted = {lane: F.element_at("lane_hints", F.lit(lane)) for lane in lexicon or config.LANE_TERMS} if "lane_hints" in items.columns else None
    laned = lanes.lane_scores(items, lexicon, hinted)
    laned = stored(laned.withColumn("primary_lane", F.element_at(lanes.ranked_lanes(F.col("lanes")), 1)["lane"]))
    hits = cut(watchlist.hits(laned.select(F.col("day_item").alias("item_id"), "title", "body", "entity_text", "primary_lane"), rules))
    watched = hits.groupBy(F.col("item_id").alias("day_item")).agg(F.count("*").cast("int").alias("watch_count"), F.bool_or("priority").alias("priority_hit"))
    out = laned.join(watched, "day_item", "left").withColumns({"watch_count": F.coalesce("watch_count", F.lit(0)), "priority_hit": F.coalesce("priority_hit", F.lit(False))})
    present = lambda c: F.col(c).isNotNull()
    out = out.withColumns({"n_results": F.size("results"), "n_nct": F.size("nct"), "has_deal": present("deal"), "has_phase": present("phase"), "has_enrollment": present("enrollment")})
    return lanes.score(out, now), hits


def gated(items: DataFrame, now: Column) -> DataFrame:
    """``items`` with reason: too old for their lane, or neither scored enough nor hit by a rule of priority."""
    old = lanes.too_old(F.col("published_at"), F.col("primary_lane"), now, F.col("source_kind").isin(*ACADEMIC))
    return items.withColumn("reason", F.when(old, "too-old").when(~lanes.keep(F.col("score"), F.col("priority_hit")), "below-threshold"))


def selected(passed: DataFrame, per_lane: int = config.PER_LANE, per_day: int = config.PER_DAY) -> DataFrame:
    """day_item, reason, pos: the choice of each day, one item a story, capped, lanes in turn; pos is null where reason isn't."""
    capped = digest.capped_selection(passed.withColumn("item_id", F.col("day_item"))).select(F.col("item_id").alias("day_item"), F.col("reason").alias("capped"))
    # The choice's own order, so that lanes keep it for equal scores.
    open_ = passed.select("day_item", "digest_date", "primary_lane", "score", "arrival_pos").join(capped, "day_item")
    placed = digest.interleave(digest.lane_rank(open_.filter("capped IS NULL"), per_lane), per_day).select("day_item", "pos")
    return open_.join(placed, "day_item", "left").select("day_item", F.coalesce("capped", F.when(F.col("pos").isNull(), "over-cap")).alias("reason"), "pos")


def daily_digest(items: DataFrame, rules: list[watchlist.Rule], now: Column, lexicon: dict[str, dict[str, float]] | None = None, major: Collection[str] = config.MAJOR_JOURNALS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: the items with what was decided on each (reason and pos, summary for those kept), the alerts of kept items, and
    digest_date, reason, n of all that dropped.

    ``items``: digest_date, item_id, arrival_pos, title, body, body_provenance, canonical_url, doi, nct_ids, source_id, source_kind,
    publisher_group, authority, published_at, is_new, delivered_before, and lane_hints if sources have any. ``now`` is the
    moment of a row's run.
    """
    once, dropped = unique(items)
    rich = stored(enriched(once, major))
    notice = F.col("source_kind").isin(*ACADEMIC) & (F.col("article_class") == "notice")
    grouped = clustered(rich.filter(~notice))
    ranked, hits = scored(grouped, rules, now, lexicon)
    decided = stored(gated(ranked, now))
    passed = decided.filter("reason IS NULL")
    choice = cut(selected(passed))
    kept = lookup(choice.filter("reason IS NULL"))
    named = F.transform(F.concat("companies", "drugs"), lambda m: F.lower(m["text"]))
    subject = F.coalesce(F.get("companies", F.lit(0))["canonical"], F.get("drugs", F.lit(0))["text"])
    said = passed.join(kept.select("day_item"), "day_item").select("day_item", summary.summary(F.col("title"), F.col("body"), F.col("body_provenance"), F.col("primary_lane"), named, subject).alias("summary"))
    slim = decided.drop("body").withColumnRenamed("reason", "gate").join(choice, "day_item", "left").withColumn("reason", F.coalesce("gate", "reason")).drop("gate")
    table = slim.join(said, "day_item", "left")
    alerts = watchlist.alerts(hits, passed.join(kept.select("day_item"), "day_item").select(F.col("day_item").alias("item_id"), "score", "is_new")).withColumnRenamed("item_id", "day_item")
    notices = rich.filter(notice).groupBy("digest_date").agg(F.count("*").alias("n")).select("digest_date", F.lit("editorial-notice").alias("reason"), "n")
    later = decided.select("day_item", "digest_date", "reason").join(choice.select("day_item", F.col("reason").alias("chosen")), "day_item", "left").select("digest_date", F.coalesce("reason", "chosen").alias("reason")).filter("reason IS NOT NULL")
    counts = dropped.union(notices).union(later.groupBy("digest_date", "reason").agg(F.count("*").alias("n"))).groupBy("digest_date", "reason").agg(F.sum("n").alias("n"))
    return table, alerts, counts


def lists(table: DataFrame, labels: dict[str, str] = config.LANE_LABELS) -> DataFrame:
    """digest_date, primary_lane, label, item_ids: the kept items of each lane, best first."""
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "pos", "item_id"))), lambda x: x["item_id"])
    found = table.filter("pos IS NOT NULL").groupBy("digest_date", "primary_lane").agg(order.alias("item_ids"))
    label = F.coalesce(*[F.when(F.col("primary_lane") == k, v) for k, v in labels.items()])
    return found.withColumn("label", label)


def stats(table: DataFrame, counts: DataFrame, fetched: DataFrame) -> DataFrame:
    """digest_date, fetched, kept, clusters, median_score, dropped: one row a day; what is fetched is kept or dropped."""
    days = fetched.groupBy("digest_date").agg(F.count("*").alias("fetched"))
    kept = table.groupBy("digest_date").agg(F.count("pos").alias("kept"), F.countDistinct("cluster_id").alias("clusters"))
    middle = digest.medians(table.filter("pos IS NOT NULL"), "digest_date", "score").select("digest_date", F.col("median").alias("median_score"))
    lost = counts.groupBy("digest_date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("dropped"))
    out = days.join(kept, "digest_date", "left").join(middle, "digest_date", "left").join(lost, "digest_date", "left")
    return out.withColumns({"kept": F.coalesce("kept", F.lit(0)), "clusters": F.coalesce("clusters", F.lit(0)), "median_score": F.coalesce("median_score", F.lit(0.0))})
