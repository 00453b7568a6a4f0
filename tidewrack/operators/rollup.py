"""Weekly rollup: tallies, term lift over a smoothed baseline, themes, clusters and search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack import config
from tidewrack.functions.text import floor_round, tokenize


def tallies(items: DataFrame, key: str = "week") -> DataFrame:
    """One row a week. ``items``: week, item_id, events, outcome, deal_type, deal_usd_m. A (day, item) pair is a row: an item
    carried on several days counts on each, unless ``items`` is made distinct before."""
    event = lambda e: F.count_if(F.array_contains("events", e))
    ma = F.col("deal_type") == "M&A"
    money = F.col("deal_type").isin("financing", "IPO")
    return items.groupBy(key).agg(
        event("approval").alias("approvals"),
        event("crl").alias("crls"),
        *[F.count_if(F.col("outcome") == o).alias(f"readouts_{o}") for o in ("met", "missed", "mixed")],
        F.count_if(ma).alias("ma_count"),
        F.floor(F.coalesce(F.sum(F.when(ma, F.coalesce("deal_usd_m", F.lit(0.0)))), F.lit(0.0)) + 0.5).alias("ma_usd_m"),
        F.max_by(F.when(ma, F.col("item_id")), F.when(ma, F.struct(F.coalesce("deal_usd_m", F.lit(0.0)), "item_id"))).alias("ma_largest"),
        F.count_if(money).alias("financing_count"),
        F.floor(F.coalesce(F.sum(F.when(money, F.coalesce("deal_usd_m", F.lit(0.0)))), F.lit(0.0)) + 0.5).alias("financing_usd_m"),
    )


def financings_by_round(items: DataFrame, key: str = "week") -> DataFrame:
    money = items.filter(F.col("deal_type").isin("financing", "IPO"))
    return money.groupBy(key, F.coalesce("deal_round", "deal_type").alias("round")).agg(F.count("*").alias("n"))


def title_terms(title: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in config.WEEKLY_STOPWORDS])
    return F.array_distinct(F.filter(tokenize(title), lambda t: (F.length(t) > 4) & ~F.array_contains(stop, t)))


def term_frequency(items: DataFrame, key: str = "week") -> DataFrame:
    """week, term, docs, total: rows with the term, and rows, of a week. ``items``: week, item_id, terms (distinct)."""
    total = items.groupBy(key).agg(F.greatest(F.lit(1), F.count("*")).alias("total"))
    return items.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("docs")).join(total, key)


def baseline(frequency: DataFrame, alpha: float = config.EWMA_ALPHA, key: str = "week") -> DataFrame:
    """Adds prior: the term's smoothed share before the week, over the weeks it was seen in, and ewma: after it. Weeks without
    the term leave it as it was."""
    before = Window.partitionBy("term").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("term").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    smooth = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a * (1 - alpha) + x * alpha)
    shared = frequency.withColumn("share", F.col("docs") / F.col("total"))
    return shared.withColumns({"prior": smooth(F.collect_list("share").over(before)), "ewma": smooth(F.collect_list("share").over(upto))})


def lift(terms: DataFrame, least_docs: int = config.LEAST_DOCS, least_lift: float = config.LEAST_LIFT) -> DataFrame:
    """Theme candidates: terms used at least ``least_lift`` times as often as before. ``terms``: docs, total, prior."""
    smoothing = F.lit(3.0) / F.col("total")
    raw = (F.col("docs") / F.col("total") + smoothing) / (F.col("prior") + smoothing)
    found = terms.filter(F.col("docs") >= least_docs).withColumn("raw_", raw).filter(F.col("raw_") >= least_lift)
    return found.withColumns({"lift": floor_round(F.col("raw_"), 2), "score": floor_round(F.log2("raw_") * F.sqrt("docs"), 2)}).drop("raw_")


def themes(candidates: DataFrame, postings: DataFrame, most: int = 8, overlap: float = config.OVERLAP, key: str = "week") -> DataFrame:
    """week, label, terms, score: candidates, best first, take in those that share over 60 % of the smaller posting set with
    them. A week's candidates are what lift left of its terms; each week is one group. ``postings``: week, term, item_ids."""

    def one_week(c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values(["score", "term"], ascending=[False, True], kind="stable")
        sets = {r.term: set(r.item_ids) for r in c.itertuples(index=False)}
        used: set = set()
        rows = []
        for r in c.itertuples(index=False):
            if r.term in used:
                continue
            group = [r.term]
            for other in c["term"]:
                if other != r.term and other not in used and len(sets[r.term] & sets[other]) / max(1, min(len(sets[r.term]), len(sets[other]))) > overlap:
                    group.append(other)
            used |= set(group)
            rows.append((getattr(r, key), r.term, group, r.score))
        return pd.DataFrame(rows[:most], columns=[key, "label", "terms", "score"])

    return candidates.select(key, "term", "score").join(postings, [key, "term"]).groupBy(key).applyInPandas(one_week, f"{key} string, label string, terms array<string>, score double")


def shift(terms: DataFrame, most: int = 6, key: str = "week") -> DataFrame:
    """week, term, delta: how many points a term's share moved, the largest rises first."""
    moved = terms.filter("prior > 0").withColumn("delta", floor_round((F.col("docs") / F.col("total") - F.col("prior")) * 100, 1)).filter(F.abs("delta") > 1)
    order = Window.partitionBy(key).orderBy(F.col("delta").desc(), "term")
    return moved.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).select(key, "term", "delta", "nth")


def top_clusters(clusters: DataFrame, most: int = 5, key: str = "week") -> DataFrame:
    """The clusters of several publishers that most of them cover. ``clusters``: week, cluster_id, publisher_count."""
    order = Window.partitionBy(key).orderBy(F.col("publisher_count").desc(), "cluster_id")
    return clusters.filter("publisher_count > 1").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)


def co_occurrence(postings: DataFrame, key: str = "week") -> DataFrame:
    """week, a, b, shared: terms that occur on the same items. ``postings``: week, item_id, term."""
    left, right = postings.select(key, "item_id", F.col("term").alias("a")), postings.select(key, "item_id", F.col("term").alias("b"))
    return left.join(right, [key, "item_id"]).filter("a < b").groupBy(key, "a", "b").agg(F.count("*").alias("shared"))


def search(items: DataFrame, query: str = "", lane: str | None = None, source: str | None = None, least: float | None = None, watched: bool = False, most: int = 400) -> DataFrame:
    """Rows that hold all words of the query in title or source name, newest and best first."""
    text = F.lower(F.concat_ws(" ", "title", "source_name"))
    for word in query.lower().split():
        items = items.filter(F.contains(text, F.lit(word)))
    if lane:
        items = items.filter(F.col("primary_lane") == lane)
    if source:
        items = items.filter(F.col("source_name") == source)
    if least is not None:
        items = items.filter(F.col("score") >= least)
    if watched:
        items = items.filter(F.size("watch_hits") > 0)
    return items.orderBy(F.col("day").desc(), F.col("score").desc(), "item_id").limit(most)


def search_index(items: DataFrame) -> DataFrame:
    """year, arrival_pos, day, source code, lane code, rounded score, watched, title, id: one row an item, for files by year
    (``sinks.write_partitions``); codes number a year's names by first appearance."""
    first = lambda c: items.groupBy("year", c).agg(F.min("arrival_pos").alias("p")).select("year", c, (F.row_number().over(Window.partitionBy("year").orderBy("p")) - 1).alias(f"{c}_code"))
    coded = items.join(first("source_name"), ["year", "source_name"]).join(first("primary_lane"), ["year", "primary_lane"])
    return coded.select("year", "arrival_pos", "day", "source_name_code", "primary_lane_code", F.floor(F.col("score") + 0.5).alias("score"), "watched", "title", "item_id")
