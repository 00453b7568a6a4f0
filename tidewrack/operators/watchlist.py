"""Watch rules: loaded from YAML, unrolled into literal patterns, matched with topics and vetoes, and alerts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack import config

ALERT_SCORE = 55


@dataclass
class Rule:
    id: str
    label: str
    any: list[str] = field(default_factory=list)
    tickers: list[str] = field(default_factory=list)
    regex: list[str] = field(default_factory=list)
    deny: list[str] = field(default_factory=list)
    topics: list[str] | None = None
    priority: bool = False
    min_score: float = ALERT_SCORE


def load(text: str, overlay: str | None = None) -> list[Rule]:
    """Rules of a YAML document; an overlay document that can't be read is left out."""
    import yaml

    base = yaml.safe_load(text)
    if not isinstance(base, dict) or not isinstance(base.get("entries"), list):
        raise ValueError("a watchlist needs a list of entries")
    entries = list(base["entries"])
    if overlay:
        try:
            more = yaml.safe_load(overlay)
            entries += more["entries"] if isinstance(more, dict) and isinstance(more.get("entries"), list) else []
        except yaml.YAMLError:
            pass
    least = (base.get("defaults") or {}).get("alertMinScore", ALERT_SCORE)
    return [rule(e, least) for e in entries]


def rule(entry: dict, least: float = ALERT_SCORE) -> Rule:
    match = entry.get("match") or {}
    topics = entry.get("topics")
    valid = []
    for pattern in match.get("regex") or []:
        try:
            re.compile(pattern)
            valid.append(pattern)
        except re.error:
            pass
    return Rule(
        entry["id"], entry.get("label") or entry["id"], [t for t in match.get("any") or [] if len(t) >= 4], list(match.get("tickers") or []), valid, list(match.get("deny") or []),
        [t for t in topics if t in config.LANES] if topics is not None else None, entry.get("priority") == "high", entry.get("alertMinScore", least),
    )


def _word(term: str) -> str:
    """Whole words with ASCII boundaries."""
    left = r"(?<![A-Za-z0-9_])" if re.match(r"\w", term, re.ASCII) else r"(?<=[A-Za-z0-9_])"
    right = r"(?![A-Za-z0-9_])" if re.search(r"\w$", term, re.ASCII) else r"(?=[A-Za-z0-9_])"
    return left + re.escape(term) + right


def hits(items: DataFrame, rules: list[Rule]) -> DataFrame:
    """item_id, entry_id, label, matched (at most 4), field, priority, min_score: one row a hit. ``items``: item_id, title, body,
    entity_text, primary_lane. Every rule becomes literal expressions of one projection: no join, no pattern column."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    whole = F.concat(text, F.lit(" "), F.coalesce("entity_text", F.lit("")))
    slim = items.select("item_id", "primary_lane", text.alias("text_"), whole.alias("whole_")).withColumn("low_", F.lower("whole_"))
    each = []

    def fits(term: str, kind: str, pattern: str) -> Column:
        """A literal is looked for before its pattern is tried."""
        there = {"text": F.contains("low_", F.lit(term.lower())), "ticker": F.contains("whole_", F.lit(term))}.get(kind, F.lit(True))
        return F.when(there, F.col("whole_").rlike(pattern)).otherwise(False)

    for r in rules:
        patterns = [(t, "text", "(?i)" + _word(t)) for t in r.any] + [(t, "ticker", _word(t)) for t in r.tickers] + [(p, "regex", "(?i)" + p) for p in r.regex]
        if not patterns:
            continue
        found = F.filter(F.array(*[F.when(fits(t, k, p), F.struct(F.lit(t).alias("term"), F.lit(k).alias("field"))) for t, k, p in patterns]), lambda x: x.isNotNull())
        allowed: Column = F.lit(True)
        if r.topics is not None:
            allowed = F.col("primary_lane").isin(r.topics) if r.topics else F.lit(False)
        for d in r.deny:
            allowed = allowed & ~F.when(F.contains("low_", F.lit(d.lower())), F.col("text_").rlike("(?i)" + _word(d))).otherwise(False)
        each.append(F.when(allowed, F.struct(F.lit(r.id).alias("entry_id"), F.lit(r.label).alias("label"), found.alias("found"), F.lit(r.priority).alias("priority"), F.lit(float(r.min_score)).alias("min_score"))))
    if not each:
        return slim.select("item_id").limit(0).selectExpr("item_id", "'' entry_id", "'' label", "array('') matched", "'' field", "true priority", "0D min_score")
    out = slim.select("item_id", F.explode(F.filter(F.array(*each), lambda h: h.isNotNull() & (F.size(h["found"]) > 0))).alias("h"))
    last = F.element_at("h.found", -1)["field"]
    return out.select("item_id", "h.entry_id", "h.label", F.slice(F.transform("h.found", lambda x: x["term"]), 1, 4).alias("matched"), last.alias("field"), "h.priority", "h.min_score")


def alerts(found: DataFrame, scored: DataFrame) -> DataFrame:
    """Hits on new items with priority or enough score. ``scored``: item_id, score, is_new; it also says what is kept."""
    return found.join(scored.select("item_id", "score", "is_new"), "item_id").filter("is_new AND (priority OR score >= min_score)")


def alert_counts(rules: list[Rule], found: DataFrame) -> DataFrame:
    """entry_id, label, n: every rule, with zero where nothing alerted."""
    spark = found.sparkSession
    known = spark.createDataFrame(pd.DataFrame([(r.id, r.label) for r in rules], columns=["entry_id", "label"]))
    return known.join(found.groupBy("entry_id").agg(F.count("*").alias("n")), "entry_id", "left").select("entry_id", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
