"""Values as readers see them: days, sums, weeks, journal names, labels, lines of facts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack import config
from tidewrack.functions.text import floor_round, squish

ZONE = "America/New_York"
DEPTH = 6


def day(at: Column, zone: str = ZONE) -> Column:
    """'Aug 3, 2026' in the zone; ``at`` is a UTC timestamp."""
    return F.date_format(F.from_utc_timestamp(at, zone), "MMM d, yyyy")


def short_day(at: Column, zone: str = ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "MMM d")


def relative_days(at: Column, now: Column) -> Column:
    """Whole days passed: 'today' up to one, also for the future."""
    days = F.floor((F.unix_micros(now) - F.unix_micros(at)) / 86_400_000_000)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def usd_millions(value: Column) -> Column:
    """'$12M', '$2B', '$1.3B'; null for null and what is no number. Halves go up."""
    whole = F.floor(value + 0.5).cast("long").cast("string")
    billions = F.when(value % 1000 == 0, F.floor(value / 1000).cast("string")).otherwise(floor_round(value / 1000, 1).cast("string"))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, F.when(value >= 1000, F.concat(F.lit("$"), billions, F.lit("B"))).otherwise(F.concat(F.lit("$"), whole, F.lit("M"))))


def week_label(week: Column) -> Column:
    """'Week 34 of 2026' of '2026-W34'."""
    return F.concat(F.lit("Week "), F.substring_index(week, "-W", -1), F.lit(" of "), F.substring_index(week, "-W", 1))


def journal_title(title: Column) -> Column:
    """A catalogue title without its closing bracket, its subtitle, and the stops between its parts."""
    out = title
    for pattern, by in ((r"\s*\([^)]*\)\s*$", ""), (r"\s+:\s+.*$", ""), (r"\.\s+", " "), (r"\.$", "")):
        out = F.regexp_replace(out, pattern, by)
    return squish(out)


def labelled(value: Column, labels: dict[str, str]) -> Column:
    """The label of a value, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), value)


def journal_name(title: Column, names: dict[str, str] = config.JOURNAL_NAMES) -> Column:
    """The name readers know, else the title as cleaned."""
    cleaned = journal_title(title)
    return F.coalesce(labelled(F.lower(cleaned), names), cleaned)


def kind_label(kind: Column, article_class: Column) -> Column:
    """What an item is, where its class says so."""
    paper = F.when(F.coalesce(article_class, F.lit("")) == "", "").when(article_class == "news-comment", "Journal news").when(article_class == "notice", "Correction").otherwise("Paper")
    return F.when(kind == "preprint", "Preprint").when(kind == "journal", paper).otherwise("")


def facts_line(facts: Column, most: int = 6) -> Column:
    """Phase, indication, outcome, two drugs, two results, the deal, evidence short of clinical: at most six, in this order."""
    deal = facts["deal"]
    size = usd_millions(F.coalesce(deal["total_usd_m"], deal["upfront_usd_m"]))
    several = lambda xs, show: F.transform(F.slice(F.coalesce(xs, F.array()), 1, 2), show)
    one = lambda c: F.array(c)
    level = facts["evidence_level"]
    parts = F.concat(
        one(facts["phase"]), one(facts["indication"]), one(F.concat(F.lit("endpoint "), facts["outcome"])), several(facts["drugs"], lambda d: d["name"]),
        several(facts["results"], lambda r: F.concat(r["metric"], F.lit(" "), r["value"])), one(F.when(deal.isNotNull(), F.concat_ws(" ", deal["type"], deal["round"], size))),
        one(F.when(~level.isin("unknown", "clinical"), level)),
    )
    return F.array_join(F.slice(F.array_compact(parts), 1, most), " · ")


def badges(events: Column, most: int = 3) -> Column:
    """Labels of the first events that aren't opinions."""
    return F.transform(F.slice(F.filter(events, lambda e: e != "opinion"), 1, most), lambda e: F.coalesce(labelled(e, config.EVENT_LABELS), e))


def content_hash(body: Column) -> Column:
    return F.substring(F.sha2(body, 256), 1, 16)


def nested_text_of(value, depth: int = 0) -> str:
    """All text of a parsed value: an element's own text is under ``_``; attributes, under ``$``, are none; six levels deep."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str | int | float):
        return str(value)
    if depth > DEPTH:
        return ""
    if isinstance(value, list):
        return " ".join(filter(None, (nested_text_of(v, depth + 1) for v in value)))
    if isinstance(value.get("_"), str):
        return value["_"]
    return " ".join(filter(None, (nested_text_of(v, depth + 1) for k, v in value.items() if k != "$")))


def _nested(values: pd.Series) -> pd.Series:
    def one(text):
        try:
            return nested_text_of(json.loads(text)) if text is not None else ""
        except ValueError:
            return text

    return values.map(one)


def nested_text(json_text: Column) -> Column:
    """Text of fields that aren't always strings, given as JSON; what is no JSON is text itself."""
    return F.pandas_udf(_nested, "string")(json_text)
