"""Values on display, cards and what else readers get, by hand."""

import os
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from compare import DATA
from tidewrack import config
from tidewrack.extract import entities
from tidewrack.functions import display
from tidewrack.operators import publish
from tidewrack.plans import daily as days
from tidewrack.plans import publish as plans
from tidewrack.sources import landing, registry, sinks

L = F.lit
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_values_on_display(one):
    at = L("2026-08-04 02:30:00").cast("timestamp")
    assert (one(display.day(at)), one(display.short_day(at)), one(display.day(at, "UTC"))) == ("Aug 3, 2026", "Aug 3", "Aug 4, 2026")
    now = lambda text: L(text).cast("timestamp")
    assert [one(display.relative_days(at, now(t))) for t in ("2026-08-01", "2026-08-04 12:00:00", "2026-08-05 02:30:00", "2026-08-14")] == ["today", "today", "yesterday", "9 days ago"]
    assert [one(display.usd_millions(L(v).cast("double"))) for v in (12.4, 999.6, 1000.0, 1250.0, 43000.0, None, float("nan"))] == ["$12M", "$1000M", "$1B", "$1.3B", "$43B", None, None]
    assert one(display.week_label(L("2026-W34"))) == "Week 34 of 2026"
    assert [one(display.journal_name(L(t))) for t in ("Lancet (London, England)", "The Lancet. Oncology", "Gut : an international journal", "JAMA.")] == ["The Lancet", "The Lancet Oncology", "Gut", "JAMA"]
    assert [one(display.kind_label(L(k), L(c))) for k, c in (("preprint", None), ("journal", None), ("journal", "notice"), ("journal", "news-comment"), ("journal", "research"), ("news", "research"))] == ["Preprint", "", "Correction", "Journal news", "Paper", ""]
    assert one(display.content_hash(L("abc"))) == "ba7816bf8f01cfea" and one(display.labelled(L("crl"), config.EVENT_LABELS)) == "Complete response letter"


def test_nested_text(spark):
    texts = ['{"a":[{"_":"Novo left","$":{"href":"/x"}}]}', '"plain"', "no json <", None, '[1, {"b": "two", "$": "no"}]', '{"a":{"a":{"a":{"a":{"a":{"a":{"a":{"a":"deep"}}}}}}}}']
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.x for r in d.select("i", display.nested_text(F.col("t")).alias("x")).orderBy("i").collect()] == ["Novo left", "plain", "no json <", "", "1 two", ""]


def test_versions_and_endpoints():
    first = config.weights_version()
    assert first == config.weights_version() and len(first) == 10 and first != config.weights_version("2")
    url = registry.trial_endpoint("https://example.org/api/v2/studies")
    assert "{start}" in url and "AREA%5BPhase%5DPHASE3" in url and url.count("protocolSection.") == 10


def line(facts):
    """Facts of a card in their order."""
    parts = [facts.phase, facts.indication, facts.outcome and f"endpoint {facts.outcome}", *[x.name for x in facts.drugs[:2]], *[f"{x.metric} {x.value}" for x in facts.results[:2]]]
    if facts.deal:
        usd = facts.deal.total_usd_m if facts.deal.total_usd_m is not None else facts.deal.upfront_usd_m
        shown = None if usd is None else f"${usd / 1000:g}B" if usd >= 1000 else f"${usd:.0f}M"
        parts.append(" ".join(x for x in (facts.deal.type, facts.deal.round, shown) if x))
    if facts.evidence_level not in ("unknown", "clinical"):
        parts.append(facts.evidence_level)
    return " · ".join([p for p in parts if p][:6])


@has_data
def test_cards(spark):
    table, alerts, _ = days._digest(spark, DATA)
    cards = publish.digest_items(table).collect()
    assert cards and all(c.facts_line == line(c.key_facts) for c in cards) and any(c.facts_line.count(" · ") >= 2 for c in cards)
    for c in cards:
        assert c.badges == [config.EVENT_LABELS[e] for e in c.events if e != "opinion"][:3] and c.why_line == " · ".join(f["key"] for f in c.factors[:2])
        assert len(c.key_facts.companies) <= 4 and len(c.key_facts.drugs) <= 4 and len(c.key_facts.nct) <= 3
    best = {}
    for c in sorted(cards, key=lambda c: (-c.score, c.pos)):
        if set(c.events) & set(publish.HEADLINES):
            best.setdefault(c.digest_date, c.title)
    found = publish.headlines(table.filter("pos IS NOT NULL")).collect()
    assert {r.digest_date: r.headline for r in found} == best
    chosen = publish.alert_items(alerts, table.filter("pos IS NOT NULL").select("digest_date", "day_item", "score"), 2, "day_item").collect()
    assert {r.day_item for r in chosen} <= {r.day_item for r in alerts.collect()} and max(Counter(r.digest_date for r in chosen).values()) <= 2
    assert [r.score for r in publish.top(table.filter("pos IS NOT NULL"), 5)] == sorted((c.score for c in cards), reverse=True)[:5]


@has_data
def test_terms_of_seven_kinds(spark):
    from tidewrack.functions.text import tokenize

    rows = days.day_items(spark, DATA).filter("title IS NOT NULL").withColumn("tokens", tokenize(F.col("title"))).collect()
    wanted = Counter()
    for r in rows:
        e = entities.entities_of(r.title, r.body)
        terms = {m["canonical"] for m in e["drugs"] if m["confidence"] != "stem-only"} | {m["canonical"].lower() for kind in ("companies", "indications", "modalities", "targets") for m in e[kind]}
        terms |= {t for t in r.tokens if len(t) > 4 and t not in config.WEEKLY_STOPWORDS}
        week = date.fromordinal(r.digest_date.toordinal() - r.digest_date.weekday()).isoformat()
        wanted.update((week, t) for t in terms)
    assert {(r.week, r.term): r.docs for r in plans.weekly_item_terms(spark, DATA).collect()} == dict(wanted)


def test_status_and_tables(spark, tmp_path):
    health = spark.createDataFrame([("a", "ok", 3, None), ("b", "failed", 0, "HTTP 403\nline | two"), ("c", "not-modified", 0, "")], "source_id string, status string, items_kept int, detail string")
    assert publish.health_table(health).split("\n")[2:] == ["| a | ok | 3 | — |", "| b | failed | 0 | HTTP 403 line \\| two |", "| c | not-modified | 0 | — |"]
    day = date(2026, 8, 3)
    assert publish.run_status(spark, day, health, 5).first().outcome == "ok"
    bad = publish.run_status(spark, day, health.filter("status = 'failed'"), 5).first()
    assert (bad.outcome, bad.message) == ("unusable", "only 0/1 sources healthy, 5 items kept")
    d = spark.createDataFrame([(day, "x")], "digest_date date, item_id string")
    sinks.write_partitions(d, f"{tmp_path}/out", "digest_date")
    path = f"{tmp_path}/out"
    assert publish.done(spark, path, day) and not publish.done(spark, path, day, force=True) and not publish.done(spark, path, date(2026, 8, 4))
    ages = spark.createDataFrame([(date(2026, 8, 1), "ok"), (date(2026, 8, 2), "ok"), (date(2026, 8, 3), "unusable")], "d date, o string")
    assert [r.s for r in ages.select(publish.stale(F.col("d"), F.col("o"), L("2026-08-04 11:00:00").cast("timestamp")).alias("s")).collect()] == [True, False, True]
    empty = publish.manifest(d.limit(0), spark.createDataFrame([], "week string")).first()
    assert (empty.latest, empty.days, empty.weeks, empty.years) == ("", [], [], [])


def test_items_carry_their_source(spark):
    raw = landing.parse_feeds(spark.createDataFrame([("s", "<rss><channel><item><title>A</title><link>https://a.com/1</link></item></channel></rss>", 5)], "source_id string, body string, max_items int"))
    source = registry.Source("s", "The Source", "", "group", kind="journal", authority=0.9, lane_hints={"aging-omics": 0.5})
    r = landing.feed_items(raw, registry.load(spark, [source]), L("2026-08-03").cast("timestamp")).first()
    assert (r.source_name, r.publisher_group, r.source_kind, r.authority, r.lane_hints) == ("The Source", "group", "journal", 0.9, {"aging-omics": 0.5})
