"""The daily digest held against plain loops over its own rows."""

import os

import pytest

from compare import DATA
from tidewrack import config
from tidewrack.plans import daily

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def run(spark):
    table, alerts, counts = daily._digest(spark, DATA)
    return [r.asDict() for r in table.collect()], [r.asDict() for r in alerts.collect()], [tuple(r) for r in counts.collect()], [r.asDict() for r in daily.day_items(spark, DATA).collect()]


def fold(copies):
    held = copies[0]
    for x in copies[1:]:
        if x["authority"] > held["authority"] or len(x["body"]) > len(held["body"]) * 1.5:
            held = x
    return held["doc_id"]


def test_copies_fold_within_their_day(run):
    table, _, _, fetched = run
    by = {}
    for x in sorted(fetched, key=lambda x: x["doc_id"]):
        if x["title"] and x["canonical_url"]:
            by.setdefault((x["digest_date"], x["item_id"]), []).append(x)
    wanted = {fold(c) for c in by.values()}
    own = {x["doc_id"]: x for x in fetched}
    notices = {i for i in wanted if own[i]["title"].startswith("Author Correction") and own[i]["source_kind"] in ("journal", "preprint")}
    assert {r["arrival_pos"] for r in table} == wanted - notices and len(by) < len(fetched)


def test_gates_caps_and_turns(run):
    table = run[0]
    for day in {r["digest_date"] for r in table}:
        own = [r for r in table if r["digest_date"] == day]
        for r in own:
            if r["reason"] == "below-threshold":
                assert r["score"] < config.KEEP_THRESHOLD and not r["priority_hit"]
            elif r["reason"] != "too-old":
                assert r["score"] >= config.KEEP_THRESHOLD or r["priority_hit"]
        passed = sorted((r for r in own if r["reason"] not in ("below-threshold", "too-old")), key=lambda r: (-r["score"], r["arrival_pos"]))
        stories, sources, publishers, lanes, reasons = set(), {}, {}, {lane: [] for lane in config.LANES}, {}
        for r in passed:
            if r["cluster_id"] in stories:
                reasons[r["arrival_pos"]] = "duplicate"
            elif sources.get(r["source_id"], 0) >= config.PER_SOURCE or publishers.get(r["publisher_group"], 0) >= config.PER_PUBLISHER:
                reasons[r["arrival_pos"]] = "over-cap"
            else:
                stories.add(r["cluster_id"])
                sources[r["source_id"]] = sources.get(r["source_id"], 0) + 1
                publishers[r["publisher_group"]] = publishers.get(r["publisher_group"], 0) + 1
                lanes[r["primary_lane"]].append(r["arrival_pos"])
        order = [lanes[lane][n] for n in range(config.PER_LANE) for lane in config.LANES if n < len(lanes[lane])][: config.PER_DAY]
        for r in passed:
            at = r["arrival_pos"]
            assert r["pos"] == (order.index(at) + 1 if at in order else None)
            assert r["reason"] == (None if at in order else reasons.get(at, "over-cap"))


def test_only_kept_items_are_summed_up_and_alert(run):
    table, alerts, _, _ = run
    kept = {r["day_item"]: r for r in table if r["pos"] is not None}
    assert kept and all((r["summary"] is not None) == (r["day_item"] in kept) for r in table)
    assert all(a["day_item"] in kept and kept[a["day_item"]]["is_new"] and (a["priority"] or a["score"] >= a["min_score"]) for a in alerts)


def test_extraction_reaches_the_score(run):
    table = run[0]
    seen = {e for r in table for e in r["events"]}
    assert {"ma-large", "major-journal-primary", "safety-hold", "phase3-readout"} <= seen
    assert all(("major-journal-primary" in r["events"]) <= (r["source_id"] in daily.MAJOR and r["source_kind"] == "journal") for r in table)
    assert any(r["publisher_count"] > 1 for r in table) and {"genentech", "bluerock"} <= {c["id"] for r in table for c in r["companies"]}


def test_counts_add_up(spark, run):
    _, _, counts, fetched = run
    rows = daily.daily_stats(spark, DATA).collect()
    assert sum(r.fetched for r in rows) == len(fetched)
    for r in rows:
        lost = {reason: n for day, reason, n in counts if str(day) == r.digest_date}
        assert r.fetched == r.kept + sum(lost.values()) and r.dropped == ",".join(f"{k}={lost[k]}" for k in sorted(lost))
