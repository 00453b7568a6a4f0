import random
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewrack import config
from tidewrack.operators import clusters, digest, lanes, rollup, state, watchlist
from tidewrack.operators.components import components
from tidewrack.sources import landing, registry, sinks

L = F.lit


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(random.Random(5).randrange(60), random.Random(i).randrange(60)) for i in range(50)]])
def test_components(spark, edges):
    d = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in components(d, in_one=0).collect()}
    assert found == {r.node: r.component for r in components(d).collect()}
    named = d.selectExpr("lpad(a, 9, '0') a", "lpad(b, 9, '0') b")
    assert {int(r.node): int(r.component) for r in components(named).collect()} == found
    assert found == {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 1, 0], [1, 2, 0]])
def test_dedupe_depends_on_arrival(spark, order):
    copies = [(0.9, "x" * 100), (0.5, "x" * 160), (0.7, "x" * 50)]
    rows = [("k", p, *copies[i]) for p, i in enumerate(order)]
    held = rows[0]
    for r in rows[1:]:
        if r[2] > held[2] or len(r[3]) > len(held[3]) * 1.5:
            held = r
    found = digest.dedupe_fold(spark.createDataFrame(rows, "item_id string, arrival_pos int, authority double, body string")).collect()
    assert [(r.arrival_pos, r.copies) for r in found] == [(held[1], 3)]


def test_capped_selection_is_the_plain_loop(spark):
    rng = random.Random(3)
    rows = [(date(2026, 8, 1 + rng.randrange(2)), f"i{i}", rng.randrange(40) / 2, i, f"c{rng.randrange(60)}", f"s{rng.randrange(8)}", f"g{rng.randrange(3)}") for i in range(200)]
    names = "digest_date item_id score arrival_pos cluster_id source_id publisher_group".split()
    found = digest.capped_selection(spark.createDataFrame(rows, "digest_date date, item_id string, score double, arrival_pos int, cluster_id string, source_id string, publisher_group string"))
    got = {(r.digest_date, r.item_id): r.reason for r in found.collect()}
    for day in {r[0] for r in rows}:
        taken, per_source, per_publisher = set(), {}, {}
        for r in sorted((dict(zip(names, r, strict=True)) for r in rows if r[0] == day), key=lambda r: (-r["score"], r["arrival_pos"])):
            if r["cluster_id"] in taken:
                wanted = "duplicate"
            elif per_source.get(r["source_id"], 0) >= 8 or per_publisher.get(r["publisher_group"], 0) >= 20:
                wanted = "over-cap"
            else:
                wanted = None
                taken.add(r["cluster_id"])
                per_source[r["source_id"]] = per_source.get(r["source_id"], 0) + 1
                per_publisher[r["publisher_group"]] = per_publisher.get(r["publisher_group"], 0) + 1
            assert got[day, r["item_id"]] == wanted


def test_lane_scores_and_ties(spark):
    d = spark.createDataFrame([("A phase 3 readout", "placebo trial. trials"), (None, None)], "title string, body string")
    rows = lanes.lane_scores(d).collect()
    import math

    raw = 3 * 2 * 1 + 2.5 * 2 * 1 + 1.5 + 1
    assert rows[0].lanes[0].score == pytest.approx(raw / (raw + 8)) and rows[0].lanes[0].matched == ["phase 3", "readout", "placebo", "trial"]
    assert all(x.score == 0 for x in rows[1].lanes) and math.isclose(rows[0].lanes[3].score, 0)
    best = lanes.lane_scores(d).select(F.element_at(lanes.ranked_lanes(F.col("lanes")), 1)["lane"].alias("b")).collect()
    assert best[1].b == config.LANES[0]


def test_upper_median(one):
    assert one(digest.upper_median(F.array(*[L(x) for x in (1, 2, 3, 4)]))) == 3
    assert one(digest.upper_median(F.array().cast("array<int>"))) is None


def clustered(spark, rows):
    schema = "item_id string, title string, canonical_url string, published_at timestamp, source_kind string, publisher_group string, authority double, body_length int, keys array<string>"
    d = clusters.prepared(spark.createDataFrame(rows, schema))
    return clusters.clusters(d, clusters.links(d)).collect()


def test_clusters(spark):
    at = datetime(2026, 8, 1)
    row = lambda i, title, group, keys, hours=0: (i, title, f"https://x.com/{i}", datetime(2026, 8, 1 + hours // 24, hours % 24), "news", group, 0.5, 100, keys)
    found = clustered(spark, [row("a", "Drug wins in a large study", "g1", ["drug:x", "co:y"]), row("b", "Maker reports success", "g2", ["drug:x", "co:y"]), row("c", "Unrelated hiring", "g3", ["co:y"])])
    assert sorted(len(r.member_ids) for r in found) == [1, 2] and max(r.publisher_count for r in found) == 2
    same = "A very particular headline about one thing"
    found = clustered(spark, [row("a", same, "g1", ["drug:x"]), row("b", same, "g2", ["drug:x"])])
    assert [(r.publisher_count, r.syndicated) for r in found] == [(1, True)]
    found = clustered(spark, [row("a", same, "g1", ["drug:x"]), row("b", same, "g2", ["drug:x"], 80)])
    assert len(found) == 2 and at


def test_watch_rules(spark):
    text = "entries:\n - id: a\n   match: {any: [mTOR, ab, rapamycin], deny: [recall]}\n - id: b\n   priority: high\n   topics: [aging-omics, nonsense]\n   match: {tickers: [LLY], regex: ['senol(']}\n"
    rules = watchlist.load(text, "not: [valid")
    assert rules[0].any == ["mTOR", "rapamycin"] and rules[1].topics == ["aging-omics"] and rules[1].regex == []
    rows = [("1", "Rapamycin news", "", "", "aging-omics", 10.0, True), ("2", "rapamycin recall", "", "", "aging-omics", 90.0, True), ("3", "x", "", "Eli Lilly LLY", "aging-omics", 1.0, True), ("4", "lly", "", "", "business-deals", 1.0, True), ("5", "mtor", "", "", "aging-omics", 60.0, False), ("6", None, "mTOR", None, "business-deals", 60.0, True)]
    d = spark.createDataFrame(rows, "item_id string, title string, body string, entity_text string, primary_lane string, score double, is_new boolean")
    found = watchlist.hits(d, rules)
    assert sorted((r.item_id, r.entry_id) for r in found.collect()) == [("1", "a"), ("3", "b"), ("5", "a"), ("6", "a")]
    assert sorted((r.item_id, r.entry_id) for r in watchlist.alerts(found, d).collect()) == [("3", "b"), ("6", "a")]
    assert watchlist.hits(d, []).count() == 0
    with pytest.raises(ValueError):
        watchlist.load("a: 1")


def test_first_seen_over_a_month_edge(spark):
    seen = spark.createDataFrame([("a", date(2026, 6, 1), "2026-06"), ("b", date(2026, 5, 31), "2026-05")], "item_id string, first_seen date, month string")
    now = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    found = {r.item_id: (r.first_seen, r.is_new) for r in state.first_seen(now, seen, L("2026-08-31").cast("date")).collect()}
    assert found == {"a": (date(2026, 6, 1), False), "b": (date(2026, 8, 31), True), "c": (date(2026, 8, 31), True)}


def test_history_rings(spark):
    rows = [("s", date(2026, 1, d), "failed" if d in (3, 4) else "ok", d) for d in range(1, 6)]
    d = spark.createDataFrame(rows, "source_id string, run_at date, status string, n int")
    last = state.trailing_median(state.source_history(d)).orderBy("run_at").collect()
    assert last[3].recent == [1, 2, 0, 0] and last[3].failures == 2 and last[4].failures == 0 and last[3].last_success == date(2026, 1, 2)
    assert [r.median for r in last] == [None, None, None, 2, 3]
    old = spark.createDataFrame([("s", list(range(30))), ("t", [7])], "source_id string, recent array<int>")
    found = {r.source_id: r.recent for r in state.merge_history(old, spark.createDataFrame([("s", 99), ("u", 1)], "source_id string, n int")).collect()}
    assert found == {"s": [*range(1, 30), 99], "t": [7], "u": [1]}


def test_themes_merge_by_overlap_with_the_seed(spark):
    c = spark.createDataFrame([("w", "a", 3.0), ("w", "b", 2.0), ("w", "c", 1.0)], "week string, term string, score double")
    p = spark.createDataFrame([("w", "a", list("12345")), ("w", "b", list("123")), ("w", "c", list("12367"))], "week string, term string, item_ids array<string>")
    found = {r.label: r.terms for r in rollup.themes(c, p).collect()}
    assert found == {"a": ["a", "b"], "c": ["c"]}  # c shares exactly 0.6 with the seed: not enough


def test_baseline_over_gaps(spark):
    f = spark.createDataFrame([("2026-01", "t", 1, 2), ("2026-03", "t", 1, 4)], "week string, term string, docs int, total int")
    found = [(r.prior, r.ewma) for r in rollup.baseline(f).orderBy("week").collect()]
    assert found == [(0.0, 0.125), (0.125, 0.25 * 0.25 + 0.75 * 0.125)]


def test_search(spark):
    d = spark.createDataFrame([("a", "The Big drug", "S1", "business-deals", 50.0, ["w"], date(2026, 1, 1)), ("b", "big", "S2", "business-deals", 60.0, [], date(2026, 1, 2))], "item_id string, title string, source_name string, primary_lane string, score double, watch_hits array<string>, day date")
    ids = lambda df: [r.item_id for r in df.collect()]
    assert ids(rollup.search(d)) == ["b", "a"] and ids(rollup.search(d, "BIG s1")) == ["a"] and ids(rollup.search(d, watched=True)) == ["a"] and ids(rollup.search(d, least=55)) == ["b"]


def test_feeds_in_three_dialects(spark):
    rss = "<rss xmlns:dc='http://purl.org/dc/elements/1.1/' xmlns:content='http://purl.org/rss/1.0/modules/content/'><channel><item><title>A &amp;lt;b&amp;gt;</title><link>https://a.com/1?utm_x=1</link><dc:date>2026-08-01</dc:date><content:encoded><![CDATA[<p>" + "long " * 20 + "</p>]]></content:encoded></item><item><title>skip me</title><link>https://a.com/2</link></item><item><title>third</title><link>https://a.com/3</link></item></channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>B</title><link href='https://b.com/1'/><updated>2026-08-02T00:00:00Z</updated><summary>s</summary></entry></feed>"
    rdf = "<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/'><item><title>C</title><link>https://c.com/1</link></item></rdf:RDF>"
    landed = spark.createDataFrame([("r", rss, 2), ("a", atom, 5), ("d", rdf, 5), ("x", "<html", 5), ("n", None, 5)], "source_id string, body string, max_items int")
    raw = landing.parse_feeds(landed)
    assert sorted(r.source_id for r in raw.filter("warning IS NOT NULL").collect()) == ["n", "x"]
    sources = registry.load(spark, [registry.Source(s, s, "", "g", exclude=["skip"]) for s in "radxn"])
    found = {r.url: r for r in landing.feed_items(raw, sources, L("2026-08-03").cast("timestamp")).collect()}
    assert set(found) == {"https://a.com/1?utm_x=1", "https://b.com/1", "https://c.com/1"}  # the limit is before the filter
    first = found["https://a.com/1?utm_x=1"]
    assert (first.canonical_url, first.body_provenance, first.published_at) == ("https://a.com/1", "full", datetime(2026, 8, 1, 12))
    assert found["https://b.com/1"].body_provenance == "dek" and found["https://c.com/1"].body_provenance == "none"


def test_bad_json_gives_no_items(spark):
    landed = spark.createDataFrame([("p", "{oops", 5), ("q", None, 5), ("r", "{}", 5)], "source_id string, body string, max_items int")
    now = L("2026-08-03").cast("timestamp")
    assert landing.literature_items(landed, now).count() == 0 and landing.trial_items(landed, now).count() == 0


def test_registry(spark):
    s = registry.load(spark, [registry.Source("a", "A", "https://x/{start}/{lookback}", "g"), registry.Source("b", "B", "u", "g", enabled=False)])
    url = registry.endpoint(registry.enabled(s), datetime(2026, 8, 1), datetime(2026, 8, 15)).first().url
    assert url == "https://x/2026-08-01/2026-08-01" and registry.by_id(s, "b").count() == 1 and registry.enabled(s, ["b"]).count() == 0


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("2026-01-01", 1, None), ("2026-01-02", 2, "x")], "day string, n int, s string")
    path = str(tmp_path / "d")
    sinks.write_partitions(d, path, "day")
    sinks.write_partitions(d.filter("n = 2").withColumn("n", L(5)), path, "day")
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [1, 5]
    assert [str(r.day) for r in sinks.partitions(spark, path, "day").collect()] == ["2026-01-02", "2026-01-01"]
    sinks.write_json(d, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect())[0] == '{"day":"2026-01-01","n":1}'


def test_usable_and_rendered(spark):
    h = spark.createDataFrame(pd.DataFrame({"status": ["ok", "not-modified", "degraded", "failed"]}))
    assert digest.usable(h, 1) and not digest.usable(h, 0) and not digest.usable(h.filter("status <> 'ok'"), 1)
    item = {"primary_lane": config.LANES[0], "url": "javascript:x", "title": "<b>", "score": 1, "digest": ["s" * 1000]}
    page = digest.rendered(iter([item] * 9))
    assert "javascript" not in page and "&lt;b&gt;" in page and page.count("<a ") == 7
    assert digest.rendered(iter([item] * 9), size=3000).count("sss") == 0


def test_unknown_phrases(spark):
    d = spark.createDataFrame([("Foo Bar announced", "Acme said so. The said."), ("Foo Bar raised", "Acme said")], "title string, body string")
    assert {r.phrase: r.n for r in digest.unknown_phrases(d).collect()}.get("Foo Bar") == 2
