"""Queries of what digests and rollups report: health, alerts, clusters, suggestions, gates, unknown names, validation of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack import config
from tidewrack.functions.text import floor_round
from tidewrack.operators import digest, rollup
from tidewrack.plans import digest as d
from tidewrack.plans import state as s
from tidewrack.plans.items import ITEMS_SQL, items, round_sql
from tidewrack.session import table


#: Longer than the reach of a verb, so no phrase of the text itself is near one.
_BEFORE = ". so it was at the same time and in the same old place that "


def unknown_phrases(spark, sf_dir: str) -> DataFrame:
    """The 120 most frequent capitalised phrases before a corporate verb that no dictionary knows."""
    said = items(spark, sf_dir).withColumn("title", F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Foo Bar", "The Baz", "Acme", "Known Co")]), (F.col("doc_id") % 4).cast("int") + 1), F.lit(" announced "), F.lower("title")))
    # What a body says after its own text counts only where that ends within the first 1,500 characters.
    named = F.when(F.col("doc_id") % 3 == 0, "Late Name").otherwise("Other Firm Works")
    said = said.withColumn("body", F.concat("body", F.lit(_BEFORE), named, F.lit(" said")))
    known = spark.createDataFrame([("Known Co",)], "phrase string")
    return digest.unknown_phrases(said, known)


UNKNOWN_PHRASES = f"""
WITH {ITEMS_SQL}, p AS (SELECT ['Foo Bar', 'The Baz', 'Acme', 'Known Co'][doc_id % 4 + 1] AS phrase FROM items
  UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN 'Late Name' ELSE 'Other Firm Works' END FROM items WHERE length(body) + {len(_BEFORE)} + CASE WHEN doc_id % 3 = 0 THEN 9 ELSE 16 END + 5 <= 1500)
SELECT phrase, count(*) AS n FROM p WHERE phrase NOT IN ('The Baz', 'Known Co') GROUP BY phrase HAVING count(*) >= 2 ORDER BY n DESC, phrase LIMIT 120
"""


def degraded_sources(spark, sf_dir: str) -> DataFrame:
    """Sources that failed in a week, distinct."""
    r = s._runs(spark, sf_dir)
    return r.filter(F.col("status").isin("degraded", "failed")).select(F.date_format(F.date_trunc("week", "run_at"), "yyyy-MM-dd").alias("week"), "source_id").distinct()


DEGRADED_SOURCES = f"WITH {s.RUNS_SQL} SELECT DISTINCT strftime(date_trunc('week', run_at), '%Y-%m-%d') AS week, source_id FROM runs WHERE status IN ('degraded', 'failed')"


def usable_runs(spark, sf_dir: str) -> DataFrame:
    """Whether a day's run may write: something kept, half of the sources fine."""
    r = s._runs(spark, sf_dir).groupBy("run_at").agg(F.count_if(F.col("status").isin("ok", "not-modified")).alias("ok"), F.count("*").alias("total"), F.sum("n").alias("kept"))
    return r.select(F.col("run_at").cast("string").alias("run_at"), ((F.col("kept") > 0) & (F.col("ok") / F.col("total") >= 0.5)).alias("usable"), (F.datediff(F.lit("2024-02-01").cast("date"), "run_at") >= 2).alias("stale"))


USABLE_RUNS = f"""
WITH {s.RUNS_SQL} SELECT run_at::VARCHAR AS run_at, sum(n) > 0 AND count(*) FILTER (status IN ('ok', 'not-modified'))::DOUBLE / count(*) >= 0.5 AS usable, DATE '2024-02-01' - run_at >= 2 AS stale FROM runs GROUP BY run_at
"""


def top_clusters(spark, sf_dir: str) -> DataFrame:
    """The five clusters that most publishers cover, by the week of their lead."""
    found = d.item_clusters(spark, sf_dir)
    week = items(spark, sf_dir).select(F.col("item_id").alias("lead_id"), F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week"))
    return rollup.top_clusters(found.join(week, "lead_id")).select("week", "cluster_id", "publisher_count", "lead_id", F.col("nth").cast("long").alias("nth"))


TOP_CLUSTERS = f"""
WITH RECURSIVE {ITEMS_SQL}, {d.PAIRS_CTE}, {d.CLUSTERS_CTE}, w AS (SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS week, f.* FROM found f JOIN items i ON f.lead_id = i.item_id WHERE publisher_count > 1),
r AS (SELECT week, cluster_id, publisher_count, lead_id, row_number() OVER (PARTITION BY week ORDER BY publisher_count DESC, cluster_id) AS nth FROM w) SELECT * FROM r WHERE nth <= 5
"""


def lexicon_suggestions(spark, sf_dir: str) -> DataFrame:
    """Ten plain words a week that rose most."""
    c = rollup.lift(rollup.baseline(rollup.term_frequency(s._terms(spark, sf_dir)))).filter(F.col("term").rlike("^[a-z][a-z-]{4,}$"))
    order = Window.partitionBy("week").orderBy(F.col("score").desc(), "term")
    return c.withColumn("nth", F.row_number().over(order)).filter("nth <= 10").select("week", "term", F.col("nth").cast("long").alias("nth"))


LEXICON_SUGGESTIONS = f"""
WITH {ITEMS_SQL}, {s.FREQUENCY_CTE}, l AS (SELECT *, (share + 3.0::DOUBLE / total) / (prior + 3.0::DOUBLE / total) AS lift FROM base WHERE docs >= 3),
r AS (SELECT week, term, row_number() OVER (PARTITION BY week ORDER BY {round_sql('log2(lift) * sqrt(docs)', 2)} DESC, term) AS nth FROM l WHERE lift >= 1.8 AND regexp_matches(term, '^[a-z][a-z-]{{4,}}$'))
SELECT * FROM r WHERE nth <= 10
"""


def alert_rollup(spark, sf_dir: str) -> DataFrame:
    """Alerts by item: labels and terms together."""
    found, hits = d._hits(spark, sf_dir)
    from tidewrack.operators import watchlist

    a = watchlist.alerts(hits, found).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched")))), ",").alias("matched"))
    return a.join(found.select("item_id", "doc_id"), "item_id").select("doc_id", "labels", "matched")


_LABELS = ", ".join(f"('{r.id}', '{r.label}')" for r in d.RULES)
ALERT_ROLLUP = f"""
WITH {ITEMS_SQL}, {d.LANES_CTE}, {d.HITS_CTE}, rules(entry_id, label) AS (VALUES {_LABELS}),
a AS (SELECT doc_id, label, list_transform(fnd[1:4], lambda x: x.t) AS m FROM h JOIN rules r ON r.entry_id = h.entry_id WHERE len(fnd) > 0 AND doc_id % 4 <> 0 AND (priority OR score >= min_score))
SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, array_to_string(list_sort(list_distinct(flatten(list(m)))), ',') AS matched FROM a GROUP BY doc_id
"""


def headline_items(spark, sf_dir: str) -> DataFrame:
    """A day's headline: the best item with one of three events, and how many items each lane mails (seven at most)."""
    x = d._scored(spark, sf_dir)
    strong = F.arrays_overlap("events", F.array(*[F.lit(e) for e in ("approval", "ma-large", "phase3-readout")]))
    order = F.struct("score", (-F.col("doc_id")).alias("k"))
    lanes = [F.least(F.lit(7), F.count_if(F.col("primary_lane") == lane)).cast("long").alias(f"lane_{i}") for i, lane in enumerate(config.LANES)]
    return x.groupBy(F.col("day").cast("string").alias("day")).agg(F.max_by(F.when(strong, F.col("doc_id")), F.when(strong, order)).alias("headline"), *lanes)


_N = len(config.EVENT_BOOSTS)
_STRONG = [i for i, e in enumerate(config.EVENT_BOOSTS) if e in ("approval", "ma-large", "phase3-readout")]
HEADLINE_ITEMS = f"""
WITH {ITEMS_SQL}, {d.LANES_CTE}, {d.SCORED_CTE}, x AS (SELECT *, doc_id % 3 <> 0 AND (doc_id % {_N} IN ({', '.join(map(str, _STRONG))}) OR doc_id * 7 % {_N} IN ({', '.join(map(str, _STRONG))})) AS strong FROM scored)
SELECT day::VARCHAR AS day, arg_max(doc_id, (score, -doc_id)) FILTER (strong) AS headline, {', '.join(f'least(7, count(*) FILTER (lane_no = {i}))::BIGINT AS lane_{i}' for i in range(4))} FROM x GROUP BY day
"""


def conversation_turns(spark, sf_dir: str) -> DataFrame:
    """Turns of conversations in order: the role before, and whether a turn answers."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(w))
    return c.select("conv_id", "turn", "role", "before", F.coalesce(F.col("before") != F.col("role"), F.lit(False)).alias("answers"))


CONVERSATION_TURNS = """
SELECT conv_id, turn, role, lag(role) OVER w AS before, coalesce(lag(role) OVER w <> role, FALSE) AS answers FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
"""


def label_quality(spark, sf_dir: str) -> DataFrame:
    """Labelled documents by language and source: share of good ones, with subtotals."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.cube("lang", "source").agg(F.count("*").alias("n"), floor_round(F.avg("quality"), 6).alias("good"), F.sum("toxic").cast("long").alias("toxic"), F.grouping_id().cast("long").alias("level"))


LABEL_QUALITY = f"""
SELECT lang, source, count(*) AS n, {round_sql('avg(quality)')} AS good, sum(toxic)::BIGINT AS toxic, grouping(lang, source)::BIGINT AS level FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, source)
"""

QUERIES = {
    "unknown_phrases": unknown_phrases, "degraded_sources": degraded_sources, "usable_runs": usable_runs, "top_clusters": top_clusters, "lexicon_suggestions": lexicon_suggestions,
    "alert_rollup": alert_rollup, "headline_items": headline_items, "conversation_turns": conversation_turns, "label_quality": label_quality,
}
SQL = {
    "unknown_phrases": UNKNOWN_PHRASES, "degraded_sources": DEGRADED_SOURCES, "usable_runs": USABLE_RUNS, "top_clusters": TOP_CLUSTERS, "lexicon_suggestions": LEXICON_SUGGESTIONS,
    "alert_rollup": ALERT_ROLLUP, "headline_items": HEADLINE_ITEMS, "conversation_turns": CONVERSATION_TURNS, "label_quality": LABEL_QUALITY,
}
