"""Queries of state, rollup, search, and of the relational shapes that the digest's tables take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack import config
from tidewrack.functions.text import floor_round
from tidewrack.operators import rollup, state
from tidewrack.plans.items import ITEMS_SQL, items, round_sql, tokens_sql
from tidewrack.session import table


def _runs(spark, sf_dir: str) -> DataFrame:
    """A source's runs: events of a type, a day; some runs count as failed or unchanged."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source_id"), F.to_date("ts").alias("run_at")).agg(F.count("*").alias("n"))
    day = F.dayofmonth("run_at")
    return e.withColumn("status", F.when(day % 7 == F.length("source_id") % 7, "failed").when(day % 11 == 3, "not-modified").otherwise("ok"))


RUNS_SQL = """runs AS (SELECT event_type AS source_id, ts::DATE AS run_at, count(*) AS n,
  CASE WHEN day(ts::DATE) % 7 = length(event_type) % 7 THEN 'failed' WHEN day(ts::DATE) % 11 = 3 THEN 'not-modified' ELSE 'ok' END AS status FROM events GROUP BY 1, 2, 4)"""


def source_history(spark, sf_dir: str) -> DataFrame:
    """Ring of counts, failures in a row, last success, trailing median, status by median."""
    h = state.trailing_median(state.source_history(_runs(spark, sf_dir)))
    status = state.health_status(F.col("n"), F.col("median"), F.col("status") == "failed", F.col("status") == "not-modified")
    return h.select("source_id", F.col("run_at").cast("string").alias("run_at"), F.array_join("recent", ",").alias("recent"), F.col("failures").cast("long").alias("failures"), F.col("last_success").cast("string").alias("last_success"), F.col("median").cast("long").alias("median"), status.alias("health"))


SOURCE_HISTORY = f"""
WITH {RUNS_SQL}, ok AS (SELECT *, (status <> 'failed')::INT AS ok, sum((status <> 'failed')::INT) OVER (PARTITION BY source_id ORDER BY run_at) AS island FROM runs), h AS (
  SELECT *, list(CASE WHEN status = 'ok' THEN n ELSE 0 END) OVER (PARTITION BY source_id ORDER BY run_at ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS recent,
    sum(1 - ok) OVER (PARTITION BY source_id, island ORDER BY run_at) AS failures, max(CASE WHEN ok = 1 THEN run_at END) OVER (PARTITION BY source_id ORDER BY run_at) AS last_success,
    list_sort(list(n) OVER (PARTITION BY source_id ORDER BY run_at ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) AS before FROM ok), m AS (
  SELECT *, CASE WHEN len(before) >= 3 THEN before[len(before) // 2 + 1] END AS median FROM h)
SELECT source_id, run_at::VARCHAR AS run_at, array_to_string(recent, ',') AS recent, failures::BIGINT AS failures, last_success::VARCHAR AS last_success, median,
  CASE WHEN status = 'failed' THEN 'failed' WHEN status = 'not-modified' THEN 'not-modified' WHEN n = 0 OR n < median * 0.3 THEN 'degraded' ELSE 'ok' END AS health FROM m
"""


def health_counts(spark, sf_dir: str) -> DataFrame:
    """Every source with its latest health, and how many runs were fine; sources without runs are unknown."""
    r = _runs(spark, sf_dir)
    known = r.select("source_id").distinct().union(spark.createDataFrame([("idle",)], "source_id string"))
    last = r.groupBy("source_id").agg(F.max_by("status", "run_at").alias("latest"), F.count_if(F.col("status").isin("ok", "not-modified")).alias("fine"), F.count("*").alias("runs"))
    return known.join(last, "source_id", "left").select("source_id", F.coalesce("latest", F.lit("unknown")).alias("latest"), F.coalesce("fine", F.lit(0)).cast("long").alias("fine"), F.coalesce("runs", F.lit(0)).cast("long").alias("runs"))


HEALTH_COUNTS = f"""
WITH {RUNS_SQL}, known AS (SELECT DISTINCT source_id FROM runs UNION ALL SELECT 'idle')
SELECT k.source_id, coalesce(arg_max(status, run_at), 'unknown') AS latest, coalesce(count_if(status IN ('ok', 'not-modified')), 0)::BIGINT AS fine, count(status) AS runs FROM known k LEFT JOIN runs r ON k.source_id = r.source_id GROUP BY k.source_id
"""


def ring_merge(spark, sf_dir: str) -> DataFrame:
    """Stored rings with a new run appended; sources on either side alone stay."""
    r = _runs(spark, sf_dir)
    old = r.filter("source_id <> 'click'").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run_at", F.col("n").cast("int").alias("n")))), lambda x: x["n"]).alias("recent"))
    new = r.filter("source_id <> 'view'").groupBy("source_id").agg(F.max("n").alias("n"))
    return state.merge_history(old, new).select("source_id", F.array_join("recent", ",").alias("recent"))


RING_MERGE = f"""
WITH {RUNS_SQL}, o AS (SELECT source_id, list(n ORDER BY run_at) AS r FROM runs WHERE source_id <> 'click' GROUP BY 1), w AS (SELECT source_id, max(n) AS n FROM runs WHERE source_id <> 'view' GROUP BY 1),
m AS (SELECT coalesce(o.source_id, w.source_id) AS source_id, list_concat(coalesce(o.r, []), CASE WHEN w.n IS NULL THEN [] ELSE [w.n] END) AS r FROM o FULL JOIN w ON o.source_id = w.source_id)
SELECT source_id, array_to_string(r[greatest(1, len(r) - 29):], ',') AS recent FROM m
"""


def first_seen(spark, sf_dir: str) -> DataFrame:
    """First-seen dates over a horizon of three months; older ones count as new again."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("item_id"), F.to_date("o_orderdate").alias("d"))
    seen = o.filter("d < date '1997-06-10'").groupBy("item_id", F.date_format("d", "yyyy-MM").alias("month")).agg(F.min("d").alias("first_seen"))
    now = o.filter("d >= date '1997-06-10' AND d < date '1997-06-17'").select("item_id").distinct()
    found = state.first_seen(now, seen, F.lit("1997-06-10").cast("date"))
    return found.select("item_id", F.col("first_seen").cast("string").alias("first_seen"), "is_new")


FIRST_SEEN = """
WITH o AS (SELECT o_custkey::VARCHAR AS item_id, o_orderdate::DATE AS d FROM orders), now AS (SELECT DISTINCT item_id FROM o WHERE d >= DATE '1997-06-10' AND d < DATE '1997-06-17'),
s AS (SELECT item_id, min(d) AS f FROM o WHERE d < DATE '1997-06-10' AND strftime(d, '%Y-%m') >= '1997-04' GROUP BY 1)
SELECT n.item_id, coalesce(f, DATE '1997-06-10')::VARCHAR AS first_seen, f IS NULL AS is_new FROM now n LEFT JOIN s ON n.item_id = s.item_id
"""


def delivered_repeat(spark, sf_dir: str) -> DataFrame:
    """Customers of a day whom the seven days before had already: day 7 counts, day 8 doesn't."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id"), F.to_date("o_orderdate").alias("digest_date"))
    day = F.lit("1997-06-17").cast("date")
    return state.delivered_before(o.filter(F.col("digest_date") == day).select("item_id").distinct(), o, day)


DELIVERED_REPEAT = """
SELECT DISTINCT o_custkey AS item_id, o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate::DATE >= DATE '1997-06-10' AND o_orderdate::DATE < DATE '1997-06-17') AS delivered_before FROM orders WHERE o_orderdate::DATE = DATE '1997-06-17'
"""


def previous_run(spark, sf_dir: str) -> DataFrame:
    """For every order day the latest digest at most ten days back, and where its window starts."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    runs = o.select(F.col("d").alias("run_date"))
    digests = o.filter(F.dayofmonth("d").isin(1, 2, 19)).select(F.col("d").alias("digest_date"))
    found = state.previous_run(runs, digests)
    start = state.window_start(F.col("run_date"), F.col("previous"))
    return found.select(F.col("run_date").cast("string").alias("run_date"), F.col("previous").cast("string").alias("previous"), F.date_format(start, "yyyy-MM-dd").alias("window_start"))


PREVIOUS_RUN = """
WITH r AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), g AS (SELECT d FROM r WHERE day(d) IN (1, 2, 19))
SELECT r.d::VARCHAR AS run_date, max(g.d)::VARCHAR AS previous, coalesce(max(g.d), r.d - 3)::DATE::VARCHAR AS window_start FROM r LEFT JOIN g ON g.d < r.d AND g.d >= r.d - 10 GROUP BY r.d
"""


def neighbour_days(spark, sf_dir: str) -> DataFrame:
    """Every day with the newer and the older one, across years: one row a day, so the window is some hundred rows a year."""
    return state.neighbours(items(spark, sf_dir).select("day")).select(*[F.col(c).cast("string").alias(c) for c in ("day", "older", "newer")])


NEIGHBOUR_DAYS = f"WITH {ITEMS_SQL}, d AS (SELECT DISTINCT day FROM items) SELECT day::VARCHAR AS day, (lag(day) OVER w)::VARCHAR AS older, (lead(day) OVER w)::VARCHAR AS newer FROM d WINDOW w AS (ORDER BY day)"


def _deals(spark, sf_dir: str) -> DataFrame:
    """Orders as items of a week with deals, outcomes and events."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("M&A", "financing", "IPO", "license")]), (k % 4).cast("int") + 1)
    return o.select(
        F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd").alias("week"),
        k.alias("item_id"),
        F.when(k % 5 == 0, F.array(F.lit("approval"))).when(k % 7 == 0, F.array(F.lit("crl"), F.lit("approval"))).otherwise(F.array()).cast("array<string>").alias("events"),
        F.when(k % 3 == 0, F.element_at(F.array(F.lit("met"), F.lit("missed"), F.lit("mixed")), (k % 9 / 3).cast("int") + 1)).alias("outcome"),
        F.when(k % 2 == 0, kind).alias("deal_type"),
        F.when(k % 10 != 0, F.floor(F.col("o_totalprice")).cast("double")).alias("deal_usd_m"),
        F.when(k % 8 == 0, F.concat(F.lit("Series "), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (k % 3).cast("int") + 1))).alias("deal_round"),
    )


DEALS_SQL = """deals AS (SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, o_orderkey AS item_id, o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS approval, o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 AS crl,
  CASE WHEN o_orderkey % 3 = 0 THEN ['met', 'missed', 'mixed'][(o_orderkey % 9) // 3 + 1] END AS outcome, CASE WHEN o_orderkey % 2 = 0 THEN ['M&A', 'financing', 'IPO', 'license'][o_orderkey % 4 + 1] END AS deal_type,
  CASE WHEN o_orderkey % 10 <> 0 THEN floor(o_totalprice) END AS usd, CASE WHEN o_orderkey % 8 = 0 THEN 'Series ' || ['A', 'B', 'C'][o_orderkey % 3 + 1] END AS deal_round FROM orders)"""


def weekly_tallies(spark, sf_dir: str) -> DataFrame:
    return rollup.tallies(_deals(spark, sf_dir))


WEEKLY_TALLIES = f"""
WITH {DEALS_SQL} SELECT week, coalesce(count_if(approval), 0)::BIGINT AS approvals, coalesce(count_if(crl), 0)::BIGINT AS crls, coalesce(count_if(outcome = 'met'), 0)::BIGINT AS readouts_met, coalesce(count_if(outcome = 'missed'), 0)::BIGINT AS readouts_missed,
  coalesce(count_if(outcome = 'mixed'), 0)::BIGINT AS readouts_mixed, coalesce(count_if(deal_type = 'M&A'), 0)::BIGINT AS ma_count, floor(coalesce(sum(coalesce(usd, 0)) FILTER (deal_type = 'M&A'), 0) + 0.5)::BIGINT AS ma_usd_m,
  arg_max(item_id, (coalesce(usd, 0), item_id)) FILTER (deal_type = 'M&A') AS ma_largest, coalesce(count_if(deal_type IN ('financing', 'IPO')), 0)::BIGINT AS financing_count,
  floor(coalesce(sum(coalesce(usd, 0)) FILTER (deal_type IN ('financing', 'IPO')), 0) + 0.5)::BIGINT AS financing_usd_m FROM deals GROUP BY week
"""


def financing_rounds(spark, sf_dir: str) -> DataFrame:
    return rollup.financings_by_round(_deals(spark, sf_dir))


FINANCING_ROUNDS = f"WITH {DEALS_SQL} SELECT week, coalesce(deal_round, deal_type) AS round, count(*) AS n FROM deals WHERE deal_type IN ('financing', 'IPO') GROUP BY ALL"


def _terms(spark, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir)
    return d.select(F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week"), "item_id", "doc_id", rollup.title_terms(F.col("title")).alias("terms"))


def _frequency_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in config.WEEKLY_STOPWORDS)
    return f"""terms AS (SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS week, doc_id, item_id, list_distinct(list_filter({tokens_sql('title')}, lambda t: length(t) > 4 AND t NOT IN ({stop}))) AS terms FROM items),
total AS (SELECT week, count(*) AS total FROM terms GROUP BY week), post AS (SELECT week, doc_id, item_id, unnest(terms) AS term FROM terms),
freq AS (SELECT p.week, term, count(*) AS docs, any_value(total) AS total FROM post p JOIN total t ON p.week = t.week GROUP BY p.week, term),
num AS (SELECT *, docs::DOUBLE / total AS share, list(docs::DOUBLE / total) OVER (PARTITION BY term ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM freq),
base AS (SELECT *, CASE WHEN before IS NULL OR len(before) = 0 THEN 0.0::DOUBLE ELSE list_reduce(list_prepend(0.0::DOUBLE, before), lambda a, x: a * 0.75::DOUBLE + x * 0.25::DOUBLE) END AS prior FROM num)"""


FREQUENCY_CTE = _frequency_sql()


def term_baseline(spark, sf_dir: str) -> DataFrame:
    """Terms of titles by week, with their smoothed share before the week and after it."""
    b = rollup.baseline(rollup.term_frequency(_terms(spark, sf_dir)))
    return b.select("week", "term", "docs", floor_round(F.col("prior"), 9).alias("prior"), floor_round(F.col("ewma"), 9).alias("ewma"))


TERM_BASELINE = f"WITH {ITEMS_SQL}, {FREQUENCY_CTE} SELECT week, term, docs, {round_sql('prior', 9)} AS prior, {round_sql('prior * 0.75::DOUBLE + share * 0.25::DOUBLE', 9)} AS ewma FROM base"


def term_lift(spark, sf_dir: str) -> DataFrame:
    return rollup.lift(rollup.baseline(rollup.term_frequency(_terms(spark, sf_dir)))).select("week", "term", "docs", "lift", "score")


TERM_LIFT = f"""
WITH {ITEMS_SQL}, {FREQUENCY_CTE}, l AS (SELECT *, (share + 3.0::DOUBLE / total) / (prior + 3.0::DOUBLE / total) AS lift FROM base WHERE docs >= 3)
SELECT week, term, docs, {round_sql('lift', 2)} AS lift, {round_sql('log2(lift) * sqrt(docs)', 2)} AS score FROM l WHERE lift >= 1.8
"""


def term_shift(spark, sf_dir: str) -> DataFrame:
    return rollup.shift(rollup.baseline(rollup.term_frequency(_terms(spark, sf_dir)))).select("week", "term", "delta", F.col("nth").cast("long").alias("nth"))


TERM_SHIFT = f"""
WITH {ITEMS_SQL}, {FREQUENCY_CTE}, d AS (SELECT week, term, {round_sql('(share - prior) * 100', 1)} AS delta FROM base WHERE prior > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY delta DESC, term) AS nth FROM d WHERE abs(delta) > 1) SELECT * FROM r WHERE nth <= 6
"""


def co_occurrence(spark, sf_dir: str) -> DataFrame:
    """Pairs of terms on three items or more of a week."""
    t = _terms(spark, sf_dir).select("week", "item_id", F.explode("terms").alias("term"))
    return rollup.co_occurrence(t).filter("shared >= 3")


CO_OCCURRENCE = f"WITH {ITEMS_SQL}, {FREQUENCY_CTE} SELECT x.week, x.term AS a, y.term AS b, count(*) AS shared FROM post x JOIN post y ON x.week = y.week AND x.item_id = y.item_id AND x.term < y.term GROUP BY ALL HAVING count(*) >= 3"


def themes(spark, sf_dir: str) -> DataFrame:
    """Merged themes of each week; no SQL, a test holds them against a plain loop."""
    t = _terms(spark, sf_dir)
    postings = t.select("week", "item_id", F.explode("terms").alias("term")).groupBy("week", "term").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return rollup.themes(rollup.lift(rollup.baseline(rollup.term_frequency(t))), postings).select("week", "label", F.array_join("terms", ",").alias("terms"), "score")


def _archive(spark, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir)
    lane = F.element_at(F.array(*[F.lit(x) for x in config.LANES]), (F.col("doc_id") % 4).cast("int") + 1)
    return d.withColumns({"source_name": F.col("source_id"), "primary_lane": lane, "score": (F.col("doc_id") * 37 % 1000) / F.lit(10.0), "watch_hits": F.when(F.col("doc_id") % 6 == 0, F.array(F.lit("w"))).otherwise(F.array()), "year": F.year("day")})


def archive_search(spark, sf_dir: str) -> DataFrame:
    """The best 400 matches of a search."""
    found = rollup.search(_archive(spark, sf_dir), "The an", lane="frontier-science", least=10.0)
    return found.select("doc_id", F.col("day").cast("string").alias("day"), "score")


ARCHIVE_SEARCH = f"""
WITH {ITEMS_SQL} SELECT doc_id, day::VARCHAR AS day, (doc_id * 37 % 1000) / 10.0::DOUBLE AS score FROM items
WHERE contains(lower(title || ' ' || source_id), 'the') AND contains(lower(title || ' ' || source_id), 'an') AND doc_id % 4 = 2 AND (doc_id * 37 % 1000) / 10.0::DOUBLE >= 10 ORDER BY day DESC, score DESC, item_id LIMIT 400
"""


def search_index(spark, sf_dir: str) -> DataFrame:
    """Index rows by year, names numbered by first appearance."""
    a = _archive(spark, sf_dir).withColumn("watched", F.size("watch_hits") > 0)
    rows = rollup.search_index(a)
    return rows.select("year", F.col("arrival_pos").alias("doc_id"), F.col("source_name_code").cast("long").alias("source"), F.col("primary_lane_code").cast("long").alias("lane"), F.col("score").cast("long").alias("score"), "watched", "title")


SEARCH_INDEX = f"""
WITH {ITEMS_SQL}, s AS (SELECT year(day) AS y, source_id, row_number() OVER (PARTITION BY year(day) ORDER BY min(doc_id)) - 1 AS c FROM items GROUP BY 1, 2),
l AS (SELECT year(day) AS y, doc_id % 4 AS k, row_number() OVER (PARTITION BY year(day) ORDER BY min(doc_id)) - 1 AS c FROM items GROUP BY 1, 2)
SELECT year(day)::INTEGER AS year, doc_id, s.c AS source, l.c AS lane, floor((doc_id * 37 % 1000) / 10.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS score, doc_id % 6 = 0 AS watched, title
FROM items i JOIN s ON s.y = year(day) AND s.source_id = i.source_id JOIN l ON l.y = year(day) AND l.k = doc_id % 4
"""


def first_day_of_week_items(spark, sf_dir: str) -> DataFrame:
    """Items of a week and the first day that carries them."""
    d = items(spark, sf_dir).select(F.concat(F.lit("i"), (F.col("doc_id") % 90).cast("string")).alias("item"), "day", F.date_trunc("week", "day").cast("date").cast("string").alias("week"))
    return d.groupBy("week", "item").agg(F.min("day").cast("string").alias("first_day"), F.count("*").alias("carried"))


FIRST_DAY = f"WITH {ITEMS_SQL} SELECT date_trunc('week', day)::DATE::VARCHAR AS week, 'i' || (doc_id % 90) AS item, min(day)::VARCHAR AS first_day, count(*) AS carried FROM items GROUP BY ALL"


def set_operations(spark, sf_dir: str) -> DataFrame:
    """Union with repeats, union, intersection, difference and bag difference of two days' sources, counted."""
    d = items(spark, sf_dir)
    a, b = d.filter("source_kind <> 'trade'").select("source_id"), d.filter("source_kind <> 'journal' AND source_id <> 'src3'").select("source_id")
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("operation"), "n")
    parts = [count("union all", a.unionByName(b)), count("union", a.union(b).distinct()), count("intersect", a.intersect(b)), count("except", a.distinct().subtract(b)), count("except all", a.exceptAll(b))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


SET_OPERATIONS = f"""
WITH {ITEMS_SQL}, a AS (SELECT source_id FROM items WHERE source_kind <> 'trade'), b AS (SELECT source_id FROM items WHERE source_kind <> 'journal' AND source_id <> 'src3')
SELECT 'union all' AS operation, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'except all', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
"""


def star_rollup(spark, sf_dir: str) -> DataFrame:
    """Revenue by region and nation with subtotals: one fact scan, dimensions broadcast by their size. Prices add up as decimals, so
    that no order of rows moves the sum over a whole number."""
    t = lambda n: table(spark, sf_dir, n)
    dim = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t("orders").join(dim, F.col("o_custkey") == F.col("c_custkey"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.floor(F.sum(F.col("o_totalprice").cast("decimal(28,6)"))).cast("long").alias("price"))


STAR_ROLLUP = """
SELECT r_name, n_name, count(*) AS orders, count(DISTINCT o_custkey) AS customers, floor(sum(o_totalprice))::BIGINT AS price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)
"""


def join_shapes(spark, sf_dir: str) -> DataFrame:
    """Semi, anti, left, full and range joins of customers and orders, counted."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("shape"), "n")
    small = o.filter("o_totalprice < 5000")
    out = count("semi", c.join(small, on, "left_semi")).union(count("anti", c.join(small, on, "left_anti"))).union(count("left", c.join(small, on, "left"))).union(count("full", c.join(small, on, "full")))
    return out.union(count("range", c.join(small, on & (F.col("o_totalprice") < F.col("c_acctbal")))))


JOIN_SHAPES = """
WITH o AS (SELECT * FROM orders WHERE o_totalprice < 5000)
SELECT 'semi' AS shape, count(*) AS n FROM customer SEMI JOIN o ON c_custkey = o_custkey UNION ALL SELECT 'anti', count(*) FROM customer ANTI JOIN o ON c_custkey = o_custkey
UNION ALL SELECT 'left', count(*) FROM customer LEFT JOIN o ON c_custkey = o_custkey UNION ALL SELECT 'full', count(*) FROM customer FULL JOIN o ON c_custkey = o_custkey
UNION ALL SELECT 'range', count(*) FROM customer JOIN o ON c_custkey = o_custkey AND o_totalprice < c_acctbal
"""

QUERIES = {
    "source_history": source_history, "health_counts": health_counts, "ring_merge": ring_merge, "first_seen": first_seen, "delivered_repeat": delivered_repeat, "previous_run": previous_run,
    "neighbour_days": neighbour_days, "weekly_tallies": weekly_tallies, "financing_rounds": financing_rounds, "term_baseline": term_baseline, "term_lift": term_lift, "term_shift": term_shift,
    "co_occurrence": co_occurrence, "themes": themes, "archive_search": archive_search, "search_index": search_index, "first_day_of_week_items": first_day_of_week_items,
    "set_operations": set_operations, "star_rollup": star_rollup, "join_shapes": join_shapes,
}
SQL = {
    "source_history": SOURCE_HISTORY, "health_counts": HEALTH_COUNTS, "ring_merge": RING_MERGE, "first_seen": FIRST_SEEN, "delivered_repeat": DELIVERED_REPEAT, "previous_run": PREVIOUS_RUN,
    "neighbour_days": NEIGHBOUR_DAYS, "weekly_tallies": WEEKLY_TALLIES, "financing_rounds": FINANCING_ROUNDS, "term_baseline": TERM_BASELINE, "term_lift": TERM_LIFT, "term_shift": TERM_SHIFT,
    "co_occurrence": CO_OCCURRENCE, "archive_search": ARCHIVE_SEARCH, "search_index": SEARCH_INDEX, "first_day_of_week_items": FIRST_DAY, "set_operations": SET_OPERATIONS,
    "star_rollup": STAR_ROLLUP, "join_shapes": JOIN_SHAPES,
}
