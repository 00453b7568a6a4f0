"""Queries of what readers see: values on display, names, cards, alerts, manifests, checks of live items, dispatch of JSON sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack import config
from tidewrack.functions import dates, display
from tidewrack.operators import daily, publish, watchlist
from tidewrack.plans import daily as days
from tidewrack.plans import digest as d
from tidewrack.plans.flows import NOW, _landed
from tidewrack.plans.items import ITEMS_SQL, items
from tidewrack.session import table
from tidewrack.sources import landing


def display_formats(spark, sf_dir: str) -> DataFrame:
    """Days, days passed, weeks and sums of orders as readers see them."""
    at = F.col("o_orderdate").cast("timestamp")
    now = F.lit("1998-01-01").cast("timestamp")
    value = F.floor(F.col("o_totalprice") / 100).cast("double")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", display.day(at, "UTC").alias("day"), display.short_day(at, "UTC").alias("short_day"), display.relative_days(at, now).alias("passed"),
        display.week_label(dates.iso_week(at)).alias("week"), display.usd_millions(value).alias("usd"),
    )


DISPLAY_FORMATS = """
WITH o AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS t, floor(o_totalprice / 100)::DOUBLE AS v, floor((epoch_us(TIMESTAMP '1998-01-01') - epoch_us(o_orderdate::TIMESTAMP)) / 86400000000)::BIGINT AS n FROM orders)
SELECT o_orderkey, strftime(t, '%b %-d, %Y') AS day, strftime(t, '%b %-d') AS short_day, CASE WHEN n <= 0 THEN 'today' WHEN n = 1 THEN 'yesterday' ELSE n || ' days ago' END AS passed,
  'Week ' || lpad(weekofyear(t)::VARCHAR, 2, '0') || ' of ' || isoyear(t) AS week,
  '$' || CASE WHEN v >= 1000 THEN CASE WHEN v % 1000 = 0 THEN (v / 1000)::BIGINT::VARCHAR ELSE (floor(v / 1000 * 10 + 0.5::DOUBLE) / 10)::DOUBLE::VARCHAR END || 'B' ELSE v::BIGINT || 'M' END AS usd FROM o
"""
#: Titles as a catalogue has them, taken in turn; items' own titles stand between them.
TITLES = ("Lancet (London, England)", "The Lancet. Oncology", "The lancet. Psychiatry", "JAMA", "Science (New York, N.Y.)", "The New England journal of medicine", "Cell host & microbe", "Nature : the journal", "Med (New York, N.Y.).")


def journal_names(spark, sf_dir: str) -> DataFrame:
    """Journals by the names that readers know."""
    n = (F.col("doc_id") % (len(TITLES) + 3)).cast("int")
    raw = F.when(n < len(TITLES), F.get(F.array(*[F.lit(x) for x in TITLES]), n)).otherwise(F.concat("title", F.lit(" : a part (2026)")))
    return items(spark, sf_dir).groupBy(display.journal_name(raw).alias("journal")).agg(F.count("*").alias("n"))


_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in config.JOURNAL_NAMES.items())
JOURNAL_NAMES = rf"""
WITH {ITEMS_SQL}, raw AS (SELECT CASE WHEN doc_id % {len(TITLES) + 3} < {len(TITLES)} THEN [{', '.join(f"'{x}'" for x in TITLES)}][doc_id % {len(TITLES) + 3} + 1] ELSE title || ' : a part (2026)' END AS t FROM items),
c AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\s*\([^)]*\)\s*$', ''), '\s+:\s+.*$', ''), '\.\s+', ' ', 'g'), '\.$', ''), '\s+', ' ', 'g')) AS t FROM raw),
names(k, v) AS (VALUES {_NAMES}) SELECT coalesce(v, t) AS journal, count(*) AS n FROM c LEFT JOIN names ON lower(t) = k GROUP BY 1
"""


def live_problems(spark, sf_dir: str) -> DataFrame:
    """What items fresh from a source must not show, by source."""
    k = F.col("doc_id")
    bad = items(spark, sf_dir).withColumns({
        "title": F.when(k % 53 == 0, F.concat("title", F.lit(" [object Object]"))).when(k % 59 != 0, F.col("title")),
        "canonical_url": F.when(k % 47 == 0, F.concat("canonical_url", F.lit("/premium/x"))).when(k % 31 == 0, F.concat("canonical_url", F.lit("?a=1&utm_source=y"))).otherwise(F.col("canonical_url")),
        "published_at": F.when(k % 29 != 0, F.col("published_at")),
    })
    return publish.live_problems(bad)


LIVE_PROBLEMS = f"""
WITH {ITEMS_SQL}, p AS (SELECT source_id, unnest(list_filter([CASE WHEN doc_id % 53 <> 0 AND (doc_id % 59 = 0 OR title = '') THEN 'no title' END, CASE WHEN doc_id % 53 = 0 THEN 'object leaked into title' END,
  CASE WHEN doc_id % 47 = 0 THEN 'sponsored URL survived' END, CASE WHEN doc_id % 47 <> 0 AND doc_id % 31 = 0 THEN 'tracking parameter survived' END, CASE WHEN doc_id % 29 = 0 THEN 'no date' END], lambda x: x IS NOT NULL)) AS problem FROM items)
SELECT source_id, problem, count(*) AS n FROM p GROUP BY ALL
"""


def json_dispatch(spark, sf_dir: str) -> DataFrame:
    """Bodies of JSON sources, each read by what its source speaks; sources that no reader knows are warned of."""
    date = F.date_format("published_at", "yyyy-MM-dd")
    record = F.to_json(F.struct(F.col("item_id").alias("id"), F.lit("MED").alias("source"), "title", F.col("title").alias("abstractText"), date.alias("firstPublicationDate")))
    nct = F.concat(F.lit("NCT"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    trial = F.to_json(F.struct(F.struct(F.struct(nct.alias("nctId"), F.col("title").alias("briefTitle")).alias("identificationModule"), F.struct(F.struct(date.alias("date")).alias("lastUpdatePostDateStruct")).alias("statusModule")).alias("protocolSection")))
    n = F.substring("source_id", 4, 9).try_cast("int")
    literature = _landed(spark, sf_dir, record, '{"resultList":{"result":[', "]}}").filter(n % 3 == 0).withColumn("source_id", F.concat(F.lit("europepmc-"), "source_id"))
    trials = _landed(spark, sf_dir, trial, '{"studies":[', "]}").filter(n % 3 == 1).withColumn("source_id", F.lit("clinicaltrials"))
    rest = _landed(spark, sf_dir, record, "{", "}").filter(n % 3 == 2)
    found, unknown = landing.json_items(literature.unionByName(trials).unionByName(rest), F.lit(NOW).cast("timestamp"))
    return found.groupBy("source_id", F.col("body_provenance").alias("what")).agg(F.count("*").alias("n")).union(unknown.groupBy("source_id", F.substring_index("warning", " ", 3).alias("what")).agg(F.lit(0).cast("long").alias("n")))


JSON_DISPATCH = f"""
WITH {ITEMS_SQL}, m AS (SELECT *, substr(source_id, 4)::INT AS k FROM items)
SELECT 'europepmc-' || source_id AS source_id, CASE WHEN title <> '' THEN 'abstract' ELSE 'none' END AS what, count(*) AS n FROM m WHERE k % 3 = 0 GROUP BY ALL
UNION ALL SELECT 'clinicaltrials', 'api', count(*) FROM m WHERE k % 3 = 1 HAVING count(*) > 0 UNION ALL SELECT source_id, 'no json reader', 0 FROM m WHERE k % 3 = 2 GROUP BY source_id
"""


def site_manifest(spark, sf_dir: str) -> DataFrame:
    """The latest day, all days, weeks and years, newest first."""
    own = items(spark, sf_dir)
    found = publish.manifest(own.select(F.col("day").alias("digest_date")), own.select(dates.iso_week(F.col("day")).alias("week")))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("latest", joined("days"), joined("weeks"), joined("years"), "build")


SITE_MANIFEST = f"""
WITH {ITEMS_SQL} SELECT max(day)::VARCHAR AS latest, array_to_string(list_reverse_sort(list(DISTINCT day::VARCHAR)), ',') AS days,
  array_to_string(list_reverse_sort(list(DISTINCT isoyear(day) || '-W' || lpad(weekofyear(day)::VARCHAR, 2, '0'))), ',') AS weeks, array_to_string(list_reverse_sort(list(DISTINCT year(day))), ',') AS years, 'dev' AS build FROM items
"""


def content_hashes(spark, sf_dir: str) -> DataFrame:
    """Pages by the hash of their content: what is fetched again unchanged."""
    return table(spark, sf_dir, "pages").groupBy(display.content_hash(F.col("html")).alias("hash")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


CONTENT_HASHES = "SELECT substr(sha256(html), 1, 16) AS hash, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1"


def alert_items(spark, sf_dir: str) -> DataFrame:
    """Each day's items with alerts, each once, the best fifteen."""
    own, found = d._hits(spark, sf_dir)
    own = own.withColumn("digest_date", F.col("day"))
    best = publish.alert_items(watchlist.alerts(found, own), own.select("digest_date", "item_id", "doc_id", "score"))
    return best.select(F.col("digest_date").cast("string").alias("digest_date"), "doc_id", "score", F.col("nth").cast("long").alias("nth"))


ALERT_ITEMS = f"""
WITH {ITEMS_SQL}, {d.LANES_CTE}, {d.HITS_CTE}, a AS (SELECT DISTINCT doc_id, score FROM h WHERE len(fnd) > 0 AND doc_id % 4 <> 0 AND (priority OR score >= min_score)),
r AS (SELECT day::VARCHAR AS digest_date, a.doc_id, a.score, row_number() OVER (PARTITION BY day ORDER BY a.score DESC, item_id) AS nth FROM a JOIN items i ON a.doc_id = i.doc_id) SELECT * FROM r WHERE nth <= 15
"""


def new_phase3(spark, sf_dir: str) -> DataFrame:
    """The first twelve trials of each week's registry items."""
    own = items(spark, sf_dir).filter("source_kind = 'trade'").select(F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week"), "arrival_pos", "title", F.col("source_id").alias("sponsor"), F.when(F.col("doc_id") % 3 != 0, F.array(F.concat(F.lit("NCT"), F.lpad(F.col("doc_id").cast("string"), 8, "0")))).otherwise(F.array()).alias("nct"))
    return publish.new_phase3(own).withColumn("nth", F.col("nth").cast("long"))


NEW_PHASE3 = f"""
WITH {ITEMS_SQL}, t AS (SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS week, 'NCT' || lpad(doc_id::VARCHAR, 8, '0') AS nct, title, source_id AS sponsor, doc_id FROM items WHERE source_kind = 'trade' AND doc_id % 3 <> 0),
r AS (SELECT week, nct, title, sponsor, row_number() OVER (PARTITION BY week ORDER BY doc_id) AS nth FROM t) SELECT * FROM r WHERE nth <= 12
"""


def digest_cards(spark, sf_dir: str) -> DataFrame:
    """The kept items of every day as cards; no SQL, a test holds their lines against plain loops."""
    cards = publish.digest_items(days._digest(spark, sf_dir)[0])
    return cards.select(F.col("digest_date").cast("string").alias("digest_date"), F.col("pos").cast("long").alias("pos"), "title", "facts_line", "why_line", "kind_label", F.array_join("badges", ", ").alias("badges"), F.size("digest").cast("long").alias("sentences"))


def weekly_item_terms(spark, sf_dir: str) -> DataFrame:
    """Terms of seven kinds by week: items that have them; no SQL, a test holds them against a plain loop."""
    found = daily.enriched(days.day_items(spark, sf_dir).filter("title IS NOT NULL"), days.MAJOR)
    terms = found.select(F.date_format(F.date_trunc("week", "digest_date"), "yyyy-MM-dd").alias("week"), F.explode(publish.item_terms()).alias("term"))
    return terms.groupBy("week", "term").agg(F.count("*").alias("docs"))


QUERIES = {
    "display_formats": display_formats, "journal_names": journal_names, "live_problems": live_problems, "json_dispatch": json_dispatch, "site_manifest": site_manifest, "content_hashes": content_hashes,
    "alert_items": alert_items, "new_phase3": new_phase3, "digest_cards": digest_cards, "weekly_item_terms": weekly_item_terms,
}
SQL = {
    "display_formats": DISPLAY_FORMATS, "journal_names": JOURNAL_NAMES, "live_problems": LIVE_PROBLEMS, "json_dispatch": JSON_DISPATCH, "site_manifest": SITE_MANIFEST, "content_hashes": CONTENT_HASHES,
    "alert_items": ALERT_ITEMS, "new_phase3": NEW_PHASE3,
}
