"""Queries over text: URLs, markup, tokens, similarity, hashes, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import dates, hashing, markup, text, urls
from tidewrack.plans.items import ITEMS_SQL, dice_sql, items, jaccard_sql, round_sql, shingles_sql, title_sql, tokens_sql
from tidewrack.session import spread, table


def canonical_urls(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"), urls.host_of(F.col("url")).alias("host"))
    return p.withColumn("item_id", urls.item_id(F.col("canonical_url")))


_TRACKING_SQL = urls.TRACKING.replace("'", "''")
CANONICAL_URLS = f"""
WITH parts AS (
  SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
         regexp_replace(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')), ':(80|443)$', '') AS host,
         regexp_extract(url, '^[^?#]*?://[^/?#]*(/[^?#]*)?', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query
  FROM pages
), kept AS (
  SELECT *, list_transform(list_sort(list_transform(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(string_split(p, '=')[1], '{_TRACKING_SQL}')),
         lambda p, i: {{'k': string_split(p, '=')[1], 'i': i, 'p': CASE WHEN contains(p, '=') THEN p ELSE p || '=' END}})), lambda x: x.p) AS pairs FROM parts
), whole AS (
  SELECT page_id, host, scheme || '://' || host || CASE WHEN regexp_matches(path, '^/*$') THEN '/' ELSE regexp_replace(path, '/+$', '') END
         || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END AS canonical_url FROM kept
)
SELECT page_id, canonical_url, host, substr(sha256(canonical_url), 1, 16) AS item_id FROM whole
"""


def html_to_text(spark, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "pages")).select("page_id", markup.html_to_text(F.col("html")).alias("text"))
    return p.select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def _html_sql() -> str:
    decode = "{}"
    for name, value in [*((n, v) for n, v in markup.NAMED.items() if n != "amp"), ("amp", "&")]:
        decode = f"regexp_replace({decode}, '(?i)&{name};', '{value.replace(chr(39), chr(39) * 2)}', 'g')"
    twice = lambda x: decode.format(decode.format(x))
    x = f"CASE WHEN contains(html, '&lt;') OR contains(html, '&gt;') THEN {twice('html')} ELSE html END"
    for element in markup.DROPPED.split("|"):
        x = f"regexp_replace({x}, '(?is)<{element}\\b[^>]*>.*?</{element}>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)<({markup.VOID})\\b[^>]*/?>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)</?({markup.SEPARATING})\\b[^>]*>', ' ', 'g')"
    return f"""
WITH t AS (SELECT page_id, trim(regexp_replace({twice(f"regexp_replace({x}, '<[^>]+>', '', 'g')")}, '\\s+', ' ', 'g')) AS text FROM pages)
SELECT page_id, length(text) AS n_chars, md5(text) AS text_md5 FROM t"""


def token_frequency(spark, sf_dir: str) -> DataFrame:
    """Tokens in 20 documents or more."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(F.array_distinct(text.tokenize(F.col("text")))).alias("token"))
    return d.groupBy("token").agg(F.count("*").alias("docs")).filter("docs >= 20")


TOKEN_FREQUENCY = f"""
SELECT token, count(*) AS docs FROM (SELECT unnest(list_distinct({tokens_sql('text')})) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token HAVING count(*) >= 20
"""


def title_similarity(spark, sf_dir: str) -> DataFrame:
    """Each item's title against the next item's and the one seven further on."""
    t = items(spark, sf_dir).select("doc_id", text.shingles(text.tokenize(text.normalize_title(F.col("title")))).alias("s"))
    ahead = t.select("doc_id", "s", F.explode(F.array(F.lit(1), F.lit(7))).alias("step"))
    other = t.select(F.col("doc_id").alias("other_id"), F.col("s").alias("o"))
    pairs = ahead.join(other, F.col("doc_id") + F.col("step") == F.col("other_id"))
    # What both share is counted once for the three measures.
    pairs = pairs.select("doc_id", "other_id", F.size("s").alias("n"), F.size("o").alias("m"), F.size(F.array_intersect("s", "o")).alias("k"))
    n, m, k, none = F.col("n"), F.col("m"), F.col("k"), (F.col("n") == 0) | (F.col("m") == 0)
    jaccard, dice = F.when(none, 0.0).otherwise(k / (n + m - k)), F.when(none, 0.0).otherwise(k * 2 / (n + m))
    overlap = k / F.greatest(F.lit(1), F.least(n, m))
    return pairs.select("doc_id", "other_id", *[text.floor_round(c, 6).alias(name) for name, c in (("jaccard", jaccard), ("dice", dice), ("overlap", overlap))])


TITLE_SIMILARITY = f"""
WITH {ITEMS_SQL}, tok AS (SELECT doc_id, {tokens_sql(title_sql('title'))} AS t FROM items), s AS (SELECT doc_id, {shingles_sql('t')} AS s FROM tok)
SELECT a.doc_id, b.doc_id AS other_id, {round_sql(jaccard_sql('a.s', 'b.s'))} AS jaccard, {round_sql(dice_sql('a.s', 'b.s'))} AS dice,
       {round_sql('len(list_intersect(a.s, b.s))::DOUBLE / greatest(1, least(len(a.s), len(b.s)))')} AS overlap
FROM s a JOIN (VALUES (1), (7)) AS v(step) ON TRUE JOIN s b ON a.doc_id + v.step = b.doc_id
"""


def title_hashes(spark, sf_dir: str) -> DataFrame:
    """64-bit SimHash of title tokens and pairs, and the bits by which the next item's differs."""
    from tidewrack.operators.clusters import prepared

    p = prepared(items(spark, sf_dir).withColumn("keys", F.array().cast("array<string>"))).select("doc_id", "hash")
    other = p.select((F.col("doc_id") - 1).alias("doc_id"), F.col("hash").alias("o"))
    return p.join(other, "doc_id", "left").select("doc_id", F.lpad(F.lower(F.hex("hash")), 16, "0").alias("hash"), hashing.hamming(F.col("hash"), F.col("o")).cast("long").alias("bits_to_next"))


_FNV_SQL = "list_reduce(list_prepend(2166136261::BIGINT, {codes}), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_CODES = "list_transform(range(1, length(f) + 1), lambda i: ascii(substr(f, i, 1))::BIGINT)"
_PLACED = "list_transform(range(1, length(f) + 1), lambda i: ((ascii(substr(f, i, 1))::BIGINT << 3) | ((i - 1) & 7)))"
TITLE_HASHES = f"""
WITH {ITEMS_SQL}, tok AS (SELECT doc_id, {tokens_sql(title_sql('title'))} AS t FROM items),
feats AS (
  SELECT doc_id, unnest(t) AS f, 1.0::DOUBLE AS w FROM tok
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS f, 2.0::DOUBLE AS w FROM tok
), hashed AS (
  SELECT doc_id, w, {_FNV_SQL.format(codes=_PLACED)} AS hi, {_FNV_SQL.format(codes=_CODES)} AS lo FROM feats
), bits AS (
  SELECT doc_id, i, sum(CASE WHEN ((CASE WHEN i < 32 THEN lo >> i ELSE hi >> (i - 32) END) & 1) = 1 THEN w ELSE -w END) > 0 AS is_set
  FROM hashed, range(0, 64) AS r(i) GROUP BY doc_id, i
), hashes AS (
  SELECT t.doc_id, coalesce(sum(CASE WHEN is_set AND i < 32 THEN 1::BIGINT << i END), 0)::BIGINT AS lo, coalesce(sum(CASE WHEN is_set AND i >= 32 THEN 1::BIGINT << (i - 32) END), 0)::BIGINT AS hi
  FROM tok t LEFT JOIN bits b ON t.doc_id = b.doc_id GROUP BY t.doc_id
)
SELECT a.doc_id, lpad(lower(to_hex(a.hi)), 8, '0') || lpad(lower(to_hex(a.lo)), 8, '0') AS hash, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::BIGINT AS bits_to_next
FROM hashes a LEFT JOIN hashes b ON a.doc_id + 1 = b.doc_id
"""


def truncated(spark, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir)
    flat = text.squish(F.col("body"))
    return d.select("doc_id", text.truncate_words(flat, 80).alias("short"), text.word_count(F.col("body")).cast("long").alias("words"), markup.is_boilerplate(F.col("body")).alias("boilerplate"))


TRUNCATED = rf"""
WITH {ITEMS_SQL}, flat AS (SELECT doc_id, body, trim(regexp_replace(body, '\s+', ' ', 'g')) AS s FROM items),
cut AS (SELECT *, substr(s, 1, 80) AS head, 80 - instr(reverse(substr(s, 1, 80)), ' ') AS last, instr(reverse(substr(s, 1, 80)), ' ') > 0 AS has FROM flat)
SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE regexp_replace(CASE WHEN has AND last > 48 THEN substr(head, 1, last) ELSE head END, '[\s,;:.\-–—]+$', '') || '…' END AS short,
       len(list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS words,
       regexp_matches(trim(body), '{markup.BOILERPLATE.replace("'", "''")}') AS boilerplate
FROM cut
"""


def iso_weeks(spark, sf_dir: str) -> DataFrame:
    """Orders a week: week name, its Monday, first local day in New York, months before."""
    o = table(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    per = o.groupBy(dates.iso_week(d).alias("week"), dates.iso_week_start(F.col("o_orderdate")).cast("string").alias("monday")).agg(
        F.count("*").alias("orders"), F.min(dates.iso_day(F.col("o_orderdate"), "America/New_York")).alias("first_day"), F.min(dates.shift_month(F.date_format("o_orderdate", "yyyy-MM"), -1)).alias("month_before")
    )
    return per


ISO_WEEKS = """
SELECT isoyear(o_orderdate) || '-W' || lpad(weekofyear(o_orderdate)::VARCHAR, 2, '0') AS week, date_trunc('week', o_orderdate)::DATE::VARCHAR AS monday, count(*) AS orders,
       min(strftime(timezone('America/New_York', timezone('UTC', o_orderdate)), '%Y-%m-%d')) AS first_day,
       min(strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m')) AS month_before
FROM orders GROUP BY ALL
"""

#: Dates as feeds write them.
FEED_DATES = ("Jul 31, 2026 8:59am", "2026-08-03", "Wed, 29 Jul 2026 12:10:31 EDT", "not a date", "2026-08-02T07:00:00Z", "3 Aug 2026", "2026-08-01T10:00+02:00", "2027-01-01T00:00:00Z")


def feed_dates(spark, sf_dir: str) -> DataFrame:
    """A raw date of each kind for every document, parsed; counts by outcome."""
    raw = F.element_at(F.array(*[F.lit(x) for x in FEED_DATES]), (F.col("doc_id") % len(FEED_DATES)).cast("int") + 1)
    p = table(spark, sf_dir, "documents").select(raw.alias("raw"), dates.parse_feed_date(raw, F.lit("America/New_York"), F.lit("2026-08-03").cast("timestamp")).alias("p"))
    return p.groupBy("raw", F.date_format("p.date", "yyyy-MM-dd HH:mm:ss").alias("at"), "p.precision", "p.confident").agg(F.count("*").alias("n"))


FEED_DATES_SQL = """
WITH v(i, raw, "at", "precision", confident) AS (VALUES
  (0, 'Jul 31, 2026 8:59am', '2026-07-31 12:59:00', 'minute', TRUE), (1, '2026-08-03', '2026-08-03 12:00:00', 'day', TRUE),
  (2, 'Wed, 29 Jul 2026 12:10:31 EDT', '2026-07-29 16:10:31', 'second', TRUE), (3, 'not a date', NULL, 'unknown', FALSE),
  (4, '2026-08-02T07:00:00Z', '2026-08-02 07:00:00', 'second', TRUE), (5, '3 Aug 2026', '2026-08-03 12:00:00', 'day', TRUE),
  (6, '2026-08-01T10:00+02:00', '2026-08-01 08:00:00', 'minute', TRUE), (7, '2027-01-01T00:00:00Z', '2026-08-04 12:00:00', 'second', FALSE))
SELECT raw, "at", "precision", confident, count(*) AS n FROM documents JOIN v ON doc_id % 8 = i GROUP BY ALL
"""

QUERIES = {
    "canonical_urls": canonical_urls,
    "html_to_text": html_to_text,
    "token_frequency": token_frequency,
    "title_similarity": title_similarity,
    "title_hashes": title_hashes,
    "truncated": truncated,
    "iso_weeks": iso_weeks,
    "feed_dates": feed_dates,
}
SQL = {
    "canonical_urls": CANONICAL_URLS,
    "html_to_text": _html_sql(),
    "token_frequency": TOKEN_FREQUENCY,
    "title_similarity": TITLE_SIMILARITY,
    "title_hashes": TITLE_HASHES,
    "truncated": TRUNCATED,
    "iso_weeks": ISO_WEEKS,
    "feed_dates": FEED_DATES_SQL,
}
