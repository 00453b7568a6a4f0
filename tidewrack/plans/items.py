"""Items made of the documents table, the same in DataFrames and in SQL: every query over items starts here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.text import FOLD_FROM, FOLD_TO
from tidewrack.session import spread, table

#: Terms that occur in the tables' invented languages stand in for a lane's own.
LEXICON = {
    "clinical-regulatory": {"the": 1.0, "of the": 3.0, "that": 2.0, "with": 1.5},
    "business-deals": {"and": 1.5, "in": 1.0, "for": 2.5, "to the": 3.0},
    "frontier-science": {"le": 2.0, "de": 1.0, "que": 1.5, "de la": 3.0, "el": 2.0},
    "aging-omics": {"der": 2.0, "und": 1.0, "die": 1.5, "in der": 3.0},
}


def published_at(doc_id: Column) -> Column:
    return F.timestamp_micros((F.lit(1785542400) + doc_id * 2220) * 1_000_000)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, arrival_pos, title, body, url, item_id, source_id, publisher_group, source_kind, authority, published_at, day."""
    d = spread(table(spark, sf_dir, "documents")).filter(F.col("text").isNotNull() & F.col("source").isNotNull())
    n = F.substring("source", 4, 9).cast("int")
    # A title takes twelve words: after them (and an empty one before leading spaces) the text stays in one piece.
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", 14), lambda w: w != "")
    at = published_at(F.col("doc_id"))
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/a/"), (F.col("doc_id") % 400).cast("string"))
    return d.select(
        "doc_id",
        F.col("doc_id").alias("arrival_pos"),
        F.array_join(F.slice(words, 1, 12), " ").alias("title"),
        F.col("text").alias("body"),
        url.alias("canonical_url"),
        F.substring(F.sha2(F.concat(url, F.lit("#"), F.col("doc_id").cast("string")), 256), 1, 16).alias("item_id"),
        F.col("source").alias("source_id"),
        F.concat(F.lit("g"), (n % 7).cast("string")).alias("publisher_group"),
        F.element_at(F.array(*[F.lit(x) for x in ("journal", "preprint", "news", "news", "trade")]), n % 5 + 1).alias("source_kind"),
        ((n * 7 % 20) / F.lit(20.0)).alias("authority"),
        at.alias("published_at"),
        F.to_date(at).alias("day"),
    )


ITEMS_SQL = """items AS (
  SELECT doc_id, doc_id AS arrival_pos,
         array_to_string(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')[1:12], ' ') AS title, text AS body,
         'https://' || source || '.example.com/a/' || (doc_id % 400) AS canonical_url,
         substr(sha256('https://' || source || '.example.com/a/' || (doc_id % 400) || '#' || doc_id), 1, 16) AS item_id,
         source AS source_id, 'g' || (substr(source, 4)::INT % 7) AS publisher_group,
         ['journal', 'preprint', 'news', 'news', 'trade'][substr(source, 4)::INT % 5 + 1] AS source_kind,
         (substr(source, 4)::INT * 7 % 20) / 20.0::DOUBLE AS authority,
         make_timestamp((1785542400 + doc_id * 2220) * 1000000) AS published_at,
         make_timestamp((1785542400 + doc_id * 2220) * 1000000)::DATE AS day
  FROM documents WHERE text IS NOT NULL AND source IS NOT NULL
)"""


def fold_sql(x: str) -> str:
    return f"translate(lower({x}), '{FOLD_FROM}', '{FOLD_TO}')"


def tokens_sql(x: str) -> str:
    from tidewrack.config import STOPWORDS

    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter(string_split(regexp_replace({fold_sql(x)}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) > 1 AND t NOT IN ({stop}))"


def title_sql(x: str) -> str:
    return f"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)^\\s*STAT\\+:\\s*', ''), '\\s+[-–|]\\s+[^-–|]{{2,40}}$', ''), '&', ' and ', 'g'), '\\s+', ' ', 'g'))"""


def shingles_sql(tokens: str) -> str:
    return f"list_sort(list_distinct(list_transform(range(1, length(array_to_string({tokens}, ' ')) - 1), lambda i: substr(array_to_string({tokens}, ' '), i, 3))))"


def jaccard_sql(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)"


def dice_sql(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b})) * 2::DOUBLE / (len({a}) + len({b})) END)"


def round_sql(x: str, digits: int = 6) -> str:
    return f"(floor(({x}) * {10.0**digits}::DOUBLE + 0.5::DOUBLE) / {10.0**digits}::DOUBLE)"
