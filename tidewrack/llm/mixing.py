"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source has a target number of words. A document first gets the whole copies that are certain
(target / source size, rounded down); what is left of the target is sampled: documents are ranked by
``odds(u) / odds(p)``, with ``u`` a uniform number drawn from the document's id and ``p`` its inclusion
probability, and taken in that order if their words fit into what is left; a document that does not is passed
over. The document nearest in size to what then still lacks closes the sample if it brings the source nearer to
its target.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own and
comes last; a null doc_id is told from others by its text; rows that repeat are documents of their own; an empty table
gives an empty result; other columns are ignored. Ties in rank fall to the smaller doc_id, then the smaller size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.session import cut, lookup

#: Weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words to take, as a share of all words.
SHARE = 1.5
#: No source, and no document, is taken more often than this.
MOST_COPIES = 2
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str, text: Column | None = None) -> Column:
    """A number above 0 and below 1 that depends on the id and the seed alone, or on the text where the id is null: 52 bits of an MD5 digest."""
    other = F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))) if text is not None else F.lit("")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), other)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, n_docs, target: one row a source. ``sized`` has source and size.

    A source's target is ``min(most * its size, level * its weight)``, with the level at which targets sum to
    the share of all words: resharing excess by weight ends there. Sources are one row each, so ordering them needs no split.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    all_rows = Window.orderBy(F.col("source").isNull(), "source")
    number = (F.row_number().over(all_rows) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumns(
        {
            "left": F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    ).withColumn("level", F.col("left") / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.select("source", "source_size", "n_docs", F.least("most", F.coalesce(level * F.col("weight"), F.col("most"))).alias("target"))


def _passed_over(ranked: DataFrame, lacks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ranked`` and ``lacks`` (l_source, lack) once all documents are sampled that fit when their turn comes.

    A document larger than what is left never fits again. Every round sums the others along the rank as far as they fit;
    the first that does not is too large for the next round, so rounds end with the last open document.
    """
    named = F.col("source").eqNullSafe(F.col("l_source"))
    left = ranked.filter(~F.col("sampled") & F.col("rank").isNotNull() & (F.col("size") > 0)).select("source", "slice", "nth", "size")
    taken = None
    while True:
        left = cut(left.join(lookup(lacks), named).filter("size <= lack").drop("l_source"))
        if left.isEmpty():
            break
        along = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        sums = left.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
        sums = sums.select(F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), F.coalesce(F.sum("slice_size").over(along), F.lit(0)).alias("before"))
        within = Window.partitionBy("source", "slice").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
        summed = left.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice"))).withColumn("upto", F.col("before") + F.sum("size").over(within))
        summed = cut(summed.select("source", "slice", "nth", "size", (F.col("upto") <= F.col("lack")).alias("fits")))
        more = summed.filter("fits").select("source", "slice", "nth")
        taken = more if taken is None else taken.union(more)
        used = summed.filter("fits").groupBy("source").agg(F.sum("size").alias("used"))
        lacks = cut(lacks.join(lookup(used), named, "left").select("l_source", (F.col("lack") - F.coalesce("used", F.lit(0))).alias("lack")))
        left = summed.filter("not fits").select("source", "slice", "nth", "size")
    if taken is None:
        return ranked, lacks
    found = taken.select(F.col("source").alias("t_source"), F.col("slice").alias("t_slice"), F.col("nth").alias("t_nth"))
    same = F.col("source").eqNullSafe(F.col("t_source")) & (F.col("slice") == F.col("t_slice")) & (F.col("nth") == F.col("t_nth"))
    joined = ranked.join(lookup(cut(found)), same, "left").withColumn("sampled", F.col("sampled") | F.col("t_nth").isNotNull())
    return cut(joined.drop("t_source", "t_slice", "t_nth")), lacks


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and the columns in ``keep``: one row for every row of ``docs``.

    Sums run in two levels: sizes are added up by source and slice of rank, slices are summed along the rank,
    and rows only within their slice, so no source has to fit into a task. Slices number about the square root of the rows.
    """
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), uniform(F.col("doc_id"), seed, F.col("text")).alias("u"), *kept))
    rows = sized.count()
    slices = max(8, math.isqrt(max(rows, 1)))
    goal = cut(targets(sized, weights, share, most))
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    goal = goal.withColumn("p", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0))
    goal = goal.withColumnRenamed("source", "goal_source")
    ranked = sized.join(lookup(goal), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    u = F.col("u")
    rank = F.when(F.col("p") > 0, u / (1 - u) * (1 - F.col("p")) / F.col("p"))
    # Within a source the rank grows with u alone, so slices of u are slices of the rank.
    ranked = ranked.withColumn("rank", rank).withColumn("slice", F.floor(u * slices).cast("long"))
    sums = ranked.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    along = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), F.coalesce(F.sum("slice_size").over(along), F.lit(0)).alias("before"))
    ranked = ranked.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & F.col("slice").eqNullSafe(F.col("s_slice"))).drop("s_source", "s_slice")
    within = Window.partitionBy("source", "slice").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumns({"upto": F.col("before") + F.sum("size").over(within), "nth": F.row_number().over(within)})
    ranked = cut(ranked.withColumn("sampled", F.coalesce((F.col("rank").isNotNull()) & (F.col("upto") <= F.col("rest")), F.lit(False))))
    lacks = ranked.groupBy("source").agg((F.first("rest") - F.coalesce(F.max(F.when(F.col("sampled"), F.col("upto"))), F.lit(0))).alias("lack"))
    lacks = lacks.withColumnRenamed("source", "l_source")
    ranked, lacks = _passed_over(ranked, cut(lacks))
    open_rows = ranked.filter(~F.col("sampled") & F.col("rank").isNotNull() & (F.col("size") > 0))
    off = F.abs(F.col("size") - F.col("lack"))
    closing = (
        open_rows.join(lookup(lacks), F.col("source").eqNullSafe(F.col("l_source")))
        .filter(off < F.col("lack"))
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), "rank", "doc_id", "size", "slice", "nth")).alias("c"))
        .select(F.col("source").alias("c_source"), F.col("c.slice").alias("c_slice"), F.col("c.nth").alias("c_nth"))
    )
    out = ranked.join(lookup(closing), F.col("source").eqNullSafe(F.col("c_source")), "left")
    closes = F.coalesce((F.col("slice") == F.col("c_slice")) & (F.col("nth") == F.col("c_nth")), F.lit(False))
    times = F.col("copies") + (F.col("sampled") | closes).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", times.alias("copies"), (F.col("size") * times).alias("taken"), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


def op4_pareto_mix(spark, sf_dir: str) -> DataFrame:
    from tidewrack.session import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS name FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0.0::DOUBLE))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE)) AS level,
         2.0::DOUBLE * source_size / weight AS ratio
  FROM per
  WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT source, source_size, least(most, coalesce((SELECT arg_min(level, ratio) FROM levels WHERE level * weight <= most) * weight, most)) AS target FROM levels
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM goal
), rests AS (
  SELECT *, target - copies * source_size AS rest, CASE WHEN source_size > 0 THEN (target - copies * source_size) / source_size ELSE 0 END AS p FROM parts
), drawn AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.copies, r.rest, r.p,
         (('0x' || substr(md5('mix:' || s.name), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source
), ranked AS (
  SELECT *, CASE WHEN p > 0 THEN u / (1 - u) * (1 - p) / p END AS rnk FROM drawn
), summed AS (
  SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS nth FROM ranked
  WINDOW w AS (PARTITION BY source ORDER BY rnk, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), flagged AS (
  SELECT *, coalesce(rnk IS NOT NULL AND upto <= rest, FALSE) AS sampled FROM summed
), first_lacks AS (
  SELECT source, any_value(rest) - coalesce(max(CASE WHEN sampled THEN upto END), 0) AS lack FROM flagged GROUP BY source
), passed AS (  -- each round takes, along the rank, what of the documents that fit alone fits together; the others wait for the next
  SELECT f.source, f.nth, f.size, l.lack, FALSE AS fits, 0 AS turn FROM flagged f JOIN first_lacks l ON f.source IS NOT DISTINCT FROM l.source
  WHERE NOT f.sampled AND f.rnk IS NOT NULL AND f.size > 0
  UNION ALL
  SELECT source, nth, size, lack - max(CASE WHEN upto <= lack THEN upto ELSE 0 END) OVER (PARTITION BY source) AS lack, upto <= lack AS fits, turn + 1 AS turn
  FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY nth) AS upto FROM passed WHERE NOT fits AND size <= lack)
), lacks AS (
  SELECT l.source, least(l.lack, coalesce(p.lack, l.lack)) AS lack FROM first_lacks l LEFT JOIN (SELECT source, arg_min(lack, -turn) AS lack FROM passed GROUP BY source) p ON l.source IS NOT DISTINCT FROM p.source
), taken AS (
  SELECT f.*, f.sampled OR p.nth IS NOT NULL AS drawn FROM flagged f LEFT JOIN (SELECT DISTINCT source, nth FROM passed WHERE fits) p ON f.source IS NOT DISTINCT FROM p.source AND f.nth = p.nth
), closing AS (
  SELECT f.source, f.nth, row_number() OVER (PARTITION BY f.source ORDER BY abs(f.size - l.lack), f.rnk, f.doc_id, f.size) AS k
  FROM taken f JOIN lacks l ON f.source IS NOT DISTINCT FROM l.source
  WHERE NOT f.drawn AND f.rnk IS NOT NULL AND f.size > 0 AND abs(f.size - l.lack) < l.lack
)
SELECT f.doc_id, f.size, f.source_size, f.target,
       (f.size * (f.copies + CASE WHEN f.drawn OR c.nth IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM taken f LEFT JOIN closing c ON f.source IS NOT DISTINCT FROM c.source AND f.nth = c.nth AND c.k = 1
"""
