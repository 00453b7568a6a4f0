"""Line dedup by a log-template tree, in DataFrame operations only.

Lines are separated by line feeds, tokens by ASCII white space; tokens with a digit are variable fields from the start,
unless nothing else is left of the line. The tree has fixed depth: number of tokens, then the ``LEAD`` leading tokens. In a leaf,
a token's support is the number of different lines that have it at its place. A line's level is the support that
``ALIKE`` of its tokens reach; tokens of half that support, and of two lines at least, are literal. At its other places
stands the most frequent token of the leaf if that is literal by the same measure, else a field. That is the line's
template: it depends on the leaf's own numbers, so values that recur stay values however large the corpus, and a few
changed words lead back to the common form. Lines without such a level are templates of their own.

A template found in two documents or more recurs: its lines are dropped, all but the first by (doc_id, text digest,
position). What is dropped thus has an earlier line of its template, and a template's first line always stays.

Lines travel as 64-bit hashes; equal lines are pre-aggregated, so a line that a third of the documents share is one row a
task. Tokens are looked up again only for one line of each kind in leaves of several.

Defined cases: lines of white space alone are kept; a null text stays null with no lines; an empty text is one empty
line; rows equal in doc_id and text are one document, treated alike; null ids come first; of tokens with equal support
none is the most frequent; lines and tokens may be of any length; an empty table gives no rows. Other columns
pass through ``drop_recurring``, except n_lines and n_dropped, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.rows import shielded
from tidewrack.session import cut, lookup, stored

LEAD = 3
#: Lines to read again whose places (some 60 bytes each) are sent to every executor; for more, texts are dealt out by document.
PLACES = 200_000
#: Share of a line's tokens, in tenths, that reach its level.
ALIKE = 7
WHITE = r"\x20\x09-\x0D"
FIELD = "<*>"
_DIGITS = rf"(?<![^{WHITE}])[^{WHITE}0-9]*[0-9][^{WHITE}]*"
#: A value worked out once for several uses: lambdas bind it, plain columns would repeat it.
_once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)


def _spaced(line: Column) -> Column:
    """Tokens separated by one space. Lines without odd white space, most of all, are only looked through."""
    odd = line.contains("  ")
    for c in "\t\n\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.trim(F.when(odd, F.regexp_replace(line, rf"[{WHITE}]+", " ")).otherwise(line))


def masked(line: Column) -> Column:
    """Tokens separated by one space, those with a digit as fields; as they are if all have one."""
    fields = lambda x: _once(_spaced(F.regexp_replace(x, _DIGITS, FIELD)), lambda m: F.when(F.trim(F.replace(m, F.lit(FIELD), F.lit(""))) == "", _spaced(x)).otherwise(m))
    return F.when(line.rlike("[0-9]"), fields(line)).otherwise(_spaced(line))


def candidate_lines(keyed: DataFrame) -> DataFrame:
    """doc_id, digest, pos, leaf, line: the lines that may be templates, as hashes."""
    tokens = lambda m: F.size(F.split(m, " ", -1))
    parsed = lambda m: F.when(m != "", F.struct(F.xxhash64(tokens(m), F.substring_index(m, " ", LEAD)).alias("leaf"), F.xxhash64(m).alias("line")))
    each = F.transform(F.split(F.col("text"), "\n", -1), lambda x: _once(masked(x), parsed))
    lines = keyed.select("doc_id", "digest", F.posexplode(each).alias("pos", "p")).filter(F.col("p").isNotNull())
    return lines.select("doc_id", "digest", "pos", "p.leaf", "p.line")


def _distinct(lines: DataFrame) -> DataFrame:
    """leaf, line, first, last: the different lines."""
    place = F.struct("doc_id", "digest", "pos")
    return stored(lines.groupBy("leaf", "line").agg(F.min(place).alias("first"), F.max(F.struct("doc_id", "digest")).alias("last")))


def _again() -> Column:
    """Whether first and last lie in different documents."""
    return ~(F.col("first.doc_id").eqNullSafe(F.col("last.doc_id")) & (F.col("first.digest") == F.col("last.digest")))


def _tokens(keyed: DataFrame, varied: DataFrame) -> DataFrame:
    """leaf, line, t: the tokens, as hashes, of the lines of leaves that hold several, read again where they first stand."""
    wanted = varied.groupBy(F.col("first.doc_id").alias("w_id"), F.col("first.digest").alias("w_digest"))
    wanted = stored(wanted.agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "leaf", "line")).alias("wanted")))
    if varied.limit(PLACES + 1).count() <= PLACES:
        wanted = F.broadcast(wanted)
    found = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("digest") == F.col("w_digest")))
    hashes = lambda line: F.transform(F.split(masked(line), " ", -1), lambda x: F.xxhash64(x))
    read = _once(F.split("text", "\n", -1), lambda lines: F.transform("wanted", lambda w: F.struct(w["leaf"].alias("leaf"), w["line"].alias("line"), hashes(F.get(lines, w["pos"])).alias("t"))))
    # Rows that repeat are read once each; their lines count once.
    return stored(found.select(F.explode(read).alias("x")).select("x.leaf", "x.line", "x.t").dropDuplicates(["line"]))


def general_templates(tokens: DataFrame) -> DataFrame:
    """line, template: the lines that have a level of two or more."""
    each = tokens.select("leaf", "line", F.posexplode("t").alias("at", "token"))
    counts = stored(each.groupBy("leaf", "at", "token").agg(F.count("*").alias("n")).filter("n > 1"))
    # The most frequent token of a place; of several with equal support none is. By leaf, as an array over all places.
    most, least = F.max(F.struct("n", "token")).alias("most"), F.min(F.struct((-F.col("n")).alias("n"), "token")).alias("least")
    usual = counts.groupBy("leaf", "at").agg(most, least).filter("most.token = least.token").select("leaf", F.struct("at", "most.n", "most.token").alias("u"))
    usual = usual.groupBy("leaf").agg(F.array_sort(F.collect_list("u")).alias("u"))
    before = lambda k: F.when(k > 0, F.get("u", k - 1)["at"]).otherwise(-1)
    spread = F.flatten(F.transform("u", lambda x, k: F.concat(F.array_repeat(F.lit(None).cast("struct<at:int,n:bigint,token:bigint>"), x["at"] - before(k) - 1), F.array(x))))
    usual = stored(usual.select("leaf", spread.alias("u")))
    place = F.xxhash64("leaf", "at", "token").alias("place")
    supports = each.select(place, "line", "at").join(lookup(counts.select(place, "n")), "place", "left")
    supports = supports.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(1)).alias("n")))).alias("s"))
    supports = supports.select("line", F.col("s.n").alias("s"))
    level = F.get(F.sort_array("s", asc=False), F.floor((F.size("s") * ALIKE + 9) / 10).cast("int") - 1)
    lines = tokens.join(supports, "line").withColumn("level", level).filter("level >= 2").withColumn("least", F.greatest(F.lit(2), F.ceil(F.col("level") / 2)))
    lines = lines.join(usual, "leaf", "left")
    form = F.transform("t", lambda x, i: F.when(F.get("s", i) >= F.col("least"), x).when(F.get("u", i)["n"] >= F.col("least"), F.get("u", i)["token"]).otherwise(F.xxhash64(F.lit(FIELD))))
    return lines.select("line", F.xxhash64("leaf", form).alias("template"))


def recurring(keyed: DataFrame, lines: DataFrame) -> DataFrame:
    """leaf, line, first: the lines whose template recurs, and its first place (doc_id, digest, pos)."""
    distinct = _distinct(lines)
    leaves = distinct.groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1").select("leaf")
    varied = stored(distinct.join(lookup(cut(leaves)), "leaf"))
    general = cut(general_templates(_tokens(keyed, varied)))
    named = stored(varied.join(lookup(general), "line"))
    templates = named.groupBy("template").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter(_again()).select("template", "first")
    # A line that is equal in two documents recurs by itself; its template, if it has one, has the earlier first place.
    shared = named.select("leaf", "line", "template").join(templates, "template").select("leaf", "line", "first")
    return shared.union(distinct.filter(_again()).select("leaf", "line", "first")).groupBy("leaf", "line").agg(F.min("first").alias("first"))


def drop_recurring(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines gone from text, and n_lines, n_dropped (replaced if there)."""
    docs, restored = shielded(docs.drop("n_lines", "n_dropped"), "doc_id", "text")
    docs = docs.withColumn("digest", F.xxhash64("text"))
    keyed = docs.select("doc_id", "text", "digest")
    lines = stored(candidate_lines(keyed))
    gone = lines.join(lookup(cut(recurring(keyed, lines))), ["leaf", "line"]).filter(~F.struct("doc_id", "digest", "pos").eqNullSafe(F.col("first")))
    by_document = gone.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("pos")).alias("gone")).select(F.col("doc_id").alias("g_id"), F.col("digest").alias("g_digest"), "gone")
    joined = docs.join(by_document, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("digest") == F.col("g_digest")), "left")
    raw = F.split(F.col("text"), "\n", -1)
    # What lies between two dropped lines is one slice, so this takes time in proportion to the lines.
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("raw")))
    gaps = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice(F.col("raw"), F.get(F.col("edges"), k) + 2, F.get(F.col("edges"), k + 1) - F.get(F.col("edges"), k) - 1))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(gaps), "\n"))
    out = joined.withColumn("raw", F.when(F.col("gone").isNotNull(), raw)).withColumn("edges", F.when(F.col("gone").isNotNull(), edges))
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.size(raw), F.lit(0))).cast("long"))
    out = out.withColumns({"n_dropped": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"), "text": kept})
    return restored(out, "n_lines", "n_dropped")


def op3_template_tree(spark, sf_dir: str) -> DataFrame:
    from tidewrack.session import table

    return drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
WITH raw AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, i - 1 AS pos,
         trim(regexp_replace(lines[i], '[\x20\x09-\x0D]+', ' ', 'g')) AS plain,
         trim(regexp_replace(regexp_replace(lines[i], '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS fields
  FROM raw, unnest(range(1, len(lines) + 1)) AS r(i)
), formed AS (
  SELECT doc_id, pos, CASE WHEN trim(replace(fields, '<*>', '')) = '' THEN plain ELSE fields END AS m FROM lines
), cand AS (
  SELECT doc_id, pos, m, string_split(m, ' ') AS t, len(string_split(m, ' '))::VARCHAR || ':' || array_to_string(string_split(m, ' ')[1:3], ' ') AS leaf
  FROM formed WHERE m <> ''
), dis AS (
  SELECT leaf, m, min((doc_id, pos)) AS first, max(doc_id) AS last, any_value(t) AS t FROM cand GROUP BY leaf, m
), varied AS (
  SELECT leaf FROM dis GROUP BY leaf HAVING count(*) > 1
), tokens AS (
  SELECT leaf, m, i AS nth, t[i] AS token, len(t) AS n FROM dis JOIN varied USING (leaf), unnest(range(1, len(t) + 1)) AS r(i)
), counts AS (
  SELECT leaf, nth, token, count(*) AS k FROM tokens GROUP BY leaf, nth, token
), usual AS (
  SELECT leaf, nth, any_value(token) AS token, any_value(k) AS k FROM (SELECT *, max(k) OVER (PARTITION BY leaf, nth) AS most FROM counts) WHERE k = most GROUP BY leaf, nth HAVING count(*) = 1
), placed AS (
  SELECT t.leaf, t.m, any_value(t.n) AS n, list((t.nth, t.token, c.k, u.k, u.token) ORDER BY t.nth) AS p
  FROM tokens t JOIN counts c ON t.leaf = c.leaf AND t.nth = c.nth AND t.token = c.token LEFT JOIN usual u ON t.leaf = u.leaf AND t.nth = u.nth GROUP BY t.leaf, t.m
), levels AS (
  SELECT *, list_reverse_sort(list_transform(p, lambda x: x[3]))[(7 * n + 9) // 10] AS level FROM placed
), found AS (
  SELECT leaf, m, list_transform(p, lambda x: CASE WHEN x[3] >= greatest(2, (level + 1) // 2) THEN x[2] WHEN x[4] >= greatest(2, (level + 1) // 2) THEN x[5] ELSE '<*>' END) AS form
  FROM levels WHERE level >= 2
), named AS (
  SELECT d.leaf, d.m, d.first, d.last, CASE WHEN f.form IS NOT NULL THEN 'g' || d.leaf || chr(1) || array_to_string(f.form, ' ') ELSE 'l' || d.m END AS template
  FROM dis d LEFT JOIN found f USING (leaf, m)
), again AS (
  SELECT template, min(first) AS first FROM named GROUP BY template HAVING min(first)[1] <> max(last)
), gone AS (
  SELECT c.doc_id, list(DISTINCT c.pos) AS gone
  FROM cand c JOIN named USING (leaf, m) JOIN again a ON named.template = a.template WHERE (c.doc_id, c.pos) <> a.first GROUP BY c.doc_id
)
SELECT r.doc_id,
       CASE WHEN g.gone IS NULL THEN r.text ELSE array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(g.gone, i - 1)), lambda i: lines[i]), chr(10)) END AS text,
       coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(g.gone), 0)::BIGINT AS n_dropped
FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id
"""
