"""Queries on tables that the smallest ones don't stand for: later ids, odd texts, several copies."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from compare import rows, spark_rows
from tidewrack.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
LATE = [(i, f"The trial {i} of the drug and le reste", f"src{i % 20}") for i in (0, 1, 2, 199, 200, 2399, 2400, 9999, 250000)]


def write(folder, documents):
    """A folder of tables in which ``documents`` stand for the documents and all others are empty."""
    ids, texts, sources = zip(*documents, strict=True)
    t = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(ids), "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})
    pq.write_table(t, folder / "documents.parquet")
    return str(folder)


def document_rows(sql, where):
    """What the SQL makes of the documents alone."""
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet'")
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(names), rows(names, found.fetchall())


@pytest.mark.parametrize("name", ["feed_items", "literature_items", "trial_items"])
def test_entries_of_later_years_keep_their_dates(spark, tmp_path, name):
    where = write(tmp_path, LATE)
    assert spark_rows(QUERIES[name](spark, where)) == document_rows(SQL[name], where)


ODD = [
    *[(i, " ".join(("the", "of the", "que", "und", "zoo")[(i * k) % 5] for k in range(1, 1 + i % 40)) + " end", f"src{i % 4}") for i in range(90)],
    (90, "", "src1"), (91, " \n\t ", "src1"), (92, "İn the", "src2"), (None, "of the", "src1"), (None, "", "src2"), (93, None, "src1"), (94, "the", None), (-7, "in der", "src3"), (114_000_000, "die und", "src3"),
]


@pytest.mark.parametrize("name", ["drop_counts", "lane_lists", "round_robin", "lane_scores"])
def test_blank_texts_null_ids_and_far_days_are_as_in_the_sql(spark, tmp_path, name):
    where = write(tmp_path, ODD)
    assert spark_rows(QUERIES[name](spark, where)) == document_rows(SQL[name], where)


def test_the_end_of_a_long_text_ranks_items_too(spark, tmp_path):
    where = write(tmp_path, [(0, "one " * 500 + "und die in der", "src1"), (1, "one " * 500, "src1")])
    found = {r.doc_id: (r.primary_lane, r.score) for r in QUERIES["round_robin"](spark, where).collect()}
    assert found[0][0] == "aging-omics" and found[0][1] > 0 and found[1][1] == 0
    assert spark_rows(QUERIES["lane_lists"](spark, where)) == document_rows(SQL["lane_lists"], where)


def test_the_text_of_shingles_is_made_once(spark):
    from pyspark.sql import functions as F

    from tidewrack.functions.text import shingles, tokenize

    assert str(shingles(tokenize(F.col("title"), keep_stopwords=True))).count("regexp_replace") == str(tokenize(F.col("title"), keep_stopwords=True)).count("regexp_replace")


def test_links_of_components_and_twins_are_enough(spark):
    """Equal URLs as stars give the clusters of all pairs, with fewer rows; pairs are judged where they meet, each once."""
    from datetime import datetime, timedelta

    from tidewrack.operators import clusters

    rows = [
        (f"i{n:02}", f"one two three {'four' if n % 7 else 'seven'} five six {'x' * (n % 3)}", f"https://x/{n % 3}" if n % 5 else None, datetime(2026, 8, 1) + timedelta(hours=31 * n) if n % 4 else None,
         ("news", "journal")[n % 2], ["co:a", "nct:1"][: n % 3], f"g{n % 3}", n / 50, n) for n in range(40)
    ]
    items = clusters.prepared(spark.createDataFrame(rows, "item_id string, title string, canonical_url string, published_at timestamp, source_kind string, keys array<string>, publisher_group string, authority double, body_length int"))
    every, few = clusters.links(items).cache(), clusters.links(items, every=False).cache()
    assert every.select("a", "b").distinct().count() == every.count() and every.filter("a >= b").count() == 0
    assert few.filter("shared_url AND title_jaccard IS NULL").count() < every.filter("shared_url").count()
    assert sorted(map(tuple, clusters.clusters(items, every).collect())) == sorted(map(tuple, clusters.clusters(items, few).collect()))


def test_revenue_is_the_exact_sum(spark, tmp_path):
    one = lambda name, **columns: pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    one("region", r_regionkey=[0], r_name=["R"])
    one("nation", n_nationkey=[0], n_name=["N"], n_regionkey=[0])
    one("customer", c_custkey=[1], c_nationkey=[0])
    one("orders", o_orderkey=list(range(10)), o_custkey=[1] * 10, o_totalprice=[0.1] * 10)  # 0.9999999999999999 in doubles
    assert {r.price for r in QUERIES["star_rollup"](spark, str(tmp_path)).collect()} == {1}


def test_pages_without_escaped_markup_are_not_sent_to_be_decoded_whole(spark):
    from pyspark.sql import functions as F

    from tidewrack.functions import markup

    sent = []
    pages = spark.createDataFrame([("<p>a &amp; b</p>",), ("&lt;p&gt;c&lt;/p&gt;",), (None,)], "html string")
    found = pages.select("html", markup.html_to_text(F.col("html"), lambda c: sent.append(c) or markup.decode_references(c)).alias("text"), sent[0].alias("sent"))
    assert [tuple(r) for r in found.collect()] == [("<p>a &amp; b</p>", "a & b", None), ("&lt;p&gt;c&lt;/p&gt;", "c", "&lt;p&gt;c&lt;/p&gt;"), (None, None, None)]
