"""The pipeline stage by stage, and the queries with SQL against it."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from compare import DATA, spark_rows, sql_rows
from tidewrack.llm import language, mixing, nearcopies, packing, registry, simhash, templates
from tidewrack.session import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@has_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert spark_rows(registry.queries()[name](spark, DATA)) == sql_rows(registry.oracle_sql()[name])


@has_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs_over_the_whole_table(spark, name):
    table = "pages" if name.startswith("op7") else "documents"
    assert registry.queries()[name](spark, DATA).count() >= spark.read.parquet(f"{DATA}/{table}.parquet").count()


@has_data
def test_stages_apply_their_operators(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "source_mix", "pack"]
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], DATA)))
        if len(steps) < 6:
            assert steps[-1].columns == COLUMNS
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    assert ids(steps[1]) == ids(language.identify(docs).filter("lang_pred <> 'und'"))
    texts = {r.doc_id: r.text for r in templates.drop_recurring(steps[1]).collect()}
    assert {r.doc_id: r.text for r in steps[2].collect()} == texts and all(r.n_chars == len(r.text) for r in steps[2].collect() if r.text != "")
    classes = nearcopies.near_copies(steps[2]).collect()
    assert ids(steps[3]) == sorted({r.component_id for r in classes}) and len(ids(steps[3])) <= len({r.component_id for r in simhash.near_duplicates(steps[2], width=5, budget=0).collect()})
    copies = {r.doc_id: r.copies for r in mixing.mix(steps[3]).collect() if r.copies}
    assert Counter(ids(steps[4])) == copies
    pieces = sorted(tuple(r)[:5] for r in packing.pieces(steps[4]).collect())
    assert sorted(tuple(r)[:5] for r in steps[5].collect()) == pieces
    again = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, again.collect())) == sorted(tuple(r) for r in steps[5].collect())


#: Names that operators use inside, and some of their outputs.
INSIDE = (
    "digest digest_ gone raw edges kept n_lines n_dropped fp nth nth_ h_id h_key key key_ copies copies_ t_id t_id_ copy_ lang_pred score label sid n first counts gram place"
    " size rank slice upto rest p lack target taken source_size component_id leaf line pos template wanted w_id others_ none c0 c1 length piece start offset level least t s u a b"
).split()


def test_names_of_the_input_never_clash(spark):
    from pyspark.sql import functions as F

    base = [(i, f"a text of words number {'abcdefgh'[i % 8] * (i + 1)} and more of it\ncommon line of all here\nown {'x' * (i + 2)} end", "en", f"s{i % 2}", 0) for i in range(9)]
    base += [(20, base[2][1], "en", "s0", 0), (21, base[3][1].replace("more", "most"), None, None, None), (22, None, "en", "s1", 0)]
    plain = spark.createDataFrame(base, DOCS)
    wide = plain.select(*[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(c) for c in INSIDE[: len(INSIDE) // 2]], *plain.columns, *[F.col("doc_id").alias(c) for c in INSIDE[len(INSIDE) // 2 :]])
    for name, stage in corpus_pipeline.STAGES:
        alone, beside = stage(spark, plain, ""), stage(spark, wide, "")
        if name == "pack":
            assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, beside.collect()))
            break
        assert beside.columns == wide.columns
        rows = beside.collect()
        assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=repr) == sorted(map(tuple, alone.collect()), key=repr)
        for r in rows:
            assert all(r[c] == f"{c}:{r.doc_id}" for c in INSIDE[: len(INSIDE) // 2]) and all(r[c] == r.doc_id for c in INSIDE[len(INSIDE) // 2 :])


def test_stages_on_odd_rows(spark):
    rows = [(1, "one two three four five", "en", "a", 1), (1, "one two three four five", "en", "a", 1), (None, "six seven eight nine", None, None, None), (2, None, None, "b", None), (3, "", "en", "a", 0)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, DOCS)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, "").count() >= 0
    docs = spark.createDataFrame(rows, DOCS)
    assert sum(r.doc_id == 1 for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == 1
    assert corpus_pipeline.language_id(spark, docs, "").count() == 3
