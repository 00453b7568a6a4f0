"""Near copies against brute force."""

import random

import pytest

import corpus_pipeline
from tidewrack import session
from tidewrack.llm import nearcopies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioubcdfg") for _ in range(5))
    passage = " ".join(word() for _ in range(40))
    out = []
    for _ in range(4):
        base = [word() for _ in range(120)]
        for edits in (0, 0, 1, 1, 2, 2, 3, 3, 4, 6, 9):
            own = list(base)
            for _ in range(edits):
                own[r.randrange(len(own))] = word()
            out.append(" ".join(own))
    out += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(12)]
    return out + ["", None, " \t", "one two", "One  two", "one two three four five six", passage, passage.upper()]


def classes_by_hand(values):
    sets = []
    for t in values:
        words = (t or "").lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(values)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a and 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j]))):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("hot, sample", [(nearcopies.HOT, nearcopies.SAMPLE), (2, nearcopies.SAMPLE), (1, 1)])
def test_near_copies_by_hand(spark, monkeypatch, hot, sample):
    monkeypatch.setattr(nearcopies, "SAMPLE", sample)
    values = texts()
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(values)], DOCS)
    found = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs, hot=hot).collect()}
    assert found == dict(enumerate(classes_by_hand(values)))


def test_stage_drops_copies_with_edited_words(spark):
    """Similar by five words, yet more than two bits apart."""
    values = texts()[:11]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(values)], DOCS)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted(set(classes_by_hand(values))) and len(kept) < simhash.keep_one(docs).count()


def test_odd_near_copies(spark):
    rows = [(1, "a b", "en", "a", 1), (1, "a b", "en", "a", 1), (None, "x y z", None, None, None), (None, "x y z", "de", None, None), (2, None, None, "b", None), (3, "", "en", "a", 0)]
    for given, many in ((rows, 3), ([], 0)):
        assert nearcopies.keep_one(spark.createDataFrame(given, DOCS)).count() == many


def moves_of(df, column):
    """The exchanges of a plan that has not run yet and that ``column`` goes through."""

    def below(node):
        node = node.initialPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
        own = int(node.nodeName() == "Exchange" and f"{column}#" in node.output().toString())
        return own + sum(below(node.children().apply(i)) for i in range(node.children().size()))

    return below(df._jdf.queryExecution().executedPlan())


def test_texts_move_once_where_many_rows_go(spark, monkeypatch):
    """Lookups too large to be sent: the same rows stay, and no table and no second move of the texts is left behind."""
    rows = [(i, t, "en", f"s{i % 3}", i) for i, t in enumerate(texts())]
    rows += [rows[0], (0, rows[0][1], "de", "other", None), (None, rows[3][1], "en", None, 1), (None, "x y z", None, None, None), (None, "x y z", "de", "a", 2), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    few = sorted(map(tuple, nearcopies.keep_one(docs).collect()), key=repr)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for module in (simhash, nearcopies):
            monkeypatch.setattr(module, "lookup", lambda df: df)
        mark = session.tables()
        kept = nearcopies.keep_one(docs)
        assert moves_of(kept, "text") == 1
        assert sorted(map(tuple, kept.collect()), key=repr) == few
        assert session.tables() == mark
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
