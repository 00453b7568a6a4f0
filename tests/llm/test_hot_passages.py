"""Passages that very many documents share: one row a string, and planted passages caught."""

import random

from pyspark.sql import functions as F

from tidewrack.llm import suffixes

WORDS = [a + b + c for a in "bdfgklmnpr" for b in "aeiou" for c in "lmnrst"]


def prose(words: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(words))


def test_hot_strings_have_one_row(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 4)
    monkeypatch.setattr(suffixes, "MERGED", 2)
    passage = prose(120, 1)
    docs = spark.createDataFrame([(i, f"{prose(20 + i % 7, 10 + i)} {passage} {prose(15, 900 + i)}") for i in range(60)], "doc_id long, text string")
    seen = []
    resolved = suffixes._resolved
    monkeypatch.setattr(suffixes, "_resolved", lambda *a: seen.append(resolved(*a)) or seen[-1])
    rows = suffixes.remove_repeats(docs).collect()
    assert [r.n_spans for r in rows] == [1] * 60 and all(len(passage) <= r.n_removed <= len(passage) + 40 for r in rows)
    spans = seen[0].groupBy("gram", "s1", "s2").agg(F.count("*").alias("n"))
    most, many = spans.agg(F.max("n"), F.count("*")).first()
    assert most == 1 and many > suffixes.HOT


def test_planted_passages(spark):
    """Passages of 400 bytes or more that several documents share are caught; shorter ones and clean documents are left."""
    passages = [prose(110 + 10 * i, 50 + i) for i in range(6)] + [prose(52, 70 + i) for i in range(3)]
    long = [p for p in passages if len(p) >= suffixes.LENGTH]
    rows, planted = [], {}
    for k, p in enumerate(passages):
        for copy in range(2 + 3 * (k % 3)):
            rows.append((len(rows), f"{prose(80, 1000 + len(rows))} {p} {prose(60, 2000 + len(rows))}"))
            planted[len(rows) - 1] = p
    clean = range(len(rows), len(rows) + 30)
    rows += [(i, prose(150, 5000 + i)) for i in clean]
    found = {r.doc_id: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(long) >= 5
    for i, p in planted.items():
        assert (found[i].n_removed >= len(p)) if p in long else (found[i].n_removed == 0)
    assert all(found[i].n_removed == 0 and found[i].n_bytes == len(rows[i][1]) for i in clean)
