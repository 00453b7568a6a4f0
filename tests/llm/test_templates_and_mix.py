"""Templates whose field values recur, and sources with a document that does not fit."""

from collections import Counter

from pyspark.sql import functions as F

from tidewrack.llm import mixing, templates


def test_two_fields_whose_values_recur(spark):
    name = lambda i, n: "".join("bcdfghklmn"[int(c)] + "aeiou"[int(c) % 5] for c in f"{i % n:02}")
    rows = [(i, f"Posted by the author {name(i, 40)} in section {name(i // 40, 10)}\nown line {'x' * (i + 1)}") for i in range(400)]
    rows += [(400, "Posted by the author of all that is"), (401, "Posted by nobody who is known in section ba")]
    found = {r.doc_id: r for r in templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in found if found[i].n_dropped} == set(range(1, 400))
    assert found[0].text == rows[0][1] and all(found[i].text == rows[i][1].split("\n")[1] for i in range(1, 400))
    assert found[400].text == rows[400][1] and found[401].text == rows[401][1]


def test_fields_side_by_side_in_one_leaf(spark):
    """Two templates share a leaf, so every position of it has many values."""
    values = "ab bc cd de ef fg gh hi".split()
    rows = [(i, f"See also the {x} page on {y} matters") for i, (x, y) in enumerate((x, y) for x in values for y in values)]
    rows += [(100 + i, f"See also the notes {x} about gardens {y}") for i, (x, y) in enumerate((x, y) for x in values for y in values)]
    found = {r.doc_id: r.n_dropped for r in templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in sorted(found) if not found[i]] == [0, 100]


def test_fixed_words_beside_fields_in_long_lines(spark):
    """Thirty tokens, four of them fields far apart: every other word counts for itself."""
    value = lambda i, k: "".join("bcdfghklmn"[(i * k) // 10**j % 10] + "aeiou"[(i + k) // 10**j % 5] for j in range(2))
    fixed = "our terms of service apply to all orders that you place with us on this page and in every shop that we run in any town near you".split()
    rows = []
    for i in range(50):
        own = list(fixed)
        for k in (5, 12, 19, 26):
            own[k] = value(i, k)
        rows.append((i, " ".join(own)))
    rows += [(50, " ".join(reversed(fixed))), (51, " ".join(fixed[:3] + [w + "x" for w in fixed[3:]]))]
    found = {r.doc_id: r.n_dropped for r in templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in sorted(found) if not found[i]] == [0, 50, 51]


def test_edited_copies_of_one_line(spark):
    """Each has other words changed; all lead back to the common form."""
    base = [f"w{'abcdefghij'[i % 10]}{'klmno'[i // 10]}" for i in range(40)]
    rows = [(i, " ".join(w if j not in (3 + i % 37, 3 + (i * 7 + 11) % 37) else f"{w}{'x' * (i + 1)}" for j, w in enumerate(base))) for i in range(60)]
    found = {r.doc_id: r.n_dropped for r in templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found.values()) == 59


def test_short_lines_and_lines_of_numbers(spark):
    rows = [(i, f"Read more\nOK\n{i} {i * 7}\n12 13\n \n\nown {'y' * (i + 1)} text") for i in range(5)]
    found = templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert found[0].text == rows[0][1] and found[0].n_dropped == 0
    for i in range(1, 5):  # numbers that differ stay, equal ones go
        assert found[i].text == f"{i} {i * 7}\n \n\nown {'y' * (i + 1)} text" and found[i].n_dropped == 3


def test_long_lines(spark):
    """One token of a million characters, one line of many tokens."""
    wide, many = "z" * 1_000_000, " ".join(f"t{'abc'[i % 3] * (i % 50)}" for i in range(100_000))
    rows = [(1, f"{wide}\n{many}"), (2, f"{wide}\n{many} end"), (3, many.replace("tabc", "q") + " end")]
    found = {r.doc_id: r.n_dropped for r in templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == 0 and found[2] == 1 and found[3] <= 1


def greedy(rows, rest):
    """Documents in rank order, each taken if it fits."""
    taken = set()
    for i, size in rows:
        if size <= rest:
            taken.add(i)
            rest -= size
    return taken, rest


def test_source_with_one_long_document(spark):
    sizes = {i: 200 + i % 7 for i in range(100)} | {100: 20_000, 101: 3_000}
    docs = spark.createDataFrame([(i, "w " * n, "long") for i, n in sizes.items()] + [(1000 + i, "w " * 300, "other") for i in range(500)], "doc_id long, text string, source string")
    for seed in ("t1", "t5", "t9"):
        u = {r.doc_id: r.u for r in docs.select("doc_id", mixing.uniform(F.col("doc_id"), seed).alias("u")).collect()}
        rows = mixing.mix(docs, weights=(1, 20), share=0.55, seed=seed).collect()
        target = {r.source: r.target for r in rows}
        own = [r for r in rows if r.source == "long"]
        whole = int(target["long"] // sum(sizes.values()))
        taken, lack = greedy(sorted(((i, n) for i, n in sizes.items()), key=lambda x: u[x[0]]), target["long"] - whole * sum(sizes.values()))
        extra = {r.doc_id for r in own if r.copies > whole}
        assert taken <= extra and len(extra - taken) <= 1
        assert abs(sum(r.taken for r in own) - target["long"]) <= max(lack, 0)
        again = mixing.mix(docs.repartition(5), weights=(1, 20), share=0.55, seed=seed).collect()
        assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in rows)
