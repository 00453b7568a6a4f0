"""Each operator of the training-data pipeline against brute force, and on odd input."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidewrack.llm import balltree, editprint, htmltext, language, mixing, packing, secrets, simhash, suffixes, templates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(11)
SYLLABLES = {"en": "the and ing er on at is of".split(), "de": "der und sch ung ein ver keit ü".split(), "fr": "le que eau ment oi é è les".split()}


def prose(lang: str, words: int, seed: int) -> str:
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(words))


def documents():
    rows = [(i, prose(lang, 30 + i % 50, i), lang, f"src{i % 5}", 0) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    rows += [(60, None, "en", "src0", 0), (61, "", "de", None, 0), (62, "1234 5678 !!", "en", "src1", 0), (63, rows[3][1], None, "src2", 0), (64, rows[3][1], "en", "src2", 0), (65, " \t\n", "en", "src3", 0)]
    rows += [(66, prose("en", 20_000, 7), "en", "src0", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that repeat in full, a null id, and columns named like operators' own."""
    rows = [(1, "one two three four five", "en", "a", 1), (1, "one two three four five", "en", "a", 1), (None, "six seven eight nine", None, None, None), (2, None, None, "b", None)]
    d = spark.createDataFrame(rows, DOCS)
    for name in ("size", "fp", "digest", "score", "lang_pred", "piece", "rank", "slice", "n_lines", "taken", "label", "target"):
        from pyspark.sql import functions as F

        d = d.withColumn(name, F.lit("x"))
    return d


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def base_by_hand(text):
    """Base spans, character by character."""
    out, low = [], text.lower()
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < len(text):
        for key in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(key, i) and text[i : i + len(key)].isascii():
                j = i + len(key)
                for step in ("\"'", " ", ":=", " ", "\"'"):
                    if step == " ":
                        while text[j : j + 1] == " ":
                            j += 1
                    elif step == ":=":
                        if text[j : j + 1] not in (":", "="):
                            j = -1
                            break
                        j += 1
                    elif text[j : j + 1] and text[j] in step:
                        j += 1
                k = j
                while 0 <= k < len(text) and text[k] in value:
                    k += 1
                if j > 0 and k > j:
                    if k - j >= 6:
                        out.append((i, 0, k))
                    i = k - 1
                    break
        i += 1
    return out


def test_secret_spans():
    scorer = secrets.Scorer()
    text = 'é password = "hunter22"; Token:abc, API_KEY=\'zzzzzz\' toKen=secret=abcdef AKIA' + "A1" * 8 + " " + "0af" * 8 + " ghp_" + "aB3dE6gH9j" * 3 + "aB3dE6."
    base, added = secrets.scan(text, scorer)
    assert [s for s in base if s[1] == 0] == base_by_hand(text)
    assert [text[s:e] for s, k, e in base if k == 1] == ["AKIA" + "A1" * 8] and [text[s:e] for s, k, e in base if k == 2] == ["0af" * 8]
    assert [text[s:e] for s, k, e in added] == ["ghp_" + "aB3dE6gH9j" * 3 + "aB3dE6"]
    assert secrets.scan("ſecret=abcdefgh AKIA123 deadbeef", scorer) == ([], [])  # look-alike letters, too short


def test_inferred_automata_generalise():
    scorer = secrets.Scorer()
    credentials, ordinary = secrets.labelled(seed=77, each=40)
    for name, examples in credentials.items():
        assert sum(scorer.score(x)[0] > scorer.threshold for x in examples) >= 0.9 * len(examples), name
    assert not any(scorer.score(x)[0] > scorer.threshold for x in ordinary)
    assert not any(secrets.scan(prose(lang, 400, 1), scorer)[1] for lang in SYLLABLES)
    assert all(len(a) <= 40 for a in scorer.automata.values())


def test_secret_rows(docs, odd, empty):
    rows = secrets.scan_secrets(docs).collect()
    assert len(rows) == 67 and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if not r.spans)
    assert secrets.scan_secrets(odd).count() == 4 and secrets.scan_secrets(empty).count() == 0


# 2


def test_walks_by_hand():
    walk = editprint.Walk()
    for text in ("", "a", "ab", "abc", prose("fr", 40, 2), "𝒳é" * 30):
        points = [ord(c) for c in text] + [0, 0, 0]
        wanted, place = [0] * 64, 0
        steps = walk.steps(np.array([len(text)]))[0]
        for step in range(2 * len(text)):
            for k in np.flatnonzero(steps == step):
                if place < len(text):
                    x = (points[place] + points[place + 1] * 0x85EBCA6B + points[place + 2] * 0xC2B2AE35) & 0xFFFFFFFF
                    wanted[k] = ((x * 0x27D4EB2F) & 0xFFFFFFFF) >> 24
            if place < len(text):
                place += int(walk.bits[step % editprint.PERIOD][((points[place] * 0x9E3779B1) & 0xFFFFFFFF) >> 24])
        assert walk.fingerprints([text])[0].tolist() == wanted
    close = walk.fingerprints([prose("en", 300, 5), prose("en", 300, 5)[:500] + "x" + prose("en", 300, 5)[500:], prose("en", 300, 6)])
    assert editprint.likeness(close[0], close[1]) > 0.8 > 0.2 > editprint.likeness(close[0], close[2])


def test_edited_texts(docs, odd, empty):
    found = {r.doc_id: r for r in editprint.with_neighbours(docs).collect()}
    rows = sorted(documents())
    assert len(found) == len(rows)
    for (i, text, *_), (_, after, *_) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        assert found[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest() and found[i].n_chars == len(text)
    assert found[3].fingerprint == found[63].fingerprint and found[63].near_next == 1
    assert editprint.with_neighbours(odd).count() == 4 and editprint.with_neighbours(empty).count() == 0
    assert editprint.with_neighbours(odd.filter("doc_id = 2")).first().near_next == 1
    largest = odd.sparkSession.createDataFrame([((1 << 63) - 1, "a"), (None, "b"), (5, "c")], "doc_id long, text string")
    assert {r.doc_id for r in editprint.with_neighbours(largest).collect()} == {(1 << 63) - 1, None, 5}
    assert editprint.near_duplicates(odd).count() == 4 and editprint.near_duplicates(empty).count() == 0


def test_rows_in_ranges(spark):
    """One id, and null ids, on very many rows; the largest id there is."""
    last = (1 << 63) - 1
    rows = [(7, f"text {i}") for i in range(400)] + [(None, f"none {i}") for i in range(300)] + [(i, f"own {i}") for i in (-5, 3, 9, 10, last)]
    d = editprint.in_order(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 12)
    parts = [[(r.id, r.text, r.tail) for r in p] for p in d.rdd.glom().collect()]
    own = [[(i, t) for i, t, tail in p if not tail] for p in parts]
    flat = [x for p in own for x in p]
    assert sorted(flat, key=repr) == sorted(rows, key=repr) and max(map(len, own)) < 120
    ids = [i for i, _ in flat]
    assert ids == [-5, 3] + [7] * 400 + [9, 10, last] + [None] * 300
    full = [p for p in own if p]
    tails = [[(i, t) for i, t, tail in p if tail] for p in parts if p]
    assert tails == [[p[0]] for p in full[1:] + full[:1]]


def edited(seed: int, copies: int, words: int = 160):
    """Copies with some words changed, between none and enough to fall below the similarity."""
    r = random.Random(seed)
    base, out = prose("en", words, seed).split(), []
    for k in range(copies):
        own = list(base)
        for _ in range(k % 5):
            own[r.randrange(len(own))] = prose("de", 1, r.randrange(10**6))
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("hot", [64, 3])
def test_edit_near_duplicates(spark, hot):
    """Against all pairs: what is linked is alike, and nearly all that is alike is linked, under hot keys too."""
    base = prose("en", 200, 9)
    texts = [base, base, base + " more", prose("en", 200, 10), None, ""] + [t for s in range(24) for t in edited(100 + s, 6)] + edited(500, 40)
    rows = list(enumerate(texts))
    found = {r.doc_id: r.component_id for r in editprint.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    assert found[0] == found[1] == found[2] == 0 and found[3] == 3 and found[4] == found[5] == 4
    grams = []
    for t in texts:
        w = (t or "").split()
        grams.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    alike = [(i, j) for i in range(len(texts)) for j in range(i) if grams[i] and 9 * len(grams[i] & grams[j]) >= 4 * (len(grams[i]) + len(grams[j]))]
    for i, j in alike:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    assert all(find(i) == find(found[i]) for i in found if texts[i])  # nothing unlike is joined
    assert sum(found[i] == found[j] for i, j in alike) >= 0.98 * len(alike) and len(alike) > 300


# 3


def test_templates(spark, odd, empty):
    filler = lambda i: f"{prose('en', 12, i)}\n{prose('de', 14, i)}"
    rows = [(i, f"{filler(i)}\nPage {i} of 20 today\nCopyright by the great Acme corporation of {prose('fr', 1, i)} and all its friends\nyes") for i in range(6)]
    rows += [(9, None), (10, ""), (11, "short line\nshort line")]
    found = {r.doc_id: r for r in templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0].text == rows[0][1] and found[0].n_dropped == 0  # the first place of a template stays
    for i in range(1, 6):
        assert found[i].text == filler(i) and (found[i].n_lines, found[i].n_dropped) == (5, 3)
    assert found[9].text is None and found[9].n_lines == 0 and found[10].text == "" and found[11].text == rows[8][1]
    assert templates.drop_recurring(odd).count() == 4 and templates.drop_recurring(empty).count() == 0


def test_templates_within_one_document_stay(spark):
    d = spark.createDataFrame([(1, "the same line here\nthe same line here"), (2, "another text of words")], "doc_id long, text string")
    assert sorted(r.n_dropped for r in templates.drop_recurring(d).collect()) == [0, 0]


# 4


def by_hand_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(fixed.values()), [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mix(docs, odd, empty):
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    wanted = by_hand_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(wanted[r.source]) and r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.taken % max(1, r.size) == 0
        taken[r.source] += r.taken
    biggest = max(r.size for r in rows if r.source == "src1")
    assert abs(taken["src1"] - wanted["src1"]) <= biggest / 2
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix(odd).count() == 4 and mixing.mix(empty).count() == 0


# 5


def test_suffix_arrays_by_hand():
    for n, letters in ((1, 2), (7, 1), (60, 2), (400, 3)):
        data = np.array([rng.randrange(letters) for _ in range(n)], np.uint8)
        order, rank = suffixes.suffix_array(data)
        raw = data.tobytes()
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        starts = np.array([0] if n < 3 else [0, n // 2])
        prefixes = suffixes.common_prefixes(data, order, rank, starts, np.append(starts[1:], n))
        for r in range(1, n):
            a, b = raw[order[r - 1] :], raw[order[r] :]
            assert prefixes[r] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def removed_by_hand(texts, length=400):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffixes.HOT, 3])
def test_repeats(spark, odd, empty, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    base, shared = prose("en", 300, 1), prose("de", 120, 2)
    texts = [base[: 40 * i] + f"X{i}" + base[40 * i :] for i in range(12)] + [prose("fr", 80, i) + shared + prose("en", 60, i) for i in range(3)]
    texts += ["ab" * 500, "a" * 900, "b" * 399, "c" * 400, "c" * 400, "", None, prose("fr", 100, 50)]
    rows = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == removed_by_hand([(t or "").encode() for t in texts])
    if hot == 3:
        assert suffixes.remove_repeats(odd).count() == 4 and suffixes.remove_repeats(empty).count() == 0
        twice = spark.createDataFrame([(1, base), (1, base)], "doc_id long, text string")
        assert [r.n_removed for r in suffixes.remove_repeats(twice).collect()] == [len(base.encode())] * 2


# 6


def test_words_are_the_tokenizer():
    words = packing.Words(packing.default_tokenizer())
    texts = ["", "don't I'll WE'RE 's x's", "ΑΣ Σ ΟΔΟΣ. ςσ", "İstanbul İ.", "ábc é. ', .", "<|endoftext|> x<|startoftext|>y", "12a3 4.5,6 !!\"' ..., ,, .", "a\x1cb \x1f c", "日本語。テスト, ok", "Ünï Straße, ﬁne ǅ", "\U0001f600😀. x"]
    for text in texts + [prose(lang, 100, 4) + ". End," for lang in SYLLABLES]:
        assert np.frombuffer(words.ids(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_plans_place_everything():
    r = random.Random(4)
    for size, n in ((100, 500), (64, 1), (2048, 4000)):
        lengths = [min(size, max(1, int(r.lognormvariate(0, 1) * size / 4))) for _ in range(n)]
        histogram = dict(Counter(lengths))
        runs = packing.plan(histogram, size)
        placed = Counter()
        for many, own in runs:
            assert sum(own) <= size
            for x in own:
                placed[x] += many
        assert placed == Counter(lengths)
        assert sum(many for many, _ in runs) <= 1.05 * -(-sum(lengths) // size) + 2
    assert packing.plan({}, 10) == [] and sum(m for m, _ in packing.grouped_plan({5: 7, 6: 3}, 10, 4, 3)) == 7


def test_packed_pieces(docs, odd, empty):
    rows = packing.pack(docs).collect()
    words, by_sequence, of = packing.Words(packing.default_tokenizer()), {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        of.setdefault(r.doc_id, []).append(r)
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    for i, text, *_ in documents():
        ids = words.ids(text or "") + bytes(4)
        for r in of[i]:
            part = ids[4 * r.start : 4 * (r.start + r.length)]
            assert r.ids_crc32 == zlib.crc32(part) and r.start == 2048 * r.piece
        assert sum(r.length for r in of[i]) == len(ids) // 4
    assert packing.pack(odd).count() == 4 and packing.pack(empty).count() == 0


# 7

PAGE = """<html><head><title>T</title></head><body class="home"><header class="site"><h1>Site</h1><a href=/>Home</a></header><div id="cookie-notice">We use cookies to make this site
work well for you all.</div><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><main><article class="post with-sidebar"><header><h1>Big <em>News</em></h1></header><p>Para one with p<0.05 &amp; &#233;.</p>
text loose<div class="advert">Buy now this very long advert text of a lot of words here</div><form><label>Email</label><input><button>Go</button></form><script>var x="<p>no</p>";</script><p>Last   para<br>line
two</p><aside>side note here</aside><section id="comments"><h3>Comments</h3><p>I really love this article and want to say much about it.</p></section></article></main><footer>&copy; x</footer>"""


def test_main_text(spark):
    tree = htmltext.grow(list(htmltext.LABELLED))
    assert htmltext.main_text(PAGE, tree) == "Big News\n\nPara one with p<0.05 & é.\n\ntext loose\n\nLast para line two"
    for broken in ("", None, "<", "<p", "<!-- x", '<a href="x>y</a>', "<b>" * 3, '<div class="x" <p>q'):
        assert isinstance(htmltext.main_text(broken, tree), str)
    long = "<article>" + "<p>" + "word " * 20 + "</p>\n" * 1 + "<p>x</p>" * 3000 + "</article>"
    assert htmltext.main_text(long, tree).count("\n\n") == 3000
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")
    rows = htmltext.extract(pages).collect()
    assert len(rows) == 3 and sorted(r.n_chars for r in rows)[0] == 0 and htmltext.extract(pages.limit(0)).count() == 0
    plain = "<body><ul><li><a href=1>a b</a></li><li><a href=2>c</a></li></ul><div>" + "Some longer text stands here for a while. " * 5 + "</div><div>" + "And it goes on in this block of words too. " * 4 + "</div><div><a href=3>next</a></div></body>"
    assert htmltext.main_text(plain, tree).count("\n\n") == 1


# 8


def fingerprint_by_hand(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", "A", "a b", "Äb C\td\x0be  f", prose("en", 300, 3)])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == fingerprint_by_hand(text)


def label_by_hand(values):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def near_values(n, seed):
    r = random.Random(seed)
    base, out = [r.getrandbits(64) for _ in range(3)], set()
    while len(out) < n:
        x = r.choice(base)
        for _ in range(r.randint(0, 7)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


def test_trie_links():
    for seed in range(4):
        values = near_values(120, seed)
        wanted, parent = label_by_hand(values), {v: v for v in values}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        links = simhash.trie_links(values)
        assert len(links) < len(values)
        for a, b in links:
            assert (a ^ b).bit_count() <= 2
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        assert {v: find(v) for v in values} == wanted


@pytest.mark.parametrize("hot", [simhash.HOT, 1])
def test_near_classes(spark, hot):
    values = near_values(150, 9)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {}
    for r in simhash.components(simhash.links(fps, hot=hot)).collect():
        found.setdefault(r.component, set()).add(r.node)
    wanted = {}
    for v, label in label_by_hand(values).items():
        wanted.setdefault(label, set()).add(signed(v))
    assert sorted(map(sorted, found.values())) == sorted(sorted(s) for s in wanted.values() if len(s) > 1)


def test_near_duplicates(docs, odd, empty):
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert found[63].component_id == found[64].component_id == 3 and found[61].component_id == found[60].component_id == 60 and found[65].fp == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in found.values()})
    assert simhash.near_duplicates(odd).count() == 4 and simhash.keep_one(odd).count() == 3
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


# 9


def test_phrases_by_hand():
    samples = [(lang, prose(lang, 200, i)) for lang in SYLLABLES for i in range(3)]
    model = language.train(samples, 1500)
    lang, flat, _, named = model["models"][0]
    learned = [language.to_symbols(t.lower(), model["table"])[:500] for name, t in samples if name == lang]
    whole = bytes(named[np.concatenate([np.concatenate((s, np.zeros(1, np.uint8))) for s in learned])])
    text = bytes(named[language.to_symbols(prose("fr", 60, 99) + prose(lang, 30, 5), model["table"])])[: language.STRETCH]
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in whole:
            end += 1
        count, at = count + 1, end
    s = np.frombuffer(text, np.uint8)
    got = language.phrases([s], flat, s[:, None].copy(), [1] * len(s))[0]
    assert got == count


def test_languages(docs, odd, empty):
    rows = language.identify(docs).collect()
    by = {r.doc_id: r for r in rows}
    held = [r for r in rows if r.doc_id < 60 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in rows)
    assert [by[i].lang_pred for i in (60, 61, 62, 65)] == ["und"] * 4 and by[66].lang_pred == "en" and by[63].lang_pred == by[64].lang_pred
    assert language.identify(odd).count() == 4 and language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("false").union(docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars"))).collect()} == {"und"}


def test_samples_are_bounded(spark):
    """One id on very many rows, null ids, and more languages than full samples have room for."""
    from pyspark.sql import functions as F

    text = prose("en", 900, 1)
    many = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit(text), (F.col("id") % 1500).cast("string")).alias("text"), F.lit("en").alias("lang"))
    nulls = spark.range(40).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit(prose("de", 50, 2)), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    rows = language.sample(many.union(nulls))
    assert Counter(lang for lang, _ in rows) == {"en": language.SAMPLE_DOCS, "de": 40}
    assert all(len(t) == language.SAMPLE_CHARS // language.SAMPLE_DOCS and t in text + "0123456789" * 2 or t[:400] in text for lang, t in rows if lang == "en") and len({t for _, t in rows}) > 60
    samples = [(f"l{i:03}", prose(("en", "de", "fr")[i % 3], 3000, i)) for i in range(60)]
    model = language.train(samples, most_bytes=12 << 20)
    assert sum(flat.nbytes for _, flat, *_ in model["models"]) <= 12 << 20 and len(model["models"]) == 60
    assert {x[0] for x in language.parse([t for _, t in samples[:3]], model)} <= {f"l{i:03}" for i in range(60)}


# 10


@pytest.mark.parametrize("shard, block", [(balltree.SHARD, balltree.BLOCK), (64, 7)])
def test_top_k(spark, monkeypatch, shard, block):
    monkeypatch.setattr(balltree, "LEAF", 16)
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8)) * 9
    vectors = [(i, [float(x) for x in r.normal(size=8) + (centres[i % 6] if i % 2 else 0)]) for i in range(300)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, []), (305, [1.0]), (None, [1.0] * 8)]
    vectors += [(i, vectors[20][1]) for i in (400, 401, 420)] + [(440, vectors[40][1])] * 2 + [(i, vectors[60][1]) for i in range(500, 560)]
    vectors += [(600 + i, [float(x) for x in r.normal(size=3 + i % 6)]) for i in range(30)]
    from pyspark.sql import functions as F

    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    d = balltree.integer_vectors(table.withColumns({c: F.lit("x") for c in ("v", "dim", "row_id", "asks", "space", "score")}))
    found = sorted(tuple(x) for x in balltree.top_k(d, F.col("vec_id") % 20 == 0, shard=shard, block=block).collect())
    usable = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    wanted = []
    for n, (i, q) in enumerate(usable):
        if i is not None and i % 20 == 0:
            scores = sorted((-int(q @ v), j is None, j, k) for k, (j, v) in enumerate(usable) if k != n and len(v) == len(q))
            wanted += [(i, rank, j, -s) for rank, (s, _, j, _) in enumerate(scores[:20], 1)]
    assert found == sorted(wanted)
    assert balltree.top_k(d.filter("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    vectors = [(0, [1e18, 1.0]), (1, [1e18, 0.0]), (2, [-1e18, 0.0]), (3, [1e300, 5.0]), (4, [0.5, 0.5])]
    found = balltree.top_k(balltree.integer_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")), F.col("vec_id") == 0).collect()
    top = (1 << 63) - 1
    assert sorted((r.rank, r.vec_id, r.score) for r in found) == [(1, 1, top), (2, 3, top), (3, 4, 32 * top + 64 * 32 if 32 * top < top else top), (4, 2, -top)]


def test_long_vectors_and_far_clusters():
    """Whole clusters are left out by their bound, and what is found is what comparing everything finds."""
    r = np.random.default_rng(4)
    x = (r.normal(size=(4000, 40)) + np.repeat(r.normal(size=(8, 40)) * 30, 500, axis=0)).round().astype(np.int64) * 8
    tree, key, q = balltree.Tree(x, 50), np.arange(4000), x[::97]
    bounds = tree.bounds(q.astype(float))
    scores = q @ x.T
    kth = -np.sort(-scores, axis=1)[:, 9]
    assert (bounds[:, np.flatnonzero(tree.left == 0)] >= kth[:, None]).mean() < 0.3
    which, place, score = balltree.search(tree, x, q, np.full(len(q), -np.inf), np.full(len(q), -1), 10, key)
    for i in range(len(q)):
        wanted = sorted(((-s, k) for k, s in enumerate(scores[i].tolist())))[:10]
        assert sorted(zip((-score[which == i]).tolist(), place[which == i].tolist(), strict=True)) == wanted
