"""Main text of pages against another reading of them, and what the tree decides by."""

import os
import re
from html.parser import HTMLParser

import pytest

from compare import DATA
from tidewrack.llm import htmltext

TREE = htmltext.grow(list(htmltext.LABELLED))
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


class Reader(HTMLParser):
    """Blocks of well-formed pages by the standard library's parser: [text, linked text, named]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.mute, self.link = [], [["", "", False]], 0, False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.mute += 1
        self.link = self.link or tag == "a"
        if tag in htmltext.BLOCKS:
            if tag == "p" and self.open and self.open[-1][0] == "p":
                self.open.pop()
            words = {w for k, v in attrs if k in ("class", "id", "role") for w in re.findall("[a-z]+", v)}
            self.open.append((tag, tag in ("footer", "aside", "form") or bool(words & {"ad", "comments", "sidebar", "notice"})))
            self.start()
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.mute -= 1
        self.link = self.link and tag != "a"
        if tag in htmltext.BLOCKS:
            while self.open and self.open.pop()[0] != tag:
                pass
            self.start()

    def start(self):
        self.blocks.append(["", "", any(n for _, n in self.open)])

    def handle_data(self, data):
        if not self.mute:
            self.blocks[-1][0] += data
            self.blocks[-1][1] += " " + data if self.link else ""


def read(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    found = [(" ".join(t.split()), len(t.split()), len(k.split()), n) for t, k, n in reader.blocks if t.split()]
    near = lambda i: (found[i][1], found[i][2] / found[i][1]) if 0 <= i < len(found) else (0, 0.0)
    return [(t, (*near(i), *near(i - 1), *near(i + 1), int(n))) for i, (t, _, _, n) in enumerate(found)]


@has_data
def test_pages_by_another_parser(spark):
    from tidewrack.session import table

    rows = htmltext.op7_text_blocks(spark, DATA).collect()
    pages = {r.page_id: r.html for r in table(spark, DATA, "pages").collect()}
    assert len(rows) == len(pages)
    blocks = by_links = 0
    for r in rows:
        found = read(pages[r.page_id])
        kept = [t for t, row in found if htmltext.decide(TREE, row)]
        assert r.text == "\n\n".join(kept) and r.n_chars == len(r.text)
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1]
        assert kept == [t for t, _ in read(article)]
        blocks += len(found)
        by_links += sum(not htmltext.decide(TREE, row) and not row[-1] for _, row in found)
    assert by_links >= 0.2 * blocks  # words and links decide on these, not a name


def test_tree_looks_at_words_links_and_neighbours():
    used = set()

    def walk(tree):
        if not isinstance(tree, int):
            used.add(htmltext.FEATURES[tree[0]])
            walk(tree[2])
            walk(tree[3])

    walk(TREE)
    assert TREE[0] == htmltext.FEATURES.index("links") and {"links", "named"} < used and len(used) >= 4
    assert all(htmltext.decide(TREE, row[:-1]) == row[-1] for row in htmltext.LABELLED)


@pytest.mark.parametrize(
    "inside, text",
    [
        ("The sum <math><mi>x</mi><mo>=</mo><mn>5</mn></math> holds", "The sum x=5 holds"),
        ("See <button>more</button>.", "See more."),
        ("a <object>b</object> <video>c</video> <audio>d</audio> <map>e</map> <canvas>f</canvas>", "a b c d e f"),
        ("Pick <select><option>one<option>two</select> of these", "Pick of these"),
        ("Pick <select><option>one</p><p>then on", "Pick\n\nthen on"),
        ("x</p><noscript><p>Shown without scripts</p></noscript><p>y", "x\n\nShown without scripts\n\ny"),
        ("<xmp>1 &lt; <b>2</b></xmp>", "1 &lt; <b>2</b>"),
        ("a&nbsp;&#x42;&eacute; &copy;", "a Bé ©"),
    ],
)
def test_what_is_shown_is_read(inside, text):
    assert htmltext.main_text(f"<body><article><p>{inside}</p></article></body>", TREE) == text


def test_menus_without_names():
    page = "<div>Topics</div><div><a href=1>Go on</a></div><div><a href=2>Then</a></div><h1>What was found in it</h1><p>Few.</p><p>" + "And so it went on for long. " * 9 + "</p><p>The end.</p><div><a href=3>back</a></div><div><a href=4>up</a></div>"
    assert htmltext.main_text(page, TREE).split("\n\n")[0] == "What was found in it" and htmltext.main_text(page, TREE).endswith("The end.")


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, words long"
    long = "<p>" + "word " * 400_000 + "</p>"
    pages = spark.createDataFrame([(1, "u", long, "t", "n", 1), (1, "u", long, "t", "n", 1), (None, None, "<p>a few words</p>", None, None, None), (2, "v", None, "t", "n", 2)], schema)
    rows = htmltext.extract(pages).collect()
    assert sorted(r.n_chars for r in rows) == [0, 11, 1_999_999, 1_999_999] and rows[0].__fields__ == ["page_id", "url", "text", "n_chars"]
