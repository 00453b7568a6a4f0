"""Main text of web pages: flat blocks, their word counts and link densities and their neighbours', and a decision tree.

A page is read once into blocks, the text between block-level tags. A block's features are its words and the share of
them inside links, the same of the blocks before and after it, and one weak hint: whether an open element is named as page furniture, by its
tag, class, id or role. A decision tree, trained at each start on the labelled table below, keeps or drops each block. Menus are told by
their links alone; the hint settles what reads like prose but is none of the article's (adverts, comments, notices, footers).

Of what browsers show nothing is dropped before the tree sees it; left out are scripts, styles, the head, templates, frames' and
vector graphics' sources, and the choices and inputs of forms.

Defined cases: null or empty html, and pages of which no block is kept, give an empty text; broken markup (open tags at
the end, stray brackets, unclosed comments) is read as far as it goes; nothing is cut off, whatever the length; repeated
rows give equal rows; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewrack.llm.rows import slices

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "named")
#: Labelled blocks: the features, then 1 for main text.
LABELLED = (
    # paragraphs, long and short, inside articles
    (60, 0.0, 8, 0.0, 45, 0.0, 0, 1),
    (45, 0.05, 60, 0.0, 3, 0.0, 0, 1),
    (120, 0.0, 3, 0.0, 14, 0.0, 0, 1),
    (30, 0.4, 80, 0.0, 50, 0.0, 0, 1),
    (22, 0.2, 3, 0.5, 35, 0.0, 0, 1),
    (14, 0.3, 120, 0.0, 6, 0.1, 0, 1),
    (10, 0.1, 1, 0.0, 1, 0.0, 0, 1),
    (9, 0.0, 10, 0.0, 4, 0.0, 0, 1),
    (3, 0.0, 2, 0.0, 5, 0.0, 0, 1),
    (2, 0.0, 1, 0.0, 70, 0.1, 0, 1),
    (2, 0.0, 2, 0.0, 2, 0.0, 0, 1),
    (1, 0.0, 90, 0.0, 2, 0.0, 0, 1),
    (1, 0.0, 3, 0.0, 1, 0.0, 0, 1),
    # the first and last blocks of articles, headings, and pages of one block
    (8, 0.0, 1, 1.0, 60, 0.0, 0, 1),
    (4, 0.0, 2, 1.0, 12, 0.0, 0, 1),
    (25, 0.0, 4, 1.0, 7, 0.5, 0, 1),
    (70, 0.0, 9, 0.9, 50, 0.0, 0, 1),
    (11, 0.0, 5, 0.0, 5, 0.0, 0, 1),
    (30, 0.0, 50, 0.1, 2, 1.0, 0, 1),
    (5, 0.0, 40, 0.0, 3, 1.0, 0, 1),
    (2, 0.0, 6, 0.0, 4, 1.0, 0, 1),
    (3, 0.0, 2, 0.0, 2, 1.0, 0, 1),
    (1, 0.0, 1, 0.1, 5, 1.0, 0, 1),
    (6, 0.0, 4, 0.0, 1, 0.9, 0, 1),
    (4, 0.0, 3, 0.2, 1, 1.0, 0, 1),
    (28, 0.0, 0, 0.0, 0, 0.0, 0, 1),
    (5, 0.0, 4, 0.0, 0, 0.0, 0, 1),
    (26, 0.3, 2, 1.0, 3, 1.0, 0, 1),
    # menus and lists of links
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0),
    (2, 1.0, 1, 1.0, 10, 0.0, 0, 0),
    (3, 1.0, 40, 0.0, 2, 1.0, 0, 0),
    (6, 1.0, 50, 0.0, 7, 1.0, 0, 0),
    (7, 0.95, 6, 1.0, 5, 1.0, 0, 0),
    (5, 1.0, 7, 1.0, 60, 0.2, 0, 0),
    (12, 0.9, 40, 0.1, 11, 1.0, 0, 0),
    (15, 0.8, 2, 1.0, 30, 0.0, 0, 0),
    (35, 0.7, 15, 0.8, 40, 0.6, 0, 0),
    (20, 0.65, 3, 1.0, 4, 1.0, 0, 0),
    (2, 1.0, 8, 0.0, 9, 0.0, 0, 0),
    # short words between links: what menus and bars are headed with
    (1, 0.0, 2, 1.0, 1, 1.0, 0, 0),
    (2, 0.0, 1, 1.0, 3, 1.0, 0, 0),
    (3, 0.3, 1, 1.0, 2, 1.0, 0, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 0),
    (6, 0.1, 3, 0.9, 2, 0.9, 0, 0),
    (1, 0.0, 0, 0.0, 2, 1.0, 0, 0),
    (2, 0.0, 0, 0.0, 1, 1.0, 0, 0),
    # prose that is named as something else
    (12, 0.0, 1, 1.0, 9, 0.0, 1, 0),
    (9, 0.0, 80, 0.0, 0, 0.0, 1, 0),
    (40, 0.0, 60, 0.0, 55, 0.0, 1, 0),
    (65, 0.0, 40, 0.0, 30, 0.0, 1, 0),
    (18, 0.1, 80, 0.0, 0, 0.0, 1, 0),
    (5, 0.0, 2, 0.0, 3, 0.0, 1, 0),
    (4, 0.0, 80, 0.0, 20, 0.0, 1, 0),
)
DEPTH = 7

#: Fixed names: elements that start and end blocks, elements without content, and words that name page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is a form's choices, shown by the browser's own controls.
CHOICES = frozenset("select datalist".split())
FURNITURE_TAGS = frozenset("footer aside form menu dialog fieldset".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising adsense banner banners comment comments respond cookie cookies consent gdpr copyright"
    " disclaimer disqus discussion footer login masthead menu modal newsletter notice notices notification popup"
    " promo promotion promotions promoted recommended related replies reply search share sharing shares sidebar sidebars sidenav signup social sponsor sponsored sponsors subscribe"
    " subscription tags teaser teasers toc toolbar topbar widget widgets alert alerts complementary contentinfo skip outbrain taboola paywall".split()
)
HEADER_NAMES = frozenset("header heading banner masthead topbar".split())
LAYOUT_NAMES = frozenset("with has no without is".split())
MAIN_TAGS = frozenset(("article", "main"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|template|svg|iframe|noembed|noframes)\b(?>[^>]*)(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<xmp\b(?>[^>]*)(?:>(.*?)(?:</xmp\s*>|\Z)|\Z)"
    r"|<[!?](?>[^>]*)(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*))(?:>|\Z)"
    r"|</?[A-Za-z](?>[^>]*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b")
_NAME = re.compile(r"[a-z]+")


def _furniture(tag: str, attributes: str, inside_main: bool) -> bool:
    """Whether an element is page furniture by its own name or attributes."""
    if tag in FURNITURE_TAGS or (tag == "header" and not inside_main):
        return True
    if not attributes.strip(" /\n") or tag in ("html", "body") or tag in MAIN_TAGS:
        return False
    for name, double, single, bare, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (double or single or bare).lower()
        if hidden or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name in ("class", "id", "role"):
            for each in value.split():
                words = _NAME.findall(each)
                if words and not LAYOUT_NAMES & set(words):
                    for word in (words[0], words[-1]):
                        if word in HEADER_NAMES and not inside_main or word in FURNITURE_NAMES and word not in HEADER_NAMES:
                            return True
    return False


def blocks(page: str) -> list[tuple[str, int, float, int]]:
    """(text, words, share of words in links, named) of each block that has text."""
    out: list[tuple[str, int, float, int]] = []
    # Open block elements: name, whether named as furniture, whether inside an article or main element.
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    parts: list[str] = []
    linked: list[str] = []
    in_link, choice = False, ""

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not any(name == "head" for name, *_ in stack):
                words = text.count(" ") + 1
                in_links = len(html.unescape(" ".join(linked)).split())
                out.append((text, words, min(1.0, in_links / words), int(stack[-1][1])))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        if not choice:
            parts.append(text)
            if in_link:
                linked.append(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is not None:  # shown as it stands, references and all
            flush()
            add(html.escape(m[2], quote=False))
            flush()
        tag = m[4] and m[4].lower()
        if not tag:
            continue
        if tag == "a":
            in_link = not m[3]
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in CHOICES:
            choice = "" if m[3] else tag
            continue
        if tag not in BLOCKS or (choice and tag in ("option", "optgroup")):
            continue
        choice = ""
        flush()
        if m[3]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                del stack[depth:]
                if tag not in ("p", "li"):
                    in_link = False
            continue
        if tag == "body":
            del stack[1:]
        if stack[-1][0] == "p":
            del stack[-1]
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            same = ("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in same:
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "menu", "div", "article", "main", "body"):
                    break
        if tag in VOID:
            continue
        _, furniture, main = stack[-1]
        stack.append((tag, furniture or _furniture(tag, m[5] or "", main), main or tag in MAIN_TAGS or 'role="main"' in (m[5] or "")))
    add(page[at:])
    flush()
    return out


def features(found: list[tuple[str, int, float, int]]) -> list[tuple[float, ...]]:
    rows = []
    for i, (_, words, links, named) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        rows.append((words, links, *before, *after, named))
    return rows


def grow(rows: list[tuple[float, ...]], depth: int = DEPTH):
    """A decision tree: a class, or (feature, limit, tree up to the limit, tree above). Splits lower Gini impurity most;
    ties go to the earlier feature and the lower limit."""
    ones = sum(r[-1] for r in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones > len(rows))

    def impurity(part) -> float:
        share = sum(r[-1] for r in part) / len(part)
        return len(part) * share * (1 - share)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            limit = (low + high) / 2
            left, right = [r for r in rows if r[f] <= limit], [r for r in rows if r[f] > limit]
            score = round(impurity(left) + impurity(right), 9)
            if best is None or score < best[0]:
                best = (score, f, limit, left, right)
    if best is None:
        return int(2 * ones > len(rows))
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


def decide(tree, row: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b[0] for b, row in zip(found, features(found), strict=True) if decide(tree, row))


def extract(pages: DataFrame, labelled: tuple = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars: one row for every row of ``pages``."""
    tree = grow(list(labelled))

    def apply(batches):
        for batch in slices(batches):
            texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(apply, "page_id long, url string, text string, n_chars long")


def op7_text_blocks(spark, sf_dir: str) -> DataFrame:
    from tidewrack.session import table

    return extract(table(spark, sf_dir, "pages"))
