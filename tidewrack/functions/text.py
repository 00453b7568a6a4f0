"""Text functions as Columns: white space, tokens, titles, shingles, set similarity, truncation and bounded matches."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.config import STOPWORDS

#: White space as the web platform defines it, as a regular expression class.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters without: what compatibility decomposition leaves of them."""
    pairs = []
    for point in range(0xC0, 0x250):
        c = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c == c.lower() and len(base) == 1 and base.isascii() and base.isalpha():
            pairs.append((c, base.lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folds()


def squish(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def lower(c: Column) -> Column:
    """Lower case, one letter for one: a dotted capital I becomes i, without the mark that the JVM leaves."""
    return F.lower(F.replace(c, F.lit("İ"), F.lit("i")))


def fold(c: Column) -> Column:
    """Lower case without marks (Latin letters)."""
    return F.translate(lower(c), FOLD_FROM, FOLD_TO)


def tokenize(c: Column, keep_stopwords: bool = False) -> Column:
    """Runs of a-z and 0-9 of two characters or more, in order; null gives an empty array."""
    words = F.split(F.regexp_replace(fold(c), "[^a-z0-9]+", " "), " ")
    tokens = F.filter(words, lambda t: F.length(t) > 1)
    if not keep_stopwords:
        stop = F.array(*[F.lit(w) for w in STOPWORDS])
        tokens = F.filter(tokens, lambda t: ~F.array_contains(stop, t))
    return F.coalesce(tokens, F.array().cast("array<string>"))


def normalize_title(c: Column) -> Column:
    """Without a paywall mark in front and an outlet name behind; ampersands in words."""
    c = F.regexp_replace(c, r"(?i)^\s*STAT\+:\s*", "")
    c = F.regexp_replace(c, r"\s+[-–|]\s+[^-–|]{2,40}$", "")
    return squish(F.regexp_replace(c, "&", " and "))


def shingles(tokens: Column, n: int = 3) -> Column:
    """The distinct runs of n characters of the tokens joined by spaces."""


    def runs(text: Column) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))

    # Bound as the one element of an array, or the text would be made anew for every run.
    return F.element_at(F.transform(F.array(F.array_join(tokens, " ")), runs), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; zero if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def dice(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) * 2 / (F.size(a) + F.size(b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def truncate_words(c: Column, most: int) -> Column:
    """At most so many characters, cut at the last space if that keeps over 60 %, without punctuation at the cut, then an ellipsis."""
    head = F.substring(c, 1, most)
    back = F.instr(F.reverse(head), " ")
    last = most - back  # characters before the last space
    base = F.when((back > 0) & (last > most * 0.6), F.substr(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(base, r"[\s,;:.\-–—]+$", ""), F.lit("…")))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, SPACE + "+"), lambda w: w != ""))


def bounded(term: str) -> str:
    """A pattern for a term that no letter a-z or digit touches. It starts with the term itself, so that a matcher can skip to it."""
    plain = re.escape(term)
    return rf"{plain}(?<![a-z0-9]{plain})(?![a-z0-9])"


def count_term(lowered: Column, term: str) -> Column:
    """How often the term stands in lower-cased text on its own. Most texts lack most terms: they are only searched for it."""
    return F.when(F.contains(lowered, F.lit(term)), F.regexp_count(lowered, F.lit(bounded(term)))).otherwise(0)


def sentence_around(text: Column, index: Column, most: int = 260) -> Column:
    """The sentence that holds the zero-based index: from the stop before it to the stop after it."""
    before = F.regexp_extract(F.substr(text, F.lit(1), index), r"(?s)^(?:.*[.!?](?=\s))?(.*)$", 1)
    after = F.regexp_extract(F.substr(text, index + 1), r"(?s)^(.*?[.!?](?=\s|$)|.*)", 1)
    return F.substring(squish(F.concat(before, after)), 1, most)


def window_around(text: Column, index: Column, length: Column, radius: int) -> Column:
    start = F.greatest(F.lit(0), index - radius)
    return F.substr(text, start + 1, index + length + radius - start)


def floor_round(c: Column, digits: int) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c * (10.0**digits) + 0.5) / (10.0**digits)
