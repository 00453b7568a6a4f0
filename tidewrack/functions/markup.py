"""HTML to text by expressions, and character references by a vectorised function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions.text import squish

# The named references that are decoded.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "hellip": "…", "middot": "·", "deg": "°", "plusmn": "±", "times": "×", "eacute": "é", "egrave": "è",
    "uuml": "ü", "ouml": "ö", "auml": "ä", "ccedil": "ç", "szlig": "ß",
}
# Elements dropped with their content, elements without content, elements that separate words.
DROPPED = "script|style|noscript|iframe|figure|figcaption|form|svg|picture|video|audio"
VOID = "img|source|track|input|link|meta"
SEPARATING = "p|div|br|li|ul|ol|h[1-6]|table|tr|td|th|section|article|figure|figcaption|blockquote|pre|hr|header|footer|aside|nav"
BOILERPLATE = (
    r"(?i)^(sign up|subscribe|read more|continue reading|follow us|share this|editor'?s note|this article|photo|image|credit|advertisement|©"
    r"|all rights reserved|get the latest|listen to|watch:)"
)


def decode_named(c: Column) -> Column:
    """One pass of the named references, without regard to case; the ampersand last, so that nothing is decoded twice."""
    for name, value in [*((n, v) for n, v in NAMED.items() if n != "amp"), ("amp", "&")]:
        c = F.regexp_replace(c, f"(?i)&{name};", value)
    return c


def decode_text(text: str) -> str:
    """Two passes of named and numeric references."""

    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] != "#":
            return NAMED.get(body.lower(), m[0])
        digits = body[2:] if body[1] in "xX" else body[1:]
        try:
            point = int(digits, 16 if body[1] in "xX" else 10)
        except ValueError:
            return m[0]
        if not point:
            return m[0]
        return chr(point) if point < 0x110000 and not 0xD800 <= point < 0xE000 else ""

    for _ in range(2):
        text = re.sub(r"&(#[xX]?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,31});", one, text)
        if "&" not in text:
            break
    return text


def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or "&" not in t else decode_text(t))


def decode_references(c: Column) -> Column:
    """Two passes of named and numeric references, which no built-in decodes."""
    return F.pandas_udf(_decoded, "string")(c)


def html_to_text(c: Column, decode=decode_references) -> Column:
    """Escaped markup is decoded first; dropped elements go with their content, separating tags become spaces."""
    # Only what holds escaped markup is sent to be decoded: whole pages are large.
    c = F.coalesce(decode(F.when(c.contains("&lt;") | c.contains("&gt;"), c)), c)
    c = F.regexp_replace(c, rf"(?is)<({DROPPED})\b[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(c, rf"(?i)<({VOID})\b[^>]*/?>", " ")
    c = F.regexp_replace(c, rf"(?i)</?({SEPARATING})\b[^>]*>", " ")
    return squish(decode(F.regexp_replace(c, "<[^>]+>", "")))


def clean_title_markup(c: Column) -> Column:
    """Only titles with real markup or references change: 'p<0.05' stays."""
    return F.when(c.rlike(r"(?i)</?[a-z][^>]*>|&(?:lt|gt|amp|quot|apos|nbsp|#\d+);"), html_to_text(c)).otherwise(c)


def strip_journal_boilerplate(c: Column) -> Column:
    c = F.regexp_replace(
        c,
        r"(?i)^\s*(Nature|Nature\s+[A-Za-z ]+|Science|Cell|Cell\s+[A-Za-z ]+)\s*,?\s*(Published online|Advance online publication|Available online)[^;]*;?\s*",
        "",
    )
    return squish(F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*doi:\s*10\.\d{4,9}/\S+\s*", ""), r"(?i)\s*doi:\s*10\.\d{4,9}/\S+\s*$", ""))


def is_boilerplate(c: Column) -> Column:
    return F.trim(c).rlike(BOILERPLATE)


def wrong_shape(body: Column, expected: Column) -> Column:
    """Why a body can't be what was asked for ('json' or 'xml'), or null."""
    head = F.lower(F.substring(F.ltrim(body), 1, 400))
    page = head.rlike(r"^(<!doctype html|<html)")
    title = F.regexp_extract(head, r"<title[^>]*>([^<]*)", 1)
    return (
        F.when(F.trim(body) == "", "empty body")
        .when((expected == "json") & ~head.rlike(r"^[\[{]"), F.when(page, F.concat(F.lit("page instead of json: "), title)).otherwise("not json"))
        .when((expected == "xml") & page, F.concat(F.lit("page instead of xml: "), title))
        .when((expected == "xml") & ~head.startswith("<"), "not xml")
    )
