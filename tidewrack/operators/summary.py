"""Extractive summaries: sections of structured abstracts, short texts as they are, else the sentences that say most without
repeating each other. One Arrow-batched function; apply it to what the gates let through."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack import config
from tidewrack.extract.patterns import ascii, lowered
from tidewrack.functions.markup import BOILERPLATE
from tidewrack.functions.text import FOLD_FROM, FOLD_TO

SENTENCES, CHARS, SHORT = 3, 480, 320
REDUNDANCY = 0.15
# Abbreviations that end no sentence, and the patterns that weigh sentences.
ABBREVIATIONS = (
    "dr mr mrs ms prof st vs etc inc corp ltd co llc plc ag nv sa jr sr approx est fig figs eq ref no vol ed eds al ca cf e.g i.e u.s u.k e.u ph.d m.d b.s m.s"
    " mg kg ml"
).split()
RESULT = r"(?i)(\d+(\.\d+)?\s?%|\bp\s?[<=>]\s?0?\.\d+|\bHR\b\s?[=:]?\s?\d|\bn\s?=\s?[\d,]+|[$€£]\s?\d|\b\d+(\.\d+)?\s?(months?|weeks?|years?)\b)"
OUTCOME = r"(?i)\b(met|missed|failed to|did not meet|achieved|approved|rejected|discontinued|halted)\b"
QUOTE = r"(?i)^[\"“']|\b(said|told|added|noted|commented)\b"
PRONOUN = r"^(It|They|This|That|These|Those|He|She|The company|The firm|The drug|The trial|The study|Such)\b"
SECTION = r"(?i)\b(Background|Objectives?|Methods?|Results?|Findings?|Conclusions?|Interpretation|Discussion)\s*:"
WANTED = ("results", "result", "findings", "conclusions", "conclusion", "interpretation")

_RESULT, _OUTCOME, _QUOTE, _PRONOUN, _SECTION = (re.compile(ascii(p)) for p in (RESULT, OUTCOME, QUOTE, PRONOUN, SECTION))
_SHORTENED = re.compile(rf"(?i:(?:^|[\s(])(?:{'|'.join(map(re.escape, ABBREVIATIONS))}))\.$|(?:^|[\s(])[A-Z]\.$|(?:^|\s)\d{{1,3}}\.$")
_STOP_AND_SPACE, _DIGIT = re.compile(r"[.!?][\"”’')\]]*\s+"), re.compile(r"\d")
_OUTCOMES, _QUOTES = ("met", "missed", "failed to", "achieved", "approved", "rejected", "discontinued", "halted"), ("said", "told", "added", "noted", "commented")
_FURNITURE, _FOLD = re.compile(BOILERPLATE), str.maketrans(FOLD_FROM, FOLD_TO)
_STOP, _TOKEN = frozenset(config.STOPWORDS), re.compile("[a-z0-9]{2,}")


def sentences(text: str) -> list[str]:
    """Split after stops followed by white space; fragments after an abbreviation, an initial or a number are joined on, and
    so are those that go on in lower case."""
    text = " ".join(text.split())
    out: list[list[str]] = []
    start = 0
    for end, after in [(m.start() + 1, m.end()) for m in _STOP_AND_SPACE.finditer(text)] + [(len(text), len(text))]:
        p, start = text[start:end], after
        # What shortens is one word at the end: the part's last.
        if p and out and (p[0].islower() or (out[-1][-1][-1] == "." and _SHORTENED.search(out[-1][-1].rpartition(" ")[2]))):
            out[-1].append(p)
        elif p:
            out.append([p])
    return [" ".join(ps) for ps in out]


def tokens(text: str) -> set[str]:
    low = text.lower()
    return set(_TOKEN.findall(low if low.isascii() else low.translate(_FOLD))) - _STOP


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def truncated(text: str, most: int) -> str:
    if len(text) <= most:
        return text
    head = text[:most]
    space = head.rfind(" ")
    return re.sub(r"[\s,;:.\-–—]+$", "", head[:space] if space > most * 0.6 else head) + "…"


def sections(body: str, most: int) -> list[str]:
    """Of an abstract with two labels or more: results and conclusions, at most two; the last of equal labels counts."""
    marks = list(_SECTION.finditer(body))
    if len(marks) < 2:
        return []
    ends = [m.start() for m in marks[1:]] + [len(body)]
    by_label = {m[1].lower(): body[m.end() : end].strip() for m, end in zip(marks, ends, strict=True)}
    return [truncated(by_label[k], most // 2) for k in WANTED if len(by_label.get(k, "")) > 30][:2]


def weight(sentence: str, place: int, entities: list[str], lane_terms: list[str], title: set[str], bag: set[str]) -> float:
    """``bag``: the sentence's tokens. What a pattern can't match without is looked for first."""
    low, held = sentence.lower(), lowered(sentence)
    may = lambda hints: held is None or any(h in held for h in hints)
    result = bool(_DIGIT.search(sentence) and _RESULT.search(sentence))
    value = 0.3 / (1 + 0.35 * place) + 0.25 * min(1, sum(e in low for e in entities) / 3) + 0.25 * result
    value += 0.15 * bool(may(_OUTCOMES) and _OUTCOME.search(sentence)) + 0.15 * min(1, sum(t in low for t in lane_terms) / 4) + 0.05 * jaccard(bag, title)
    quoted = not result and (sentence[0] in "\"“'" or may(_QUOTES)) and _QUOTE.search(sentence)
    return value - (0.2 if quoted else 0)


def summarize(title: str | None, body: str | None, provenance: str | None, lane: str | None, entities: list[str], subject: str | None, most: int = SENTENCES, chars: int = CHARS) -> tuple[list[str], str]:
    """(sentences in order, where they come from: 'abstract', 'dek' or 'extractive')."""
    body = (body or "").strip()
    if provenance in ("abstract", "api") and (found := sections(body, chars)):
        return found, "abstract"
    if provenance in ("dek", "none") or len(body) < SHORT:
        return ([truncated(body, chars)] if body else []), "dek"
    usable = [s for s in sentences(body) if 6 <= s.count(" ") + 1 <= 60 and not _FURNITURE.match(s)]
    if not usable:
        return [truncated(body, chars)], "dek"
    if len(usable) <= most:
        return [truncated(s, chars) for s in usable], "extractive"
    lane_terms, title_tokens = list(config.LANE_TERMS.get(lane or "", ())), tokens(title or "")
    bags = [tokens(s) for s in usable]
    weights = [weight(s, i, entities, lane_terms, title_tokens, bags[i]) for i, s in enumerate(usable)]
    chosen: list[int] = []
    used = 0
    while len(chosen) < most:
        open_ = [i for i in range(len(usable)) if i not in chosen and (not chosen or used + len(usable[i]) <= chars)]
        if not open_:
            break
        best = max(open_, key=lambda i: (weights[i] - REDUNDANCY * max((jaccard(bags[i], bags[j]) for j in chosen), default=0.0), -i))
        chosen.append(best)
        used += len(usable[best])
    out = []
    for i in sorted(chosen):
        lead = _PRONOUN.search(usable[i])
        if i and i - 1 not in chosen and lead:  # what the pronoun stands for was left out
            if subject is None:
                continue
            out.append(subject + usable[i][lead.end() :])
        else:
            out.append(usable[i])
    return out or [truncated(usable[0], chars)], "extractive"


def _summaries(title: pd.Series, body: pd.Series, provenance: pd.Series, lane: pd.Series, entities: pd.Series, subject: pd.Series) -> pd.DataFrame:
    rows = [summarize(t, b, p, n, [x for x in (e if e is not None else ())], s) for t, b, p, n, e, s in zip(title, body, provenance, lane, entities, subject, strict=True)]
    return pd.DataFrame(rows, columns=["digest", "source"])


def summary(title: Column, body: Column, provenance: Column, lane: Column, entities: Column, subject: Column) -> Column:
    """struct(digest, source). ``entities``: lower-cased names; ``subject``: what may stand for a pronoun, or null."""
    return F.pandas_udf(_summaries, "digest array<string>, source string")(title, body, provenance, lane, entities, subject)
