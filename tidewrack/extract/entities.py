"""Drugs, companies, indications, modalities and targets of items, with counts, places and evidence.

Offsets of every match have no built-in, so one Arrow-batched function reads an item's text once and returns all five
lists. Each list is ordered by confidence, presence in the title and count, and ends at its limit.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.extract import lexicon as L
from tidewrack.extract.facts import sentence_at
from tidewrack.extract.patterns import ODD, ascii, lowered

#: Higher wins where mentions merge.
CONFIDENCE = {"dictionary": 4, "code": 3, "stem+anchor": 2, "contextual": 1, "stem-only": 0}
MENTION = "struct<text:string,canonical:string,id:string,confidence:string,count:int,in_title:boolean,evidence:array<string>,detail:string,role:string>"
SCHEMA = ", ".join(f"{name} array<{MENTION}>" for name in ("drugs", "companies", "indications", "modalities", "targets"))
LIMITS = {"drugs": 8, "companies": 8, "indications": 6, "modalities": 6, "targets": 6}


class Found:
    """Mentions of one kind, by key, in order of first appearance."""

    def __init__(self, title: str, text: str):
        self.title, self.low, self.text, self.by = title, title.lower(), text, {}

    def add(self, key: str, shown: str, confidence: str, at: int, canonical: str | None = None, detail: str | None = None, exact: bool = False) -> None:
        held = self.by.get(key)
        if held is None:
            inside = shown in self.title if exact else shown.lower() in self.low
            held = self.by[key] = {"text": shown, "canonical": canonical or key, "id": key, "confidence": confidence, "count": 0, "in_title": inside, "evidence": [], "detail": None, "role": None}
        held["count"] += 1
        held["detail"] = held["detail"] or detail
        if CONFIDENCE[confidence] > CONFIDENCE[held["confidence"]]:
            held["confidence"] = confidence
        if len(held["evidence"]) < 2 and (quote := sentence_at(self.text, at)[:240]):
            held["evidence"].append(quote)

    def ranked(self, kind: str) -> list[dict]:
        return sorted(self.by.values(), key=lambda m: (-CONFIDENCE[m["confidence"]], not m["in_title"], -m["count"]))[: LIMITS[kind]]


_rx = lambda p: re.compile(ascii(p))
_lit = lambda p: tuple(x.rstrip("?").lower() for x in p.split("|"))
_PAYLOADS = _lit(L.PAYLOADS)
# What a code or a symbol begins with: searched for first, a set of letters that a matcher can skip to.
_CODE_LIKE, _SYMBOL_LIKE = re.compile(r"[A-Z][A-Z][-‑ ]?\d\d"), re.compile(r"[A-Z][A-Z0-9]")
_PAYLOAD, _CODE = _rx(rf"(?i)\b({L.PAYLOADS})\b"), _rx(r"\b([A-Z]{2,6})[-‑ ]?(\d{2,6})(?:[-‑]?([A-Za-z]\d{0,3}))?\b")
_DRUG_CUE, _TARGET_CUE, _CORPORATE = _rx(L.DRUG_CUE), _rx(L.TARGET_CUE), _rx(L.CORPORATE_CUE)
_NO_CODE_AFTER = _rx(r"(?i)[$#]\s*$|\b(n|p)\s*=\s*$|\bphase\s*$|\bQ\s*$|\bgrade\s*$")
_STEMS = [(tuple(ends.split("|")), name, least) for ends, name, least in L.STEMS]
_ENDS = tuple({end for ends, _, _ in _STEMS for end in ends})
_LETTERS, _OTHER = re.compile("[A-Za-z]{5,}"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_SYMBOL = _rx(r"\b([A-Z][A-Z0-9]{1,7}(?:-[A-Z0-9]{1,4})?)\b")
_SUFFIXED = _rx(rf"\b([A-Z][A-Za-z0-9&.'-]+(?:\s+[A-Z][A-Za-z0-9&.'-]+){{0,3}})\s+({L.SUFFIXES})\b")
_SUFFIX = re.compile(L.SUFFIXES)
_SUFFIXES, _MERGERS = tuple(re.sub(r".\?|\\.*", "", s) for s in L.SUFFIXES.split("|")), ("acquir", "to buy", "buyout", "merge", "takeover", "tender offer")
_MERGER = _rx(r"(?i)\b(acquir\w+|to buy|buyout|merge[sr]?\w*|takeover|tender offer)\b")
_ALIASES = sorted(((a, c) for c in L.COMPANIES for a in c.aliases), key=lambda x: -len(x[0]))
_ALIASES = [(a, c, _rx(rf"\b{re.escape(a)}\b")) for a, c in _ALIASES]
_MODALITIES = {name: _rx(p) for name, p in L.MODALITIES.items()}
_bounded = lambda term: re.compile(rf"(?i)(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])")
_INDICATIONS = [(i, [(s, _bounded(s)) for s in i.synonyms], [(a, _rx(rf"\b{re.escape(a)}\b")) for a in i.abbreviations], re.compile(i.requires) if i.requires else None) for i in L.INDICATIONS]


def _lowered(text: str) -> str:
    """In lower case, for looking whether a string may be there; letters that match i, s or k without regard to case become these."""
    low = lowered(text)
    return text.translate({ord(a): b for a, b in zip(ODD, "iisk", strict=True)}).lower() if low is None else low


@lru_cache(maxsize=200_000)
def _stem(low: str) -> str | None:
    """The class of drugs that a word ends like."""
    return next((name for ends, name, least in _STEMS if len(low) >= least and low.endswith(ends)), None)


def _stemmed(text: str) -> list[tuple[int, str, str]]:
    """place, word, class of the words of 5 to 25 letters, bounded by no letter, digit or underscore, with a drug's ending."""
    low = _lowered(text)
    if not any(end in low for end in _ENDS):
        return []
    out = []
    for word in set(_LETTERS.findall(text)):
        if len(word) > 25 or not (name := _stem(word.lower())):
            continue
        at = text.find(word)
        while at >= 0:
            end = at + len(word)
            if (not at or text[at - 1] not in _OTHER) and (end == len(text) or text[end] not in _OTHER):
                out.append((at, word, name))
            at = text.find(word, end)
    return sorted(out)


def around(text: str, start: int, end: int, radius: int) -> str:
    return text[max(0, start - radius) : end + radius]


def companies(title: str, text: str) -> list[dict]:
    """Known names; ambiguous ones need a corporate word near by or a ticker; then names with a corporate suffix."""
    found = Found(title, text)
    for alias, c, pattern in _ALIASES:
        if alias not in text:
            continue
        for m in pattern.finditer(text):
            if alias.lower() in L.AMBIGUOUS and not c.ticker and not _CORPORATE.search(around(text, m.start(), m.end(), 80)):
                continue
            found.add(c.id, alias, "dictionary", m.start(), c.name, c.ticker)
    low = _lowered(text)
    for m in _SUFFIXED.finditer(text) if any(s in text for s in _SUFFIXES) and _SUFFIX.search(text) else ():
        if not any(x["text"] in m[0] for x in found.by.values()):
            found.add(re.sub("[^a-z0-9]+", "-", m[0].lower()), m[0], "contextual", m.start(), m[0])
    ranked = found.ranked("companies")
    for x in ranked:
        x["role"] = "mentioned"
    if verb := any(h in low for h in _MERGERS) and _MERGER.search(text):
        buyer = next((x for x in ranked if x["text"] in text[: verb.start()]), None)
        bought = next((x for x in ranked if x is not buyer and x["text"] in text[verb.start() :]), None)
        if buyer:
            buyer["role"] = "acquirer"
        if bought:
            bought["role"] = "target"
    return ranked


def drugs(title: str, text: str, company_words: set[str]) -> list[dict]:
    """Conjugate payloads, words with a drug's ending, development codes. An ending alone counts from two mentions or in the
    title; words of known companies never do."""
    found = Found(title, text)
    low = _lowered(text)
    for m in _PAYLOAD.finditer(text) if any(p in low for p in _PAYLOADS) else ():
        found.add(m[0].lower(), m[0], "dictionary", m.start(), detail="antibody-drug conjugate")
    for at, word, name in _stemmed(text):
        low = word.lower()
        if low in L.NOT_DRUGS or low in company_words or low.endswith("ase") or word.isupper():
            continue
        cue = _DRUG_CUE.search(around(text, at, at + len(word), 60))
        found.add(low, word, "stem+anchor" if cue else "stem-only", at, detail=name)
    for m in _CODE.finditer(text) if _CODE_LIKE.search(text) else ():
        prefix, digits, tail = m.groups()
        year = re.fullmatch(r"(19|20)\d{2}", digits) and not tail
        if prefix in L.NOT_CODES or (len(prefix) == 2 and prefix not in L.SPONSOR_CODES) or year or _NO_CODE_AFTER.search(text[max(0, m.start() - 12) : m.start()]):
            continue
        found.add(m[0].lower(), m[0], "code", m.start())
    for x in found.by.values():
        if x["confidence"] == "stem-only" and (x["count"] >= 2 or x["in_title"]):
            x["confidence"] = "stem+anchor"
    return found.ranked("drugs")


def indications(title: str, text: str) -> list[dict]:
    """The first synonym that occurs, else an abbreviation, in its case, where what it requires occurs too."""
    found = Found(title, text)
    low = lowered(text) or text.lower()
    for i, synonyms, short, requires in _INDICATIONS:
        hit = next(((s, m, "dictionary", p) for s, p in synonyms if s.lower() in low and (m := p.search(text))), None)
        if hit is None and short:
            hit = next(((a, m, "contextual", _bounded(a)) for a, p in short if a in text and (m := p.search(text))), None)
            if hit and requires and not requires.search(text):
                hit = None
        if hit:
            shown, m, confidence, pattern = hit
            found.add(i.canonical, shown, confidence, m.start())
            found.by[i.canonical]["count"] = len(pattern.findall(text))
    return found.ranked("indications")


def modalities(title: str, text: str) -> list[dict]:
    found = Found(title, text)
    low = lowered(text) or text.lower()
    for name, pattern in _MODALITIES.items():
        if not any(hint in low for hint in L.MODALITY_HINTS[name].split()):
            continue
        for m in pattern.finditer(text):
            found.add(name, m[0], "dictionary", m.start())
        if name in found.by:
            found.by[name]["in_title"] = bool(pattern.search(title))
    return found.ranked("modalities")


def targets(title: str, text: str) -> list[dict]:
    """Known symbols anywhere; others of three characters or more near a word of biology, if they are no ordinary word."""
    found = Found(title, text)
    for m in _SYMBOL.finditer(text) if _SYMBOL_LIKE.search(text) else ():
        symbol = m[0]
        known = symbol in L.TARGETS
        if symbol not in found.by and not known:
            if symbol in L.HOMOGRAPHS or symbol in L.NOT_CODES or len(symbol) < 3 or not _TARGET_CUE.search(around(text, m.start(), m.end(), 80)):
                continue
        found.add(symbol, symbol, "dictionary" if known else "contextual", m.start(), exact=True)
    return found.ranked("targets")


def entities_of(title: str | None, body: str | None) -> dict[str, list[dict]]:
    title, body = title or "", body or ""
    text = f"{title}. {body}"
    named = companies(title, text)
    words = {w for c in named for w in c["text"].lower().split()}
    return {"drugs": drugs(title, text, words), "companies": named, "indications": indications(title, text), "modalities": modalities(title, text), "targets": targets(title, text)}


def _entities(titles: pd.Series, bodies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([entities_of(t, b) for t, b in zip(titles, bodies, strict=True)], columns=list(LIMITS))


def entities(title: Column, body: Column) -> Column:
    """struct of the five lists."""
    return F.pandas_udf(_entities, SCHEMA)(title, body)


def extract(items: DataFrame) -> DataFrame:
    """Adds drugs, companies, indications, modalities and targets to ``items`` (title, body), entity_text, keys and has_company."""
    out = items.withColumn("e_", entities(F.col("title"), F.col("body")))
    out = out.select(*[c for c in out.columns if c != "e_"], "e_.*")
    shown = lambda c: F.filter(c, lambda m: m["confidence"] != "stem-only")
    pick = lambda c, f: F.transform(F.col(c), lambda m: m[f])
    keys = F.concat(
        F.transform(F.coalesce("nct_ids", F.array().cast("array<string>")), lambda n: F.concat(F.lit("nct:"), n)),
        F.transform(shown(F.col("drugs")), lambda m: F.concat(F.lit("drug:"), m["canonical"])),
        F.transform("companies", lambda m: F.concat(F.lit("co:"), m["id"])),
        F.transform("targets", lambda m: F.concat(F.lit("target:"), m["canonical"])),
    )
    named = F.transform("companies", lambda m: F.concat_ws(" ", m["canonical"], F.coalesce(m["detail"], F.lit(""))))
    text = F.array_join(F.concat(named, pick("drugs", "text"), pick("targets", "canonical"), pick("indications", "canonical")), " ")
    return out.withColumns({"keys": F.array_distinct(keys), "entity_text": text, "has_company": F.size(shown(F.col("companies"))) > 0})
