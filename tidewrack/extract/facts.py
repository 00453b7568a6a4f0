"""Facts of an item by expressions: trial ids, phase, outcome, regulatory actions, evidence, events, article class. Results and
deals, which need every match and its surroundings, come from one vectorised function."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Collection
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack import config
from tidewrack.extract import patterns as P
from tidewrack.functions.text import sentence_around, squish

#: JSON schema of what ``measures`` finds.
MEASURES = "results array<struct<metric:string,value:string,verbatim:string>>, deal struct<type:string,upfront_usd_m:double,total_usd_m:double,round:string,currency:string,verbatim:string>, hints long"


def hints(text: Column) -> Column:
    """What ``patterns.hints`` finds, a number; a column of its own, so that a text is looked through once for all patterns."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: P.hints(t or "")), "long")(text)


def may(pattern: str, hinted: Column | None = None) -> Column:
    """Whether a text holds what the pattern can't match without; ``hinted`` comes from ``hints``."""
    return F.lit(True) if hinted is None else hinted.bitwiseAND(F.lit(1 << P.HINTED.index(pattern)).cast("long")) != 0


def found(text: Column, pattern: str, hinted: Column | None = None) -> Column:
    return F.when(may(pattern, hinted), text.rlike(P.ascii(pattern))).otherwise(text.isNull() & F.lit(None).cast("boolean"))


def first_match(text: Column, pattern: str, group: int = 0, hinted: Column | None = None) -> Column:
    """Null if there is none."""
    return F.when(may(pattern, hinted), F.nullif(F.regexp_extract(text, P.ascii(pattern), group), F.lit("")))


def nct_ids(text: Column, known: Column | None = None, most: int = 3, hinted: Column | None = None) -> Column:
    all_ = F.when(may(P.NCT, hinted), F.regexp_extract_all(text, F.lit(P.ascii(P.NCT)), 0)).when(text.isNotNull(), F.array().cast("array<string>"))
    own = F.transform(all_, lambda m: F.upper(F.regexp_replace(m, r"\s", "")))
    return F.slice(F.array_distinct(F.concat(F.coalesce(known, F.array().cast("array<string>")), own) if known is not None else own), 1, most)


def phase(text: Column, hinted: Column | None = None) -> Column:
    return squish(first_match(text, P.PHASE, hinted=hinted))


def enrollment(text: Column, hinted: Column | None = None) -> Column:
    return F.regexp_replace(first_match(text, P.ENROLLED, 1, hinted), ",", "").try_cast("int")


def outcome(text: Column, hinted: Column | None = None) -> Column:
    """Both a hit and a miss are 'mixed'."""
    hit, miss = found(text, P.HIT, hinted), found(text, P.MISS, hinted)
    return F.when(hit & miss, "mixed").when(hit, "met").when(miss, "missed")


def regulatory(text: Column, hinted: Column | None = None) -> Column:
    """Up to 4 of struct(agency, action, verbatim), distinct by agency and action."""

    def fact(pattern: str, agency: Column, action: Column) -> Column:
        at = F.when(may(pattern, hinted), F.regexp_instr(text, F.lit(P.ascii(pattern)))).otherwise(0)
        return F.when(at > 0, F.struct(agency.alias("agency"), action.alias("action"), sentence_around(text, at - 1).alias("verbatim")))

    approved = first_match(text, P.APPROVAL, hinted=hinted)
    agency = F.when(approved.rlike("(?i)EMA|CHMP|European"), "EMA").when(approved.rlike("(?i)MHRA"), "MHRA").otherwise("FDA")
    fda = F.lit("FDA")
    facts = F.array(
        fact(P.APPROVAL, agency, F.lit("approval")),
        fact(P.RESPONSE_LETTER, fda, F.lit("complete response letter")),
        fact(P.FILING, fda, F.concat(F.lit("filing ("), first_match(text, P.FILING, hinted=hinted), F.lit(")"))),
        fact(P.DESIGNATION, fda, F.lower(first_match(text, P.DESIGNATION, hinted=hinted))),
        fact(P.COMMITTEE, fda, F.lit("advisory committee")),
    )
    facts = F.filter(facts, lambda f: f.isNotNull())
    names = F.transform(facts, lambda f: F.concat_ws(":", f["agency"], f["action"]))
    return F.slice(F.filter(facts, lambda f, i: F.array_position(names, F.concat_ws(":", f["agency"], f["action"])) == i + 1), 1, 4)


def evidence_level(text: Column, hinted: Column | None = None) -> Column:
    bench = F.when(found(text, P.IN_VITRO, hinted) & ~found(text, P.ANIMAL, hinted), "in-vitro").otherwise("preclinical")
    return F.when(found(text, P.PRECLINICAL, hinted), bench).when(found(text, P.CLINICAL, hinted), "clinical").when(found(text, P.REVIEW, hinted), "review").otherwise("unknown")


def non_mammalian(text: Column, hinted: Column | None = None) -> Column:
    return found(text, P.NON_MAMMALIAN, hinted) & ~found(text, P.HUMAN, hinted)


def article_class(title: Column, url: Column, doi: Column | None = None) -> Column:
    """An identifier beats a title."""
    locator = F.concat_ws(" ", F.coalesce(doi, F.lit("")) if doi is not None else F.lit(""), url)
    return (
        F.when(found(title, P.NOTICE_TITLE), "notice")
        .when(locator.rlike(P.MAGAZINE_ID) | found(title, P.FRONT_MATTER_TITLE) | url.rlike(P.NEWS_PATH), "news-comment")
        .when(locator.rlike(P.JOURNAL_ID), "research")
        .otherwise("unknown")
    )


_COMPILED = {n: P.Guarded(getattr(P, n)) for n in ("RESPONSE", "MEDIAN", "HAZARD", "P_VALUE", "MONEY", "UPFRONT", "MILESTONE", "ROUND", "OFFERING", "MERGER", "ACQUIRED_TRAIT", "ACQUIRES", "LICENSE")}
# How a median's name begins or what it holds, and its metric.
_METRICS = (("pfs", "PFS"), ("progression", "PFS"), ("os", "OS"), ("overall", "OS"), ("dor", "DOR"), ("duration", "DOR"))


@lru_cache(maxsize=4)
def _stops(text: str) -> list[int]:
    return [m.start() for m in re.finditer(r"[.!?](?=\s|$)", text)]


def sentence_at(text: str, index: int, most: int = 260) -> str:
    """The sentence around a place, as ``functions.text.sentence_around`` has it. A text's stops are looked up once."""
    stops = _stops(text)
    nth = bisect_left(stops, index)
    start = stops[nth - 1] + 1 if nth else 0
    end = stops[nth] + 1 if nth < len(stops) else len(text)
    return " ".join(text[start:end].split())[:most]


def trial_results(text: str) -> list[dict]:
    """Response rates, medians, hazard ratios, p-values, in this order, at most 6."""
    out = []
    for m in _COMPILED["RESPONSE"].finditer(text):
        out.append(("ORR", f"{m[1]}%", m.start()))
    for m in _COMPILED["MEDIAN"].finditer(text):
        name = m[1].lower()
        out.append((next((metric for begin, metric in _METRICS if name.startswith(begin)), "EFS"), f"{m[2]} {m[3]}", m.start()))
    out += [("HR", m[1], m.start()) for m in _COMPILED["HAZARD"].finditer(text)]
    out += [("p", "".join(m[0].split()), m.start()) for m in _COMPILED["P_VALUE"].finditer(text)]
    return [{"metric": metric, "value": value, "verbatim": sentence_at(text, at)} for metric, value, at in out[:6]]


def deal(text: str, has_company: bool) -> dict | None:
    """A deal needs a company. Sums are millions of dollars; other currencies are named, never converted."""
    c = _COMPILED
    if not has_company or (c["ACQUIRED_TRAIT"].search(text) and not c["ACQUIRES"].search(text)):
        return None
    sums = list(c["MONEY"].finditer(text))
    round_ = c["ROUND"].search(text)
    kinds = (("M&A", c["MERGER"].search(text)), ("IPO", c["OFFERING"].search(text)), ("financing", round_), ("license", c["LICENSE"].search(text)), ("financing", sums[0] if sums else None))
    kind, anchor = next(((k, m) for k, m in kinds if m), (None, None))
    if kind is None:
        return None
    upfront = total = None
    for m in sums:
        if m[1] != "$":
            continue
        value = float(m[2].replace(",", "")) * (1000 if m[3].lower() in ("b", "bn", "billion") else 1)
        around = text[max(0, m.start() - 24) : m.start() + 48]
        if c["MILESTONE"].search(around):
            total = max(total or 0.0, value)
        elif c["UPFRONT"].search(around):
            upfront = value if upfront is None else upfront
        elif total is None:
            total = value
    name = None
    if round_:
        name = f"Series {round_[1]}" if round_[1] else "seed" if "seed" in round_[0] else None
    currency = {"$": "USD", "€": "EUR", "£": "GBP"}[sums[0][1]] if sums else None
    return {"type": kind, "upfront_usd_m": upfront, "total_usd_m": total, "round": name, "currency": currency, "verbatim": sentence_at(text, anchor.start())}


def _measured(texts: pd.Series, has_company: pd.Series) -> pd.DataFrame:
    rows = [{"results": trial_results(t or ""), "deal": deal(t or "", bool(h)), "hints": P.hints(t or "")} for t, h in zip(texts, has_company, strict=True)]
    return pd.DataFrame(rows, columns=["results", "deal", "hints"])


def measures(text: Column, has_company: Column) -> Column:
    """struct(results, deal, hints) of a text."""
    return F.pandas_udf(_measured, MEASURES)(text, has_company)


def events(text: Column, facts: dict[str, Column], major_journal: Column, preprint: Column, hinted: Column | None = None) -> Column:
    """Event names of an item, distinct. ``facts``: regulatory, outcome, phase, deal."""
    action = F.transform(facts["regulatory"], lambda f: F.when(f["action"] == "approval", "approval").when(f["action"].contains("complete response"), "crl").when(f["action"].startswith("filing"), "filing").otherwise("designation"))
    named = F.when(may(P.HUMAN, hinted), text.rlike(r"(?i)phase\s?(3|III)")).otherwise(False)
    third = F.coalesce(facts["phase"], F.lit("")).rlike(r"(?i)phase\s?(3|III)") | named
    d = facts["deal"]
    size = F.greatest(F.coalesce(d["total_usd_m"], F.lit(0.0)), F.coalesce(d["upfront_usd_m"], F.lit(0.0)))
    large = lambda kind, name: F.when(size >= config.LARGE_DEAL_USD_M[kind], f"{name}-large").otherwise(name)
    dealt = F.when(d["type"] == "M&A", large("ma", "ma")).when(d["type"] == "license", large("license", "license")).when(d["type"] == "IPO", "ipo").when(d.isNotNull(), large("financing", "financing"))
    flags = F.array(
        F.when(facts["outcome"].isNotNull(), F.when(third, "phase3-readout").otherwise("phase-readout")),
        F.when(found(text, P.SAFETY, hinted), "safety-hold"),
        dealt,
        F.when(found(text, P.DISTRESS, hinted), "distress"),
        F.when(found(text, P.PERSONNEL, hinted), "personnel"),
        F.when(found(text, P.OPINION, hinted), "opinion"),
        F.when(major_journal, "major-journal-primary"),
        F.when(preprint, "preprint"),
        F.when(found(text, P.PHASE_3_START, hinted), "phase3-start"),
    )
    return F.array_distinct(F.filter(F.concat(action, flags), lambda e: e.isNotNull()))


def extract(items: DataFrame, major: Collection[str] = config.MAJOR_JOURNALS) -> DataFrame:
    """Adds the facts to ``items``: title, body, nct_ids, has_company, canonical_url, doi, source_id, source_kind. Papers of the
    ``major`` sources, unless they are notices or comments, earn the event of a major journal."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("body", F.lit("")))
    out = items.withColumn("text_", text).withColumn("m_", measures(F.col("text_"), F.col("has_company")))
    t, hinted = F.col("text_"), F.col("m_.hints")
    out = out.withColumns({"phase": phase(t, hinted), "enrollment": enrollment(t, hinted), "outcome": outcome(t, hinted), "regulatory": regulatory(t, hinted), "evidence_level": evidence_level(t, hinted), "non_mammalian": non_mammalian(t, hinted)})
    out = out.withColumns({"nct": nct_ids(t, F.col("nct_ids"), hinted=hinted), "results": F.col("m_.results"), "deal": F.col("m_.deal"), "article_class": article_class(F.col("title"), F.col("canonical_url"), F.col("doi"))})
    facts = {n: F.col(n) for n in ("regulatory", "outcome", "phase", "deal")}
    journal = F.col("source_id").isin(*major) & (F.col("source_kind") == "journal") & ~F.col("article_class").isin("notice", "news-comment")
    return out.withColumn("events", events(t, facts, journal, F.col("source_kind") == "preprint", hinted)).drop("text_", "m_")
