"""What is looked for before a pattern never hides one of its matches."""

import random
import re

import pytest

from tidewrack.extract import entities, patterns
from tidewrack.operators import summary
from tidewrack.plans.daily import NEWS
from tidewrack.plans.digest import SENTENCES

MORE = (
    "nct 01234567 and Ph. 2b; PHASE II/III, n = 1,200 patients", "achieved the co-primary objective", "statistically significantly improved", "fell flat", "discontinuing the trial", "Grade 4 TRAEs", "deaths among the study group",
    "CHMP has now cleared it", "approved by the European Commission", "wins marketing authorisation", "scored an EMA nod", "CRLs", "510(k) and sBLA", "filed for approval", "RMAT", "PRIME designation", "ODAC", "US$1.5bn", "Series C",
    "seed financing", "priced its large offering", "tipo IPO", "definitive merger agreement", "acquired resistance", "ex-China rights", "out-licensing", "laid off; laying off; cutting 30% of staff", "Chapter 11", "names a new CFO",
    "Chutes & Ladders", "Q&A", "C. elegans", "cell lines", "rodents? rodent", "phase 3 starts; dosed the first", "ORR was 45.1 %", "median overall survival of 3 months", "HR 0.45", "hazard ratio: 1.20", "p < 0.05",
    "MERGER with", "LıCENſE agreement", "INTERVIEW", "cohort of 12", "meta-analysis",
)


@pytest.mark.parametrize("name", sorted({n for n, v in vars(patterns).items() if isinstance(v, str) and v in {**patterns.EXACT, **patterns.LOWER}}))
def test_guard_lets_every_match_through(name):
    guard = patterns.Guarded(getattr(patterns, name))
    for text in (*SENTENCES, *NEWS, *MORE):
        for form in (text, text.upper(), text.lower(), "x " + text.replace(" ", "\n")):
            assert bool(guard.search(form)) == bool(guard.compiled.search(form)), form
            if getattr(patterns, name) in patterns.HINTED and re.compile(patterns.ascii(getattr(patterns, name)), re.ASCII).search(form) and form.isascii():
                assert patterns.hints(form) >> patterns.HINTED.index(getattr(patterns, name)) & 1, form


def test_drug_endings_are_found_where_words_end():
    text = "imatinib, imatinib_x ximatinib-Imatinib 5imatinib candidate imatinib"
    words = [(m.start(), m[1]) for m in re.finditer(r"(?<![A-Za-z0-9_])([A-Za-z][a-zA-Z]{4,24})(?![A-Za-z0-9_])", text)]
    assert [(at, w) for at, w, _ in entities._stemmed(text)] == [(at, w) for at, w in words if w.lower().endswith("nib")]


def test_sentences_end_as_the_lookbehind_has_it():
    """Parts before joining on: the rule as one pattern."""
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(["A b", ". ", ".) ", "!” X", "? y", " (e.g. ", " 12. ", ".", ' "', "\n"]) for _ in range(12))
        parts = [p for p in re.split(r"(?<=[.!?])[\"”’')\]]*\s+", " ".join(text.split())) if p]
        out = []
        for p in parts:
            if out and (summary._SHORTENED.search(out[-1]) or p[0].islower()):
                out[-1] += " " + p
            else:
                out.append(p)
        assert summary.sentences(text) == out
