"""The patterns of facts and events. They are written with \\b; ``ascii`` makes the boundary an ASCII one, as
the JVM's is not."""

import re
from functools import lru_cache

AGENCY = "(?:FDA|EMA|CHMP|MHRA|PMDA|NMPA|European Commission)"
NCT = r"(?i)\bNCT\s?0?\d{7,8}\b"
PHASE = r"(?i)\b(?:phase|ph\.?)\s?(1/2|2/3|1b/2|I/II|II/III|Ib/II|[1-4]|I{1,3}V?|IV)\s?([ab])?\b"
ENROLLED = r"(?i)\b(?:n\s?=\s?|enrolled|randomi[sz]ed|treated|dosed)\s?(\d{1,3}(?:,\d{3})*)\s?(?:patients|participants|subjects)?\b"
RESPONSE = r"(?i)\b(?:ORR|o(?:verall|bjective)\s+response\s+rate)\D{0,25}(\d{1,3}(?:\.\d)?)\s?%"
MEDIAN = r"(?i)\bmedian\s+(PFS|OS|DOR|EFS|progression-free survival|overall survival|duration of response)\D{0,20}(\d{1,3}(?:\.\d)?)\s?(months?|mo\b|weeks?|years?)"
HAZARD = r"(?i)\b(?:HR|hazard ratio)\s?(?:of|=|:)?\s?(0?\.\d{1,3}|\d\.\d{1,3})"
P_VALUE = r"\bp\s?[<=>]\s?(0?\.\d+|\d\.\d+(?:[eE]-?\d+)?)"
HIT = r"(?i)\b(?:met|achieved|hit)\s+(?:its\s+|the\s+)?(?:co-)?primary\s+(?:endpoint|objective)|statistically significant(?:ly)?\s+(?:improv|reduc|increas)"
MISS = (
    r"(?i)\b(?:missed|failed to (?:meet|achieve)|did not (?:meet|achieve|reach)|fell short of)\s+(?:its\s+|the\s+)?(?:co-)?primary"
    r"|no statistically significant|\bflopped\b|\bfell flat\b|discontinu(?:ed|ing) the (?:study|trial|program)"
)
SAFETY = (
    r"(?i)\bgrade\s?([3-5])\s?(?:\+|or higher)?\s?(?:treatment-related\s?)?(?:adverse events?|AEs?|TRAEs?)\b|\bclinical hold\b|\bboxed warning\b"
    r"|\bdeaths? (?:in|among) (?:the )?(?:treatment|study) (?:arm|group)"
)
APPROVAL = (
    rf"(?i)\b{AGENCY}\b(?![)\]]?\s*-\s*(?:approv|authoris|authoriz|clear|licens))[^.]{{0,60}}?"
    r"\b(?:approve[sd]?|approving|clear(?:s|ed|ing)|authoris(?:e|es|ed)|authoriz(?:e|es|ed)|licen[cs]e[sd]?)\b"
    rf"|\b(?:approved|cleared|authoris(?:ed)?|authoriz(?:ed)?)\s+by\s+(?:the\s+)?{AGENCY}\b"
    r"|\b(?:(?:gain|secur|receiv|grant|scor|nab|clinch|obtain|achiev)\w*|wins?|won)\b[^.]{0,50}?"
    rf"\b(?:approval|marketing authoris\w+|marketing authoriz\w+|{AGENCY}\s+nod|regulatory\s+nod)\b"
)
RESPONSE_LETTER = r"\bcomplete response letter\b|\bCRLs?\b"
FILING = r"\b(?:BLA|sBLA|NDA|sNDA|MAA|IND|510\(k\)|PMA)\b|\bfiled for (?:approval|marketing)\b|\bsubmitted (?:an? )?(?:BLA|NDA|MAA)\b"
DESIGNATION = r"(?i)\b(?:breakthrough therapy|fast track|orphan drug|RMAT|PRIME|priority review|accelerated approval)(?:\s+designation)?\b"
COMMITTEE = r"(?i)\b(?:advisory committee|adcomm|ODAC)\b"
MONEY = r"(?:US)?([$€£])\s?(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s?(billion|bn|million|mn|[BM])\b"
UPFRONT, MILESTONE = r"(?i)\b(upfront|up front)\b", r"(?i)\bmilestones?\b"
ROUND = r"\bSeries\s+([A-J])\b|\bseed (?:round|financing)\b|\bcrossover\b"
OFFERING = r"(?i)\bIPO\b|initial public offering|priced its[^.]{0,30}offering|Nasdaq debut|listed on (?:the )?(?:Nasdaq|NYSE)"
MERGER = r"(?i)\b(?:acquires?|acquiring|acquisition of|agreed to acquire|will acquire|to buy|buyout|merger|merge with|takeover|tender offer|definitive (?:merger )?agreement)\b"
ACQUIRED_TRAIT = r"(?i)\bacquired\s+(resistance|immunity|mutations?|deficiency|characteristics|phenotypes?|traits?)\b"
ACQUIRES = r"(?i)\b(acquires?|acquisition of|agreed to acquire)\b"
LICENSE = (
    r"(?i)\b(?:licensing (?:agreement|deal|pact)|license agreement|licensed (?:to|from)|exclusive licen[cs]e|out-licens\w+|in-licens\w+|ex-China rights"
    r"|(?:global|worldwide|ex-US) rights|collaboration (?:and license )?agreement)\b"
)
DISTRESS = r"(?i)\b(lay(?:ing)? off|layoffs?|restructur\w+|cut(?:ting)? \d{1,3}% of (?:its )?(?:staff|workforce)|winding down|Chapter 11|discontinu\w+ (?:its )?(?:pipeline|program))\b"
PERSONNEL = (
    r"(?i)\b(?:names?|appoints?|hires?|steps? down|departs?|resigns?|succeeds?)\b[^.]{0,40}"
    r"\b(?:CEO|CFO|CSO|CMO|COO|chief executive|chief medical|chief scientific|president)\b"
)
OPINION = r"(?i)\b(?:opinion|commentary|editorial|roundup|q&a|interview|viewpoint|perspective|chutes & ladders|newsletter)\b"
PRECLINICAL = r"(?i)\b(in mice|in mouse|murine|mouse model|rodent|in vitro|cell lines?|organoids?|zebrafish|C\. elegans|Drosophila|preclinical|non-human primates?)\b"
IN_VITRO, ANIMAL = r"(?i)\b(in vitro|cell lines?|organoids?)\b", r"(?i)\bmice|mouse|murine|rodent\b"
NON_MAMMALIAN = (
    r"(?i)\b(Apis (?:cerana|mellifera)|honeybees?|Drosophila|fruit fly|C\. elegans|Caenorhabditis|nematodes?|zebrafish|Danio rerio|yeast|S\. cerevisiae"
    r"|Saccharomyces|Arabidopsis|E\. coli|planaria|killifish|Xenopus|sugarcane|maize|Zea mays|Oryza sativa|sorghum|barley|cassava|soybean|meristem"
    r"|chloroplasts?|photosynthesis|cyanobacteri(?:a|um)|Chlamydomonas)\b"
)
HUMAN = r"(?i)\b(patients|clinical trial|phase\s?[1-4])\b"
CLINICAL = r"(?i)\b(patients|participants|randomi[sz]ed|phase\s?[1-4]|enrolled|volunteers|cohort of \d+)\b"
REVIEW = r"(?i)\b(review|meta-analysis|systematic review|perspective|commentary)\b"
PHASE_3_START = r"(?i)\bphase\s?(3|III)\b[^.]{0,60}\b(initiat|start|begin|dosed the first|first patient)"
NOTICE_TITLE = (
    r"(?i)^\s*(?:author correction|publisher correction|correction|corrigend(?:um|a)|erratum|errata|retraction note|retracted article|withdrawn"
    r"|(?:editorial )?expression of concern|addendum)\b"
)
FRONT_MATTER_TITLE = (
    r"(?i)^\s*(?:editor(?:'|’)s pick|editorial|in this issue|this month in|books? (?:in brief|and arts)|book review|career (?:column|feature|guide)"
    r"|where i work|obituary|correspondence|news\s*(?:&|and)\s*views|matters arising|reply to|comment on|author response)\b"
)
MAGAZINE_ID, JOURNAL_ID = r"(?:^|[/:])d\d{5}-\d{2,4}-", r"(?:^|[/:])s\d{5}-\d{2,4}-"
NEWS_PATH = r"(?i)/(?:content/article|news|newsroom|careers|blogs?|podcasts?|opinion)/"

_WORD = "[A-Za-z0-9_]"

#: What a text must hold for a pattern to match at all: of every group one string, in the text as it is or in lower case. Most
#: texts lack most facts, and looking for a few strings takes a small part of the time of a pattern with boundaries.
#: A string that begins with ~ is a pattern itself, one that starts with its own text.
EXACT = {
    FILING: (("BLA", "NDA", "MAA", "IND", "510(k)", "PMA", "filed for ", "submitted "),),
    RESPONSE_LETTER: (("complete response letter", "CRL"),),
    MONEY: (("$", "€", "£"),),
    P_VALUE: (("<", "=", ">"),),
    ROUND: (("Series", "seed ", "crossover"),),
}
_AGENCIES = ("fda", "ema", "chmp", "mhra", "pmda", "nmpa", "european commission")
LOWER = {
    NCT: (("nct",),),
    PHASE: ((r"~ph(?<![a-z0-9_]ph)(?:ase|\.)?\s?[1-4i]",),),
    ENROLLED: (("=", "enrolled", "randomi", "treated", "dosed"),),
    RESPONSE: (("%",), ("orr", "response")),
    MEDIAN: (("median",),),
    HAZARD: ((r"~h(?:r|azard ratio)\s?(?:of|=|:)?\s?\d?\.\d",),),
    HIT: (("primary", "statistically significant"), ("met", "achieved", "hit", "statistically significant")),
    MISS: (("missed", "failed to ", "did not ", "fell short of", "no statistically significant", "flopped", "fell flat", "discontinu"),),
    SAFETY: ((r"~grade\s?[3-5]", "clinical hold", "boxed warning", "death in ", "deaths in ", "death among ", "deaths among "),),
    APPROVAL: ((*_AGENCIES, "approval", "marketing authori", "regulatory"), ("approv", "clear", "authori", "licen", "nod")),
    DESIGNATION: (("breakthrough therapy", "fast track", "orphan drug", "~rmat(?<![a-z0-9_]rmat)(?![a-z0-9_])", "~prime(?<![a-z0-9_]prime)(?![a-z0-9_])", "priority review", "accelerated approval"),),
    COMMITTEE: (("advisory committee", "adcomm", "odac"),),
    OFFERING: (("~ipo(?<![a-z0-9_]ipo)(?![a-z0-9_])", "initial public offering", "priced its", "nasdaq debut", "listed on"),),
    MERGER: (("acqui", "to buy", "buyout", "merge", "takeover", "tender offer", "definitive"),),
    ACQUIRED_TRAIT: (("acquired",),),
    ACQUIRES: (("acqui",),),
    LICENSE: (("licens", "licenc", "rights", "collaboration"),),
    DISTRESS: (("lay off", "laying off", "layoff", "restructur", "% of", "winding down", "chapter 11", "discontinu"),),
    PERSONNEL: (("ceo", "cfo", "cso", "cmo", "coo", "chief executive", "chief medical", "chief scientific", "president"), ("name", "appoint", "hire", "step", "depart", "resign", "succeed")),
    OPINION: (("opinion", "commentary", "editorial", "roundup", "q&a", "interview", "viewpoint", "perspective", "chutes & ladders", "newsletter"),),
    PRECLINICAL: (("in mice", "in mouse", "murine", "mouse model", "rodent", "in vitro", "cell line", "organoid", "zebrafish", "c. elegans", "drosophila", "preclinical", "non-human primate"),),
    IN_VITRO: (("in vitro", "cell line", "organoid"),),
    ANIMAL: (("mice", "mouse", "murine", "rodent"),),
    NON_MAMMALIAN: (
        (
            "apis cerana", "apis mellifera", "honeybee", "drosophila", "fruit fly", "c. elegans", "caenorhabditis", "nematode", "zebrafish", "danio rerio", "yeast", "s. cerevisiae", "saccharomyces",
            "arabidopsis", "e. coli", "planaria", "killifish", "xenopus", "sugarcane", "maize", "zea mays", "oryza sativa", "sorghum", "barley", "cassava", "soybean", "meristem", "chloroplast",
            "photosynthesis", "cyanobacteri", "chlamydomonas",
        ),
    ),
    HUMAN: (("patients", "clinical trial", "phase"),),
    CLINICAL: (("patients", "participants", "randomi", "phase", "enrolled", "volunteers", "cohort of"),),
    REVIEW: (("review", "meta-analysis", "perspective", "commentary"),),
    PHASE_3_START: (("phase",), ("initiat", "start", "begin", "dosed the first", "first patient")),
}
#: Letters beyond ASCII that Python's matcher takes for i, s or k without regard to case: a text that has one is not passed over.
ODD = "İıſK"


def _holds(low: str, groups: tuple) -> bool:
    return all(any(re.search(h[1:], low) if h[0] == "~" else h in low for h in group) for group in groups)


@lru_cache(maxsize=4)
def lowered(text: str) -> str | None:
    """Null for a text that may match without regard to case where its lower case does not."""
    return None if not text.isascii() and any(c in text for c in ODD) else text.lower()


#: The patterns that columns use; their places are the bits of ``hints``.
HINTED = (
    NCT, PHASE, ENROLLED, HIT, MISS, SAFETY, APPROVAL, RESPONSE_LETTER, FILING, DESIGNATION, COMMITTEE, DISTRESS, PERSONNEL, OPINION, PRECLINICAL, IN_VITRO, ANIMAL, NON_MAMMALIAN, HUMAN, CLINICAL,
    REVIEW, PHASE_3_START,
)


def hints(text: str) -> int:
    """A bit for each of ``HINTED`` that the text may match."""
    low = text.lower()
    return sum(1 << i for i, p in enumerate(HINTED) if _holds(text, EXACT.get(p, ())) and _holds(low, LOWER.get(p, ())))


class Guarded:
    """A compiled pattern that looks first whether a text can match."""

    def __init__(self, pattern: str):
        self.compiled, self.exact, self.lower = re.compile(ascii(pattern)), EXACT.get(pattern, ()), LOWER.get(pattern, ())

    def may(self, text: str) -> bool:
        return _holds(text, self.exact) and (not self.lower or (low := lowered(text)) is None or _holds(low, self.lower))

    def search(self, text: str) -> re.Match | None:
        return self.compiled.search(text) if self.may(text) else None

    def finditer(self, text: str):
        return self.compiled.finditer(text) if self.may(text) else iter(())


def ascii(pattern: str) -> str:
    """The pattern with boundaries between ASCII word characters and others."""
    return pattern.replace(r"\b", rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))")
