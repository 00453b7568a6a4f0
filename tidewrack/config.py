"""Fixed values of the digest: weights, thresholds, lane terms and word lists. Operators take them as parameters."""

# Scoring weights, penalties, decay, caps and event boosts.
WEIGHTS = {
    "authority": 14,
    "recency": 22,
    "lexicon": 26,
    "laneSpread": 4,
    "event": 18,
    "corroboration": 8,
    "watchlist": 14,
    "factDensity": 6,
}
PENALTIES = {
    "thinContent": 6,
    "opinionRoundup": 6,
    "dateMissing": 5,
    "preclinicalInClinicalLane": 7,
    "nonMammalianModel": 9,
    "reviewArticle": 5,
    "inVitroOnly": 3,
    "offTopic": 8,
    "staleRepeat": 7,
}
LANES = ("clinical-regulatory", "business-deals", "frontier-science", "aging-omics")
LANE_LABELS = {
    "clinical-regulatory": "Clinical & Regulatory",
    "business-deals": "Business, Deals & Financing",
    "frontier-science": "Frontier Science",
    "aging-omics": "Aging, Epigenetics & Omics",
}
LANE_BLURBS = {
    "clinical-regulatory": "Trial readouts, phase transitions, approvals, CRLs, adcomms and safety signals.",
    "business-deals": "M&A, licensing, financings, IPOs, restructurings and leadership changes.",
    "frontier-science": "New mechanisms, modalities and methods from journals and preprints.",
    "aging-omics": "Aging biology, epigenetic clocks and reprogramming, 3D genome, single-cell and spatial omics.",
}
EVENT_LABELS = {
    "approval": "Regulatory approval",
    "crl": "Complete response letter",
    "filing": "Regulatory filing",
    "designation": "Regulatory designation",
    "phase3-readout": "Phase 3 readout",
    "phase-readout": "Trial readout",
    "phase3-start": "New phase 3 start",
    "safety-hold": "Safety signal / clinical hold",
    "ma-large": "Large M&A",
    "ma": "M&A",
    "license-large": "Major licensing deal",
    "license": "Licensing deal",
    "financing-large": "Large financing",
    "financing": "Financing",
    "ipo": "IPO",
    "distress": "Layoffs / restructuring",
    "personnel": "Leadership change",
    "major-journal-primary": "Major-journal paper",
    "preprint": "Preprint",
    "opinion": "Opinion / roundup",
}
HALF_LIFE_HOURS = {"clinical-regulatory": 20, "business-deals": 24, "frontier-science": 72, "aging-omics": 96}
MAX_AGE_DAYS = {"clinical-regulatory": 4, "business-deals": 5, "frontier-science": 14, "aging-omics": 21}
MAX_AGE_DAYS_ACADEMIC = 21
SATURATION = 8
KEEP_THRESHOLD = 24
PER_DAY, PER_LANE, PER_PUBLISHER = 80, 24, 20
PER_SOURCE = max(5, PER_DAY // 10)
LARGE_DEAL_USD_M = {"ma": 1000, "license": 500, "financing": 100}
EVENT_BOOSTS = {
    "approval": 1.0,
    "crl": 0.85,
    "phase3-readout": 0.95,
    "phase-readout": 0.6,
    "safety-hold": 0.85,
    "ma-large": 1.0,
    "ma": 0.8,
    "license-large": 0.7,
    "license": 0.45,
    "financing-large": 0.6,
    "financing": 0.35,
    "ipo": 0.6,
    "major-journal-primary": 0.75,
    "phase3-start": 0.5,
    "filing": 0.5,
    "designation": 0.45,
    "distress": 0.45,
    "preprint": 0.25,
    "personnel": 0.2,
    "opinion": 0.0,
}

# Sources whose research papers earn the event of a major journal.
MAJOR_JOURNALS = (
    "nature",
    "nature-medicine",
    "nature-biotech",
    "nature-genetics",
    "nature-aging",
    "jama",
    "cell",
    "cell-stem-cell",
    "nejm",
    "europepmc-cellpress",
    "europepmc-lancet",
    "europepmc-aaas",
    "europepmc-nejm",
    "europepmc-jama",
)

# Catalogue titles in lower case and the names that readers know.
JOURNAL_NAMES = {
    "cell": "Cell",
    "cell stem cell": "Cell Stem Cell",
    "cell metabolism": "Cell Metabolism",
    "cancer cell": "Cancer Cell",
    "immunity": "Immunity",
    "neuron": "Neuron",
    "molecular cell": "Molecular Cell",
    "developmental cell": "Developmental Cell",
    "cell chemical biology": "Cell Chemical Biology",
    "cell host & microbe": "Cell Host & Microbe",
    "med": "Med",
    "lancet": "The Lancet",
    "the lancet oncology": "The Lancet Oncology",
    "the lancet neurology": "The Lancet Neurology",
    "the lancet respiratory medicine": "The Lancet Respiratory Medicine",
    "the lancet diabetes & endocrinology": "The Lancet Diabetes & Endocrinology",
    "the lancet infectious diseases": "The Lancet Infectious Diseases",
    "the lancet haematology": "The Lancet Haematology",
    "the lancet psychiatry": "The Lancet Psychiatry",
    "science": "Science",
    "science translational medicine": "Science Translational Medicine",
    "science immunology": "Science Immunology",
    "the new england journal of medicine": "New England Journal of Medicine",
    "jama": "JAMA",
    "jama oncology": "JAMA Oncology",
    "jama cardiology": "JAMA Cardiology",
    "jama neurology": "JAMA Neurology",
    "jama internal medicine": "JAMA Internal Medicine",
    "jama pediatrics": "JAMA Pediatrics",
    "jama psychiatry": "JAMA Psychiatry",
    "nature": "Nature",
    "nature medicine": "Nature Medicine",
    "nature biotechnology": "Nature Biotechnology",
    "nature genetics": "Nature Genetics",
    "nature aging": "Nature Aging",
    "nature metabolism": "Nature Metabolism",
    "nature cell biology": "Nature Cell Biology",
    "nature cancer": "Nature Cancer",
    "nature chemical biology": "Nature Chemical Biology",
    "nature biomedical engineering": "Nature Biomedical Engineering",
    "nature reviews drug discovery": "Nature Reviews Drug Discovery",
}

# Lane terms and their weights.
LANE_TERMS = {
    "clinical-regulatory": {
        "phase 3": 3, "phase iii": 3, "phase 2": 2, "phase 1": 1.5, "primary endpoint": 3, "topline": 3, "readout": 2.5, "fda": 3, "ema": 2,
        "approval": 3, "approved": 2.5, "complete response letter": 3.5, "advisory committee": 3, "adcomm": 3, "pdufa": 3, "priority review": 2.5,
        "breakthrough therapy": 2.5, "orphan drug": 2, "clinical hold": 3, "adverse event": 2, "safety signal": 2.5, "randomized": 1.5,
        "placebo": 1.5, "overall survival": 2.5, "progression-free survival": 2.5, "objective response": 2, "biosimilar": 1.5,
        "label expansion": 2, "recall": 1.5, "trial": 1, "patients": 0.75, "nct": 1.5,
    },
    "business-deals": {
        "acquire": 3, "acquisition": 3, "merger": 3.5, "takeover": 3, "buyout": 3, "definitive agreement": 3, "licensing": 2.5,
        "license agreement": 2.5, "collaboration": 1.5, "upfront": 2.5, "milestone": 2, "royalty": 2, "series a": 2.5, "series b": 2.5,
        "series c": 2.5, "seed round": 2, "ipo": 3, "initial public offering": 3, "raised": 1.5, "financing": 2, "valuation": 2,
        "layoffs": 2.5, "restructuring": 2.5, "chapter 11": 3, "winding down": 2.5, "chief executive": 1.5, "ceo": 1.5, "earnings": 1.5,
        "guidance": 1, "billion": 1.5, "million": 0.75, "stake": 1.5,
    },
    "frontier-science": {
        "mechanism": 2, "novel target": 3, "first-in-class": 3, "crispr": 3, "base editing": 3, "prime editing": 3, "gene therapy": 2.5,
        "gene editing": 2.5, "car-t": 2.5, "antibody-drug conjugate": 2.5, "bispecific": 2.5, "sirna": 2.5, "antisense": 2.5, "mrna": 2,
        "protac": 3, "molecular glue": 3, "degrader": 2.5, "structural biology": 2, "cryo-em": 2.5, "protein structure": 2, "organoid": 2,
        "in vivo": 1.5, "preclinical": 1.5, "immunotherapy": 2, "microbiome": 2, "neurodegeneration": 2, "biomarker": 1.5, "pathway": 1,
        "nature": 1, "science": 0.75, "cell": 0.75, "preprint": 1,
    },
    "aging-omics": {
        "aging": 3, "ageing": 3, "longevity": 3, "healthspan": 3, "lifespan": 2.5, "senescence": 3.5, "senolytic": 3.5, "epigenetic clock": 4,
        "biological age": 3.5, "dna methylation": 3, "methylation age": 3.5, "epigenetic reprogramming": 3.5, "partial reprogramming": 3.5,
        "yamanaka": 3.5, "ipsc": 2, "geroscience": 3.5, "rapamycin": 2.5, "metformin": 2, "nad+": 2.5, "sirtuin": 3,
        "mitochondrial dysfunction": 2.5, "proteostasis": 2.5, "autophagy": 2.5, "telomere": 3, "3d genome": 4, "chromatin architecture": 3.5,
        "chromatin": 2, "hi-c": 3, "topologically associating domain": 4, "enhancer": 2, "single-cell": 3, "single cell": 3, "scrna-seq": 3,
        "spatial transcriptomics": 3.5, "spatial omics": 3.5, "multiomics": 3, "proteomics": 2.5, "metabolomics": 2.5, "atac-seq": 3,
        "cell atlas": 3, "clonal hematopoiesis": 3, "stem cell": 2, "regenerative medicine": 2.5,
    },
}

# Words that tokens leave out, and words that weekly terms leave out.
STOPWORDS = (
    "a an and are as at be but by for from has have in into is it its of on or that the their this to was were will with after over new"
    " says say said amid up down out not no"
).split()
WEEKLY_STOPWORDS = (
    "patients study trial data results treatment disease company new research cells cell human clinical drug therapy analysis using high low"
    " showed found may also however based associated significant expression"
).split()

# Clustering.
LINK_HOURS = {"news": 72, "scholarly": 96}
LINK_THRESHOLD = 0.62 * 0.62
NCT_LINK_THRESHOLD = 0.25
SPECIFICITY = {"nct": 1.0, "drug": 0.95, "target": 0.7, "co": 0.35}
FEATURE_WEIGHTS = {"token": 1, "pair": 2, "nct": 8, "drug": 4, "co": 4}

# Weekly rollup.
EWMA_ALPHA = 0.25
LEAST_DOCS, LEAST_LIFT, WARM_WEEKS = 3, 1.8, 3
OVERLAP = 0.6


def weights_version(version: str = "1") -> str:
    """Names the weights that scores were made with: any change of a value changes it."""
    import hashlib
    import json

    values = [WEIGHTS, PENALTIES, HALF_LIFE_HOURS, MAX_AGE_DAYS, MAX_AGE_DAYS_ACADEMIC, SATURATION, KEEP_THRESHOLD, PER_DAY, PER_LANE, PER_PUBLISHER, LARGE_DEAL_USD_M, EVENT_BOOSTS, LANE_TERMS]
    return f"{version}+{hashlib.sha256(json.dumps(values).encode()).hexdigest()[:8]}"
