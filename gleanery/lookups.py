"""Word lists, score tables, patterns and limits.

Every entry below is a value the results depend on, so it is stated as plain
text and kept apart from the logic that reads it.
"""

from __future__ import annotations

# --- Fixed values: title entities ------------------------------------------------

GEO_ENTITIES = [
    "malaysia", "singapore", "indonesia", "thailand", "philippines", "vietnam",
    "china", "japan", "korea", "india", "pakistan", "bangladesh", "sri lanka",
    "usa", "united states", "us", "uk", "united kingdom", "canada", "australia",
    "germany", "france", "italy", "spain", "netherlands", "sweden", "norway",
    "brazil", "mexico", "argentina", "colombia", "chile", "peru",
    "egypt", "south africa", "nigeria", "kenya", "ethiopia", "ghana",
    "saudi arabia", "uae", "qatar", "kuwait", "oman", "bahrain",
    "turkey", "iran", "iraq", "israel", "jordan", "lebanon",
    "russia", "ukraine", "poland", "czech", "hungary", "romania",
    "taiwan", "hong kong", "macau",
    "urban", "rural", "suburban", "metropolitan",
    "asian", "african", "european", "american", "middle eastern",
    "tropical", "temperate",
]

METHOD_ENTITIES = [
    "phase i", "phase 1", "phase ii", "phase 2", "phase iii", "phase 3",
    "phase iv", "phase 4", "pilot", "feasibility",
    "rct", "randomized controlled trial", "randomised controlled trial",
    "cohort", "prospective", "retrospective", "cross sectional",
    "case control", "longitudinal",
    "meta analysis", "systematic review",
    "network meta analysis", "umbrella review",
    "case series", "case report", "case study",
    "open label", "double blind",
    "single blind", "sham controlled",
    "treatment", "intervention", "therapy",
    "placebo", "vehicle", "active comparator",
]

DIAGNOSTIC_ENTITIES = [
    "glaucoma", "cataract", "cataracts", "macular degeneration", "amd",
    "diabetic retinopathy", "retinal detachment", "retinal vein occlusion",
    "keratoconus", "dry eye", "dry eye disease", "blepharitis",
    "conjunctivitis", "uveitis", "iritis", "episcleritis", "scleritis",
    "strabismus", "amblyopia", "ptosis", "chalazion", "hordeolum",
    "corneal ulcer", "corneal erosion", "fuchs dystrophy",
    "keratitis", "endophthalmitis", "vitrectomy", "retinopathy",
    "presbyopia", "myopia", "hyperopia", "astigmatism",
    "optic neuritis", "optic neuropathy", "papilledema",
    "nystagmus", "color vision deficiency", "visual field defect",
    "diabetes", "diabetes mellitus", "type 1 diabetes", "type 2 diabetes",
    "hypertension", "hypotension", "obesity", "bmi",
    "alzheimer", "alzheimer disease", "parkinson", "parkinson disease",
    "stroke", "myocardial infarction", "heart failure",
    "asthma", "copd", "pneumonia", "bronchitis",
    "arthritis", "rheumatoid arthritis", "osteoarthritis",
    "depression", "anxiety", "bipolar", "schizophrenia",
    "epilepsy", "seizure", "migraine", "headache",
    "chronic pain", "fibromyalgia", "neuropathy",
    "anemia", "leukemia", "lymphoma", "melanoma",
    "pregnancy", "gestational", "prenatal", "postpartum",
    "pediatric", "neonatal", "geriatric", "elderly",
    "laser", "photocoagulation", "cryotherapy", "cryopexy",
    "intravitreal", "subconjunctival", "topical", "systemic",
    "surgical", "phacoemulsification", "trabeculectomy",
    "implant", "injection", "drops", "ointment",
    "photodynamic therapy", "radiation therapy", "chemotherapy",
]

PHASE_PATTERN = r"phase\s*(i{1,4}v?|1|2|3|4)"

# --- Fixed values: similarity thresholds -----------------------------------------

MERGE_SIMILARITY = 0.92
GREY_SIMILARITY = 0.85
HIERARCHY_SIMILARITY = 0.90

# --- Fixed values: evidence tiers ------------------------------------------------

PUBLISHER_TYPE_TIERS = {
    "journal-article": 5,
    "review-article": 5,
    "meta-analysis": 2,
    "systematic-review": 1,
    "research-article": 5,
    "randomized-controlled-trial": 3,
    "clinical-trial": 3,
    "controlled-clinical-trial": 3,
    "cohort-study": 4,
    "observational-study": 4,
    "case-control-study": 4,
    "case-series": 5,
    "case-report": 5,
    "report": 6,
    "standard": 6,
    "guideline": 6,
    "dataset": 6,
    "proceedings-article": 6,
    "posted-content": 6,
}

PUBLISHER_TYPE_GREY = {"guideline": 1, "standard": 1, "report": 3}

INDEX_TYPE_TIERS = {
    "Systematic Review": 1,
    "Meta-Analysis": 2,
    "Randomized Controlled Trial": 3,
    "Controlled Clinical Trial": 3,
    "Clinical Trial": 3,
    "Multicenter Study": 3,
    "Pragmatic Clinical Trial": 3,
    "Observational Study": 4,
    "Cohort Study": 4,
    "Case-Control Studies": 4,
    "Cross-Sectional Studies": 4,
    "Case Reports": 5,
    "Review": 5,
    "Journal Article": 5,
    "Guideline": 6,
    "Practice Guideline": 6,
    "Consensus Development Conference": 6,
}

# grey type -> (grey tier, confidence)
INDEX_TYPE_GREY = {
    "Guideline": (1, 0.85),
    "Practice Guideline": (1, 0.85),
    "Consensus Development Conference": (1, 0.85),
    "Technical Report": (2, 0.7),
    "Government Publication": (3, 0.8),
    "Directory": (6, 0.4),
    "Legislation": (6, 0.4),
    " laws & legislation": (6, 0.4),
}

# ordered: the first pattern that matches decides
GREY_TEXT_PATTERNS = [
    (r"clinical\s+(practice\s+)?guideline", 1),
    (r"preferred\s+practice\s+pattern", 1),
    (r"evidence[- ]based\s+guideline", 1),
    (r"management\s+of.*guideline", 1),
    (r"consensus\s+(statement|guideline|recommendation)", 1),
    (r"national\s+guideline", 1),
    (r"tfos\s+dews", 1),
    (r"tear\s+film\s+and\s+ocular\s+surface\s+society", 1),
    (r"dry\s+eye\s+(workshop|guideline|report|consensus)", 1),
    (r"aao\s+(preferred\s+practice|guideline)", 1),
    (r"international\s+dry\s+eye\s+", 1),
    (r"technical\s+standard", 2),
    (r"international\s+standard", 2),
    (r"specification\s+for", 2),
    (r"test\s+method", 2),
    (r"ministry\s+of\s+health", 3),
    (r"government\s+(policy|circular|directive)", 3),
    (r"national\s+(health|eye)\s+(policy|program)", 3),
    (r"standard\s+operating\s+procedure", 4),
    (r"sop\s+for", 4),
    (r"protocol\s+for", 4),
    (r"training\s+(module|manual|handbook)", 4),
]

INSTITUTIONS = [
    "ministry of health", "department of health", "world health organization", "who", "nice",
    "national institute", "centers for disease control", "cdc", "food and drug administration", "fda",
    "american academy of ophthalmology", "aao", "royal australian", "ranzco", "college of optometrists",
    "optometric association", "optical council", "joint technical committee", "british standards",
    "iso", "ansi", "institution of engineers", "national health service", "nhs",
    "tear film and ocular surface society", "tfos", "international dry eye workshop", "dews",
    "ocular surface", "asia-pacific academy of ophthalmology", "apiaao",
    "european society of cataract and refractive surgeons", "escrs",
]

TIER_LABELS = {
    1: "Systematic Review",
    2: "Meta-Analysis",
    3: "Randomized Controlled Trial",
    4: "Controlled Observational",
    5: "Case Series / Report",
    6: "Unclassified",
}
GREY_LABELS = {
    1: "Clinical Guideline",
    2: "Technical Standard",
    3: "Government Policy",
    4: "Institutional Protocol",
    5: "Thesis / Dissertation",
    6: "Grey Literature",
}
TIER_QUALITY = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.6, 5: 0.3, 6: 0.1}

# --- Fixed values: ranking -------------------------------------------------------

DIMENSIONS = [
    "relevance",
    "semantic_similarity",
    "keyword_match",
    "peer_review",
    "study_design",
    "citation_impact",
    "journal_quality",
    "recency",
    "oa_availability",
]

# one row per preset, in the order of DIMENSIONS
MODE_WEIGHTS = {
    mode: dict(zip(DIMENSIONS, values))
    for mode, values in {
        "discovery": (0.25, 0.20, 0.15, 0.05, 0.05, 0.10, 0.10, 0.10, 0.00),
        "evidence": (0.20, 0.15, 0.10, 0.15, 0.15, 0.10, 0.10, 0.05, 0.00),
        "clinical": (0.10, 0.10, 0.05, 0.20, 0.20, 0.10, 0.10, 0.10, 0.05),
        "systematic_review": (0.15, 0.10, 0.15, 0.15, 0.15, 0.10, 0.10, 0.10, 0.00),
        "thesis": (0.25, 0.20, 0.15, 0.10, 0.05, 0.10, 0.10, 0.05, 0.00),
        "manuscript": (0.30, 0.25, 0.15, 0.05, 0.05, 0.10, 0.05, 0.05, 0.00),
        "citation_verification": (0.15, 0.10, 0.10, 0.15, 0.10, 0.20, 0.10, 0.05, 0.05),
        "adversarial": (0.20, 0.15, 0.15, 0.15, 0.15, 0.10, 0.05, 0.05, 0.00),
        "bibliometric": (0.15, 0.10, 0.10, 0.05, 0.05, 0.20, 0.20, 0.15, 0.00),
        "openness": (0.15, 0.10, 0.10, 0.05, 0.05, 0.05, 0.05, 0.10, 0.35),
        "dry_eye": (0.20, 0.15, 0.15, 0.10, 0.15, 0.10, 0.10, 0.05, 0.00),
    }.items()
}

# ordered: the first name that contains, or is contained in, the journal decides
JOURNAL_SCORES = [
    ("ocular surface", 1.0),
    ("investigative ophthalmology & visual science", 0.95),
    ("iovs", 0.95),
    ("american journal of ophthalmology", 0.95),
    ("ophthalmology", 0.95),
    ("jama ophthalmology", 0.9),
    ("british journal of ophthalmology", 0.9),
    ("cornea", 0.9),
    ("eye", 0.85),
    ("survey of ophthalmology", 0.85),
    ("progress in retinal and eye research", 0.85),
    ("clinical & experimental ophthalmology", 0.8),
    ("canadian journal of ophthalmology", 0.75),
    ("journal of cataract and refractive surgery", 0.75),
    ("journal of refractive surgery", 0.7),
    ("optometry and vision science", 0.7),
    ("vision research", 0.7),
    ("current eye research", 0.7),
    ("lancet", 0.6),
    ("new england journal of medicine", 0.6),
    ("bmj", 0.5),
    ("plos one", 0.5),
    ("scientific reports", 0.45),
]

DESIGN_SCORES = {
    "systematic_review": 1.0,
    "meta_analysis": 1.0,
    "rct": 0.9,
    "cohort": 0.7,
    "case_control": 0.6,
    "cross_sectional": 0.5,
    "case_report": 0.3,
    "review": 0.4,
    "editorial": 0.2,
    "letter": 0.1,
    "commentary": 0.2,
    "preprint": 0.3,
    "unknown": 0.2,
}

GEO_SCORES = {
    "MY": 1.0,
    "SG": 1.0,
    "TH": 1.0,
    "ID": 1.0,
    "PH": 1.0,
    "VN": 1.0,
    "BN": 1.0,
    "MM": 1.0,
    "KH": 1.0,
    "LA": 1.0,
    "JP": 0.7,
    "KR": 0.7,
    "TW": 0.7,
    "CN": 0.7,
    "IN": 0.7,
    "GB": 0.4,
    "US": 0.4,
    "AU": 0.4,
    "NZ": 0.4,
    "CA": 0.4,
}
GEO_DEFAULT = 0.3

OPENNESS_POINTS = {"is_oa": 0.35, "has_code": 0.25, "has_dataset": 0.20, "has_open_license": 0.10, "has_full_text": 0.10}
PREDATORY_MULTIPLIER = -2.0
PREDATORY_CONFIDENCE = 0.70

RETRACTION_FACTORS = {"retraction": 0.01, "expression_of_concern": 0.3, "correction": 0.9}

# factors fed by each source; they are frozen out when the source is degraded
SOURCE_FACTORS = {
    "semantic_scholar": ["citation_impact", "semantic_similarity"],
    "openalex": ["citation_impact", "journal_quality", "keyword_match"],
    "crossref": ["citation_impact", "journal_quality"],
    "pubmed": ["keyword_match", "relevance"],
}
# facts missing from a record when the source is degraded
SOURCE_FACTS = {
    "semantic_scholar": ["s2_citations", "s2_embeddings", "s2_influential"],
    "openalex": ["oa_concepts", "oa_institutions", "oa_citations"],
    "crossref": ["cr_references", "cr_license"],
    "pubmed": ["pm_mesh", "pm_abstract"],
}

# --- Fixed values: geographic equity ---------------------------------------------

EQUITY_REGIONS = [
    "MY", "SG", "ID", "TH", "PH", "VN", "MM", "KH", "LA", "BN", "CN", "TW", "HK",
    "IN", "PK", "BD", "LK", "NP", "EG", "NG", "KE", "ZA", "BR", "MX", "CO", "AR",
]
REGIONAL_REGISTRIES = ["ChiCTR", "IRCT", "CTRI", "JPRN", "ReBEC", "ACTRN", "CTR"]
EQUITY_DIVISORS = {"citation_impact": 0.3, "journal_quality": 0.2}
EQUITY_BOOSTS = {"keyword_match": 1.3, "recency": 1.2, "open_access": 1.1}

# --- Fixed values: trial registries ----------------------------------------------
# (registry, search pattern, ignore case, pattern a raw match must fit to be sure)

TRIAL_REGISTRIES = [
    ("NCT", r"\b(NCT\d{8})\b", True, r"^NCT\d{8}$"),
    ("ISRCTN", r"\b(ISRCTN[A-Z0-9]{8})\b", True, r"^ISRCTN[A-Za-z0-9]{8}$"),
    ("ACTRN", r"\b(ACTRN\d{14})\b", True, r"^ACTRN\d{14}$"),
    ("EUCTR", r"\b(EUCTR[\d-]{6,20})\b", False, r"^EUCTR\d{4}-\d{3,8}-\d{2}$"),
    ("ChiCTR", r"\b(ChiCTR\d{6,8})\b", True, r"^ChiCTR\d{6,8}$"),
    ("IRCT", r"\b(IRCT[\dA-Z]{8,})\b", True, r"^(?i:IRCT)[\dA-Z]{8,}$"),
    ("JPRN", r"\b(JPRN-[A-Z]{2,4}\d{4,})\b", True, None),
    ("CTRI", r"\b(CTRI/\d{4}/\d{2,6})\b", True, None),
    ("ReBEC", r"\b(RBR-[A-Z0-9]{6,})\b", True, None),
]

# --- Fixed values: protocol check ------------------------------------------------

PROTOCOL_KEYWORDS = {
    "inclusion criteria": ["inclusion criterion", "eligibility criteria", "eligibility criterion", "inclusion and exclusion"],
    "exclusion criteria": ["exclusion criterion", "exclusion criteria"],
    "search strategy": ["search strategy", "search method", "search approach", "literature search", "database search", "search methodology"],
    "data extraction": ["data extraction", "data collection", "data coding", "data abstraction"],
    "quality assessment": ["quality assessment", "quality appraisal", "risk of bias", "risk-of-bias", "methodological quality", "quality evaluation"],
}
PROTOCOL_DATABASES = {
    "PubMed": r"\b(pubmed|medline|medline/pubmed|pubmed/medline|medline via|via medline|via pubmed|e-utilities|entrez)\b",
    "Scopus": r"\b(scopus|elsevier scopus|scopus database|scopus search|scopus api)\b",
}
APEX_SOURCES = ["pubmed", "scopus"]

# --- Fixed values: text cleaning -------------------------------------------------
# ordered (pattern, replacement)

SANITIZE_STEPS = [
    (r"<[^>]*>", ""),
    (r"(?s)```.*?```", ""),
    (r"`[^`]*`", ""),
    (r"\*\*[^*]*\*\*", ""),
    (r"\*[^*]*\*", ""),
    (r"(?m)^#{1,6}\s+", ""),
    (r'\{[^}]*"role"\s*:', ""),
    (r'\[[^\]]*\{[^}]*"content"\s*:', ""),
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]{2,}", " "),
]
INJECTION_PATTERN = (
    r"(?i)act\s+as|ignore\s+(previous|all|above|system)|disregard|forget\s+(previous|all|above|your)"
    r"|you\s+are\s+now|override\s+instructions|new\s+instructions|system\s+prompt\s+override"
)

DOMAIN_KEYWORDS = [
    "dry eye", "dry eye disease", "dry eye syndrome", "keratoconjunctivitis sicca", "meibomian gland", "mgd",
    "tear film", "nibut", "tbut", "osmolarity", "artificial tears", "cyclosporine ophthalmic", "lifitegrast",
    "punctal plug", "ocular surface", "osdi", "ded", "des", "sicca", "sjogren", "night driving",
    "visual performance", "tear break-up", "corneal staining",
]
DOMAIN_PHRASES = [
    "dry eye disease", "dry eye syndrome", "dry eye", "tear film instability", "tear film break-up time", "tear film",
    "visual function", "functional visual acuity", "night driving difficulty", "night driving",
    "self-esteem", "quality of life", "vision-related quality of life", "osmolarity", "keratoconjunctivitis sicca",
    "meibomian gland dysfunction", "meibomian gland", "artificial tears", "punctal plug", "corneal staining",
    "ocular surface disease index", "dry eye questionnaire", "foreign body sensation", "burning sensation",
    "visual fluctuation", "glare sensitivity", "tear meniscus height", "non-invasive tear break-up time",
]

PROXIMITY_PATTERN = (
    r'(?i)\b(NEAR|NEXT|ONEAR|ADJ|SAME|AROUND)\s*/?\s*\d*|(\bW/\d+)|(\bPRE/\d+)|"\s*[^"]+"\s*~\s*\d+|:\s*~\s*\d+|~\d+'
)
#: A term that is a proximity formulation: the operator stands between two terms, or its brackets hold several.
PROXIMITY_TERM_PATTERN = (
    r"(?i)\S +((NEAR|NEXT|ONEAR|ADJ|SAME|AROUND)[ /(]*\d*\)?|(W|PRE)/\d+) +\S|\bO?NEAR(/\d+)? *\([^)]* "
)
FIELD_PATTERN = (
    r"(?i)(TITLE-ABS-KEY|TITLE|ABS|SUBJAREA|DOCTYPE|\[[a-z]{1,6}(:~\d+)?\]|\.(ti|ab|kf|mp)\b"
    r'|\b(TS|TI|AU|SO|DO|PMID)=|DE\s*=|[a-z_.]+\s*:\s*["\w])'
)
MESH_PATTERN = r"(?i)(\[mesh(:noexp)?\]|\[majr\]|\[sh\]|\bexp\s+\S+/|\*\S+/)"

# --- Fixed values: record schema -------------------------------------------------

PUBLICATION_TYPES = [
    "journal_article", "review", "systematic_review", "meta_analysis", "rct", "cohort", "case_control", "cross_sectional",
    "case_report", "conference_paper", "thesis", "book_chapter", "book", "technical_report", "preprint", "dataset",
    "editorial", "letter", "commentary", "protocol", "correction", "retraction", "expression_of_concern",
]
YEAR_RANGE = (1900, 2100)

# --- Fixed values: correction ledger ---------------------------------------------

LEDGER_STATES = ["DISCOVERED", "FETCHED", "DIFFED", "APPROVED", "PATCHED"]
LEDGER_STEPS = list(zip(LEDGER_STATES, LEDGER_STATES[1:]))
APPROVED_MARKS = ["1", "true", "yes", "TRUE", "Yes"]

# --- Fixed values: quotas --------------------------------------------------------
# name, max MB, max pages, per minute, per day, concurrent, monthly cost limit

QUOTA_TIERS = [
    ("free", 10, 10, 5, 50, 1, 0.0),
    ("pro", 50, 100, 30, 1000, 3, 50.0),
    ("enterprise", 200, 500, 100, 10000, 10, 500.0),
]
PRICE_PER_GB_SECOND = 0.0000166667
PRICE_PER_REQUEST = 0.0000000021
MONTHLY_BUDGET = 1000.0
THROTTLE_SHARE = 0.80
STOP_SHARE = 0.95

# --- Fixed values: limits --------------------------------------------------------

SUPERSET_LIMIT = 2000
MAX_RESULTS = 500
PAGE_SIZE = 10
MAX_PAGES = 500
REPLAY_EVENTS = 200
MAX_FAILURES = 2
TERMINAL_JOB_STATES = ["completed", "failed", "cancelled"]
MAX_SHAPES = 20
LIST_ITEM_PATTERN = r"^\s*[-•●○■▶]\s+|^\s*\d+[.)]\s+|^\s*[a-zA-Z][.)]\s+"
FEEDBACK_RATINGS = ["good", "bad", "partial"]

# --- Own sample list (same shape as a real one, own content) ----------------------

PREDATORY_SAMPLE = [
    # kind, pattern, confidence
    ("host", "www.predatory-*", 0.9),
    ("host", "10.1003", 0.8),
    ("host", "site7.example.org", 0.75),
    ("publisher", "sample bad press", 0.95),
    ("publisher", "plain publisher", 0.4),
    ("issn", "1234-5678", 0.85),
]
