"""Vocabularies, thresholds and dictionaries that results depend on."""

# Label vocabularies
PROGRAM_STATUSES = ("active", "dormant_suspected", "dead_confirmed", "approved", "superseded", "unknown")
KILL_REASONS = ("futility_efficacy", "toxicity_safety", "strategic_portfolio", "accrual_failure", "funding_insolvency", "competitive_landscape", "ip_legal", "unknown_silent")
CONFIDENCE_LEVELS = ("high", "medium", "low")
CONFIRMATION_EVIDENCE_TYPES = ("press_release", "sec_filing", "earnings_call", "pipeline_page_removal", "regulatory", "other")
IS_ADC_VALUES = ("yes", "no", "unsure")
IN_SCOPE_VALUES = ("yes", "no")
SCOPE_OUT_REASONS = ("heme_only", "pre_2012", "non_industry", "non_oncology", "not_an_adc")
GATE2_SCOPE_OUT_REASONS = SCOPE_OUT_REASONS[:4]

# Trial statuses
ACTIVE_LIKE = ("RECRUITING", "ACTIVE_NOT_RECRUITING", "ENROLLING_BY_INVITATION", "NOT_YET_RECRUITING")
TERMINAL_STOP = ("TERMINATED", "WITHDRAWN", "SUSPENDED")
ARCHETYPES = ("unknown_status", "registry_terminated_vague_reason", "registry_terminated_stated_reason", "completed_no_results", "actively_amended", "other")

# Silence score: weights sum to 100
STALENESS_WEIGHT, LAPSE_WEIGHT, AMBIGUITY_WEIGHT, ENROLLMENT_WEIGHT = 45, 8, 27, 20
STALENESS_TAU_DAYS, LAPSE_CAP_DAYS = 365.0, 365
MISSING_DATE_STALENESS, EXPLAINED_STOP_DISCOUNT = 0.5, 0.3
COMPLETED_STALE_DAYS, AMENDED_WINDOW_DAYS = 730, 400
BAND_WIDTH, BANDS = 20, 5
VAGUE_PHRASES = (
    "business reason", "business decision", "strategic reason", "study terminated", "sponsor decision",
    "no further information", "study discontinued", "terminated by sponsor", "administrative reason",
    "portfolio", "sponsor request", "study closed", "n/a", "unknown",
)
VAGUE_MIN, VAGUE_MAX = 15, 80

# Stated stop reasons: groups in order, the first with a phrase in the text wins
STATED_REASONS = {
    "toxicity_safety": ("safety", "toxicity", "adverse event", "adverse effect", "dose-limiting", "dose limiting", "tolerability", "died", "death", "fatal"),
    "futility_efficacy": ("futility", "lack of efficacy", "insufficient efficacy", "no clinical benefit", "did not meet", "failed to meet", "interim analysis", "efficacy", "did not demonstrate", "no significant difference"),
    "accrual_failure": ("enrollment", "enrolment", "accrual", "recruit", "slow recruitment"),
    "funding_insolvency": ("funding", "financial", "insolven", "bankrupt", "budget"),
    "competitive_landscape": ("competitive landscape", "competitor", "competing product", "market landscape"),
    "ip_legal": ("patent", "intellectual property", "litigation", "legal dispute"),
    "strategic_portfolio": ("business decision", "business reason", "strategic", "portfolio", "sponsor decision", "sponsor's decision", "pipeline priorit", "reprioriti", "program discontinuation", "no longer a priority"),
}

# Cost model
PHASE_WEIGHTS = {"PHASE1": 4.5, "PHASE2": 11.2, "PHASE3": 22.1, "PHASE4": 22.1}
SITE_EXPONENT = 0.5

# Forms of a development code, and what is taken off a name before it is compared with them
DEV_CODE = r"^[A-Za-z]{2,8}[-\s]?\d{2,6}[A-Za-z]{0,3}$"
FORMULATION = r"(?i)\s+for\s+(injection|infusion|intravenous\s+use)\s*$"

# Names of antibody-drug conjugates: suffix and payload class
SUFFIX_CHEMOTYPES = {
    "vedotin": "auristatin", "deruxtecan": "camptothecin_topo1", "govitecan": "camptothecin_topo1",
    "emtansine": "maytansinoid", "tesirine": "pbd_dimer", "mafodotin": "auristatin",
    "ozogamicin": "calicheamicin", "soravtansine": "maytansinoid", "ravtansine": "maytansinoid",
    "duocarmazine": "duocarmycin", "tirumotecan": "camptothecin_topo1", "rezetecan": "camptothecin_topo1",
    "rilsodotin": "other", "sesutecan": "camptothecin_topo1", "pamirtecan": "camptothecin_topo1",
}
LITERAL_TERMS = ("antibody-drug conjugate", "antibody drug conjugate", "immunoconjugate", "adc", "conjugate")
INTERVENTION_TYPES = ("DRUG", "BIOLOGICAL")
DENYLIST = (
    "placebo", "best supportive care", "pembrolizumab", "nivolumab", "ipilimumab", "atezolizumab", "durvalumab",
    "avelumab", "cemiplimab", "tremelimumab", "paclitaxel", "docetaxel", "nab-paclitaxel", "carboplatin",
    "cisplatin", "oxaliplatin", "gemcitabine", "doxorubicin", "cyclophosphamide", "capecitabine",
    "5-fluorouracil", "5-fu", "fluorouracil", "irinotecan", "etoposide", "vinorelbine", "eribulin", "olaparib",
    "niraparib", "rucaparib", "talazoparib", "bevacizumab", "ramucirumab", "trastuzumab", "pertuzumab",
    "rituximab", "cetuximab", "panitumumab", "letrozole", "anastrozole", "exemestane", "fulvestrant",
    "tamoxifen", "palbociclib", "ribociclib", "abemaciclib", "dexamethasone", "prednisone", "leucovorin",
    "folinic acid",
)

# Antibody stem and the target that it names. Targets resolved from names depend on them.
STEM_TARGETS = {
    "trastuzumab": "ERBB2", "pertuzumab": "ERBB2", "disitamab": "ERBB2", "zanidatamab": "ERBB2", "sacituzumab": "TACSTD2", "datopotamab": "TACSTD2",
    "enfortumab": "NECTIN4", "tisotumab": "F3", "mirvetuximab": "FOLR1", "rinatabart": "FOLR1", "inotuzumab": "CD22", "moxetumomab": "CD22",
    "pinatuzumab": "CD22", "gemtuzumab": "CD33", "vadastuximab": "CD33", "brentuximab": "TNFRSF8", "polatuzumab": "CD79B", "iladatuzumab": "CD79B",
    "loncastuximab": "CD19", "coltuximab": "CD19", "denintuzumab": "CD19", "vorsetuzumab": "CD70", "belantamab": "TNFRSF17", "naratuximab": "CD37",
    "indatuximab": "SDC1", "telisotuzumab": "MET", "patritumab": "ERBB3", "rovalpituzumab": "DLL3", "ladiratuzumab": "SLC39A6",
    "lifastuzumab": "SLC34A2", "upifitamab": "SLC34A2", "zilovertamab": "ROR1", "mecbotamab": "AXL", "vandortuzumab": "STEAP1",
    "glembatumumab": "GPNMB", "cofetuzumab": "PTK7", "praluzatamab": "ALCAM", "tusamitamab": "CEACAM5", "vobramitamab": "CD276",
}
# Target and the expressions that name it in a text.
TARGET_ALIASES = {
    "ERBB2": (r"her-?2(?:/neu)?", r"human epidermal growth factor receptor[- ]?2", r"\berbb2\b"),
    "ERBB3": (r"\bher-?3\b", r"\berbb3\b"), "TACSTD2": (r"\btrop-?2\b", r"\btacstd2\b"), "NECTIN4": (r"\bnectin-?4\b",),
    "F3": (r"\btissue factor\b",), "FOLR1": (r"folate receptor[- ]alpha", r"\bfr-?alpha\b", r"\bfolr1\b", "frα"),
    "CD22": (r"\bcd22\b",), "CD33": (r"\bcd33\b",), "TNFRSF8": (r"\bcd30\b",), "CD79B": (r"\bcd79b\b",),
    "CD19": (r"\bcd19\b",), "CD70": (r"\bcd70\b",), "KIT": (r"\bcd117\b", r"\bc-?kit\b"),
    "SDC1": (r"\bcd138\b", r"syndecan-?1"), "TNFRSF17": (r"\bbcma\b",), "CD37": (r"\bcd37\b",),
    "MET": (r"\bc-?met\b", r"\bmet receptor\b"), "DLL3": (r"\bdll3\b",), "MSLN": (r"\bmesothelin\b", r"\bmsln\b"),
    "CEACAM5": (r"\bceacam5\b", r"carcinoembryonic antigen"), "CD276": (r"\bb7-?h3\b", r"\bcd276\b"),
    "SLC39A6": (r"\bliv-?1\b", r"\bslc39a6\b"), "SLC34A2": (r"\bnapi2b\b", r"\bslc34a2\b"), "ROR1": (r"\bror1\b",),
    "AXL": (r"\baxl\b",), "STEAP1": (r"\bsteap1\b",), "STEAP2": (r"\bsteap2\b",), "GPNMB": (r"\bgpnmb\b",),
    "PTK7": (r"\bptk7\b",), "ITGB6": (r"integrin beta-?6", r"\bitgb6\b"), "ALCAM": (r"\bcd166\b", r"\balcam\b"),
    "GPA33": (r"\bgpa33\b", r"\ba33 antigen\b"), "CDH6": (r"\bcdh6\b",), "CDH17": (r"\bcdh17\b",),
    "FOLH1": (r"\bpsma\b", r"\bfolh1\b"),
    "CLDN18": (r"claudin[- ]?18\.2", r"\bcldn18\.2\b", r"\bcldn18\b", r"claudin\s*\(cldn\)\s*18(?:\.2)?"),
    "EGFR": (r"\begfr\b", r"epidermal growth factor receptor(?!s?[\s-]?2\b)"), "MUC16": (r"\bmuc16\b", r"\bmucin[- ]?16\b"),
    "MUC1": (r"\bmuc1\b",), "SLAMF7": (r"\bcd319\b", r"\bslamf7\b"), "CD46": (r"\bcd46\b",), "ADAM9": (r"\badam9\b",),
}

# Condition identifiers by category, and the solid ones by body system. Scopes and systems of trials depend on them.
HEME_IDS = (
    "D006402", "D006425", "D008206", "D007938", "D007945", "D007951", "D015470", "D008223", "D016393", "D008228", "D016403", "D054198", "D008232",
    "D007160", "D007154",
)
BASKET_IDS = ("D009369", "D009370", "D009371", "D009385", "D010335", "D013568", "D009362")
SYSTEM_IDS = {
    "breast": (
        "D001941", "D001943", "D064726",
    ),
    "gi_hepatobiliary": (
        "D001660", "D001661", "D006528", "D008107", "D008113", "D015179", "D003108", "D007410", "D007414", "D012002", "D005767", "D005770",
        "D004066", "D004067",
    ),
    "thoracic_lung": (
        "D002283", "D002289", "D001984", "D008171", "D008175", "D012140", "D012142", "D013899",
    ),
    "genitourinary": (
        "D002292", "D007674", "D007680", "D002295", "D000093284", "D001745", "D001749", "D014515", "D014516", "D014570", "D014571", "D000091642",
        "D014565", "D052801",
    ),
    "gynecologic": (
        "D005184", "D005185", "D000291", "D010049", "D010051", "D005831", "D005833", "D000091662", "D052776", "D005261", "D006058",
    ),
    "skin_ocular_melanoma": (
        "D000098943", "D014603", "D014604", "D005128", "D005134", "D008545", "D018326", "D012871", "D017437",
    ),
    "sarcoma_soft_tissue": (
        "D012509", "D009372", "D018204", "D018218", "D005354", "D051642", "D051677",
    ),
    "endocrine_neuroendocrine_germcell": (
        "D004701", "D004700", "D009375", "D009380", "D017599", "D018358", "D009373",
    ),
}
# Solid, but of no body system
SITELESS_SOLID_IDS = ("D002277", "D000230")
SYSTEM_KEYWORDS = {
    "breast": ("breast",),
    "gi_hepatobiliary": ("colorectal", "colon cancer", "colonic", "rectal", "gastric", "stomach", "esophageal", "oesophageal", "pancreatic", "hepatocellular", "liver cancer", "cholangiocarcinoma", "biliary", "gastrointestinal", "gastroesophageal"),
    "thoracic_lung": ("lung cancer", "nsclc", "sclc", "mesothelioma", "bronchogenic", "pulmonary"),
    "genitourinary": ("renal cell", "kidney cancer", "bladder", "urothelial", "prostate", "testicular", "penile"),
    "gynecologic": ("ovarian", "cervical", "endometrial", "uterine", "fallopian", "vulvar", "vaginal"),
    "skin_ocular_melanoma": ("melanoma", "uveal", "merkel cell", "cutaneous"),
    "sarcoma_soft_tissue": ("sarcoma", "gist", "soft tissue"),
    "endocrine_neuroendocrine_germcell": ("neuroendocrine", "thyroid cancer", "germ cell", "carcinoid", "adrenocortical"),
}

# Grounding of quotes
PAYLOAD_WORDS = ("exatecan", "mmae", "mmaf", "dxd", "sn-38", "sn38", "pbd", "calicheamicin", "auristatin", "maytansine", "maytansinoid", "camptothecin", "tubulysin", "duocarmycin", "amanitin", "eribulin", "immunoconjugate", "payload", "linker")
NO_ROUTE = r"(?i)\b(orally|oral|tablet|tablets|capsule|capsules|p\.?o\.?)\b"
NO_MODALITY = r"(?i)\b(monoclonal antibody|mabs?|bispecific|small[- ]molecule|inhibitors?|kinase|vaccine|car-t|cell therap|sirna|igg[1-4]|checkpoint|protac)\b"
CONJUGATE_WORDS = r"(?i)\b(adc|antibody[- ]drug|immunoconjugate|conjugate|payload|linker)\b"

# Deterministic triage
CLASS_LABEL = r"(?i)\b[A-Za-z][A-Za-z0-9\-]{1,20}[\s-]*ADC\b"
NON_CLASS_LABEL = r"(?i)^(?:anti[- ]?)?[A-Za-z][A-Za-z0-9\-/]*(?:[ /][A-Za-z0-9\-/]+)*\s+(?:monoclonal\s+antibody|mabs?|inhibitors?)$"
NON_ANTIBODY_CODES = ("bt5528",)
NON_ANTIBODY_PHRASES = (
    "bicycle toxin", "bicycle-toxin", "peptide-drug conjugate", "peptide drug conjugate", "small-molecule drug conjugate",
    "small molecule drug conjugate", "polymer conjugate", "polymer-drug conjugate", "sirna conjugate", "klh conjugate",
)
SCOPE_FLOOR, EXTENSION_FLOOR = "2012-01-01", "2000-01-01"
