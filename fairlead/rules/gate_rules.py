"""Fixed values of the relevance gate (thresholds, weights, lexicons, patterns)."""

THRESHOLDS = {
    "admit": 0.55,
    "reject": 0.22,
    "min_sufficiency_to_reject": 0.5,
    "hard_negative": 0.8,
}

SUFFICIENCY = {
    "full_text_chars": 1200,
    "title_only_chars": 120,
    "after_detail_fetch": 1.0,
}

GROUP_WEIGHTS = {"corpus": 0.7, "fit": 0.3}

SIGNAL_WEIGHTS = {
    "opportunity_type": 0.95,
    "funding": 0.7,
    "application": 0.5,
    "discipline": 0.6,
    "region": 0.5,
    "degree": 0.4,
}

FIELD_CONFIDENCE = {
    "title": 1.0,
    "url": 0.9,
    "summary": 0.85,
    "content": 0.75,
    "registry": 0.8,
}

FIELD_PRIORITY = ("title", "url", "summary", "content")

TYPE_LEXICON = {
    "scholarship": ["scholarship", "scholarships", "scholar award", "bursary", "bursaries", "tuition award"],
    "fellowship": ["fellowship", "fellowships", "fellow programme", "fellow program"],
    "grant": ["grant", "grants", "research grant", "travel grant", "seed funding", "funding call"],
    "internship": ["internship", "internships", "traineeship", "placement", "co-op program"],
    "phd": ["phd", "ph d", "doctoral", "doctorate", "doctoral position", "research position"],
    "graduate_program": [
        "masters programme", "masters program", "msc programme", "graduate program",
        "graduate programme", "postgraduate program",
    ],
    "competition": ["competition", "contest", "hackathon", "challenge", "prize", "award programme"],
    "conference": ["conference", "symposium", "summit", "convening"],
    "workshop": ["workshop", "summer school", "winter school", "training program", "bootcamp"],
    "exchange": ["exchange program", "exchange programme", "mobility program", "study abroad"],
}

FUNDING_LEXICON = [
    "fully funded", "full funding", "fully-funded", "partial funding", "tuition", "tuition waiver",
    "tuition fee", "stipend", "living allowance", "monthly allowance", "travel allowance", "covers",
    "award amount", "financial aid", "no application fee", "paid", "salary", "honorarium", "up to", "worth",
]

APPLICATION_LEXICON = [
    "deadline", "apply now", "how to apply", "application deadline", "applications open",
    "applications are open", "apply by", "closing date", "eligibility", "eligible", "requirements",
    "selection criteria", "submit your application", "application form", "closes on",
]

HARD_NEGATIVE = [
    "applications are closed", "application closed", "applications have closed", "no longer accepting",
    "winners announced", "results announced", "this opportunity has expired", "deadline has passed",
    "registration closed",
]

SOFT_NEGATIVE = [
    "privacy policy", "terms of service", "terms and conditions", "cookie policy", "about us",
    "contact us", "contact", "advertise with us", "advertise", "newsletter signup", "subscribe to our",
    "write for us", "sitemap", "log in", "sign up", "careers", "press room", "faq",
    "frequently asked questions",
]

GLOBAL_MARKERS = [
    "global", "worldwide", "international", "any country", "all nationalities", "all countries",
    "open to all", "anywhere",
]

SYNONYMS = {
    "tech": ["technology", "technical", "engineering", "it", "software", "computing"],
    "ai": ["artificial intelligence", "machine learning", "deep learning", "ml"],
    "artificial intelligence": ["ai", "machine learning", "deep learning"],
    "machine learning": ["ml", "ai", "artificial intelligence", "deep learning"],
    "data science": ["data analytics", "data engineering", "analytics", "big data"],
    "computer science": ["cs", "computing", "informatics", "software engineering"],
    "software engineering": ["software development", "programming", "software engineer"],
    "cybersecurity": ["cyber security", "information security", "infosec"],
    "robotics": ["mechatronics", "autonomous systems"],
    "biotechnology": ["biotech", "life sciences"],
    "environment": ["environmental", "sustainability", "climate", "green"],
    "public health": ["global health", "epidemiology", "health sciences"],
    "business": ["management", "entrepreneurship", "mba", "commerce"],
    "economics": ["econometrics", "development economics"],
    "msc": ["master", "masters", "ms", "graduate", "postgraduate"],
    "phd": ["doctoral", "doctorate", "ph d", "dphil"],
    "women": ["female", "women in", "gender", "girls"],
}

EDITORIAL_TITLE_PATTERNS = [
    r"^top\s+\d+",
    r"^best\s+\d+",
    r"\bultimate guide\b",
    r"\bcomplete guide\b",
    r"\beverything you need to know\b",
    r"\bfully funded\b.*\b(programs|programmes)\s+in\b",
    r"\b(master|masters|msc|ma|phd|doctoral)\s+(programs|programmes)\s+in\b",
    r"\b(programs|programmes)\s+in\s+[a-z]",
    r"\bquick apply scholarships\b",
    r"\beasy scholarships to apply\b",
    r"\bscholarships to apply for\b",
    r"\b\d+\s+(easy|quick|best|top)\s+scholarships\b",
    r"\bscholarships from\b",
    r"\bfellowships in \d{4} for\b",
    r"\bfor students professionals and\b",
    r"\btechnology policy fellowships in \d{4}\b",
    r"\btest page\b",
    r"\bsample test\b",
    r"\bpeople's reviews\b",
    r"\buser reviews\b",
    r"\bstudent reviews\b",
    r"\breviews of\b",
    r"\bwrite a review\b",
    r"\bhow i\b",
    r"\btips for\b",
]

EDITORIAL_URL_PATTERNS = [
    r"/reviews?/",
    r"quick-apply-scholarships",
    r"/scholarship-search",
    r"/scholarship-list",
    r"/blog/",
    r"/category/",
    r"/tag/",
    r"/advertise",
    r"/research/",
]

SINGLE_TITLE_HINTS = [
    r"\bscholarship\s+\d{4}\b",
    r"\bfellowship\s+\d{4}\b",
    r"\b(up to|worth)\s+[\$€£]",
    r"\bapply (now|by|before)\b",
    r"\bdeadline\b",
    r"\b(project|program|programme|initiative)\s+\d{4}\b",
    r"\b\w+\s+award\b",
    r"\b\w+\s+scholarship\b",
    r"\b\w+\s+fellowship\b",
]

# A title holding ROUNDUP_PLURAL and any of ROUNDUP_VETOES is not a single listing.
ROUNDUP_PLURAL = r"\b(scholarships|fellowships|programs|programmes)\b"
ROUNDUP_VETOES = [
    r"^(top|best)\s+\d+",
    r"\b(programs|programmes)\s+in\b",
    r"\b\d+\s+(easy|quick|best|top)\s+scholarships\b",
]

AMOUNT_PATTERN = (
    r"(?i)(?:(?:us\$|\$|€|£|usd|eur|gbp|inr|chf|cad|aud)\s?\d[\d,.]*\d"
    r"|\d[\d,.]*\d\s?(?:usd|eur|gbp|dollars?|euros?))"
)

DEGREE_HINTS = ["msc", "master", "masters", "phd", "doctoral", "bachelor", "undergraduate", "postgraduate"]

DRAFT_TITLES = ["test page", "sample test"]

INVESTIGATION_BUDGET = 40
MAX_ITEMS_PER_SOURCE = 40
MAX_PENDING = 50

# What normalisation keeps besides letters and digits.
KEPT_MARKS = "_$€£%.,/+-"
