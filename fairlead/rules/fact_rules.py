"""Fixed values of fact extraction, scoring, trust and profile compilation."""

FULL_FUNDING_PHRASES = [
    "fully funded", "full funding", "fully-funded", "full scholarship", "tuition waiver", "tuition and living",
    "covers tuition", "all expenses paid", "all-expenses-paid", "free of charge",
]
PARTIAL_FUNDING_PHRASES = [
    "partial funding", "partial scholarship", "partially funded", "tuition support", "contribution towards",
    "travel grant",
]
SELF_FUNDING_PHRASES = [
    "self-funded", "self funded", "participants must cover", "at your own cost", "unpaid", "voluntary basis",
    "volunteer position",
]
STIPEND_PHRASES = ["stipend", "monthly allowance", "salary", "paid position", "honorarium", "remuneration"]

DEGREE_NEEDLES = {
    "phd": ["phd", "ph.d", "doctoral", "doctorate", "postdoc", "post-doctoral"],
    "master": ["master", "masters", "master's", "msc", "m.sc", "graduate programme", "graduate program"],
    "undergraduate": ["undergraduate", "bachelor", "bachelor's", "bsc", "b.sc", "college student"],
    "high_school": ["high school", "secondary school", "sixth form"],
}

REGION_NEEDLES = {
    "Global": ["worldwide", "globally", "any country", "all nationalities", "international applicants", "global"],
    "Africa": ["africa", "african", "nigeria", "kenya", "ghana", "ethiopia", "south africa", "uganda"],
    "Asia": ["asia", "asian", "india", "nepal", "bangladesh", "pakistan", "japan", "china", "singapore"],
    "Europe": ["europe", "european", "germany", "france", "netherlands", "sweden", "italy", "spain", "poland"],
    "North America": ["united states", "usa", "u.s.", "canada", "american"],
    "United Kingdom": ["united kingdom", "uk ", "britain", "british", "england", "scotland"],
    "Latin America": ["latin america", "brazil", "mexico", "argentina", "colombia", "chile"],
    "Middle East": ["middle east", "uae", "qatar", "saudi", "jordan", "lebanon", "syria", "syrian"],
    "Oceania": ["australia", "new zealand"],
}

THEME_NEEDLES = {
    "technology": ["software", "engineering", "digital", "technology", "computing", "programming", "developer"],
    "artificial intelligence": [
        "artificial intelligence", " ai ", "machine learning", "deep learning", "nlp", "data science",
    ],
    "research": ["research", "thesis", "dissertation", "publication", "laboratory", "academic"],
    "media": ["journalism", "media", "reporting", "storytelling", "communications", "broadcast"],
    "climate": ["climate", "environment", "sustainability", "renewable", "green", "conservation"],
    "health": ["health", "medical", "public health", "clinical", "medicine", "nursing"],
    "entrepreneurship": ["startup", "entrepreneur", "venture", "innovation", "business", "incubator"],
    "policy": ["policy", "governance", "diplomacy", "public administration", "development"],
    "human rights": ["human rights", "conflict", "peacebuilding", "humanitarian", "refugee", "advocacy"],
    "education": ["education", "teaching", "curriculum", "learning", "training", "mentorship"],
    "leadership": ["leadership", "ambassador", "fellowship programme", "leadership development"],
    "arts": ["arts", "creative", "design", "film", "music", "culture"],
}

FORMAT_NEEDLES = {
    "fellowship": ["fellowship", "fellow "],
    "scholarship": ["scholarship", "bursary", "studentship"],
    "internship": ["internship", "intern "],
    "bootcamp": ["bootcamp", "boot camp"],
    "competition": ["competition", "challenge", "hackathon"],
    "ambassador programme": ["ambassador programme", "ambassador program"],
    "exchange programme": ["exchange program", "cultural exchange"],
    "conference": ["conference", "summit", "symposium"],
    "grant": ["grant", "award", "prize"],
}

REMOTE_PHRASES = [
    "fully remote", "work remotely", "remote position", "remote role", "remote work", "virtual programme",
    "virtual program", "work from home", "remotely from",
]
ONSITE_PHRASES = ["on-site", "onsite", "in person", "in-person", "relocate"]

ROLLING_HINTS = ["rolling", "ongoing", "continuous", "no deadline", "open until filled"]
UNKNOWN_HINTS = ["unspecified", "not specified", "tbd", "to be announced", "varies", "n/a"]

DEADLINE_LINE = (
    r"(?i)(?:application\s+)?(?:deadline|closing\s+date|apply\s+by|applications?\s+close)"
    r"\s*(?:is|on|:|\-|–)\s*([^\n\r.;]{2,60})"
)
MONTHS = (
    "january|february|march|april|may|june|july|august|september|october|november|december"
    "|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
)
INLINE_DATE = rf"(?i)\b(?:\d{{1,2}}\s+)?(?:{MONTHS})\.?(?:\s+\d{{1,2}}(?:st|nd|rd|th)?)?,?\s*20\d{{2}}\b"
ISO_DATE = r"\b20\d{2}-\d{2}-\d{2}\b"
MONEY = r"(?i)(?:us)?\$\s?[\d,]{3,12}|€\s?[\d,]{3,12}|£\s?[\d,]{3,12}"

DEADLINE_CUES = [
    r"(?i)deadline[:\s]+([^\n\.]+)",
    r"(?i)due[:\s]+([^\n\.]+)",
    r"(?i)apply by[:\s]+([^\n\.]+)",
    r"(?i)closes?[:\s]+([^\n\.]+)",
]
PAGE_DEADLINE_CUES = [
    r"(?i)deadline[:\s]+([^<\n\.]+)",
    r"(?i)apply by[:\s]+([^<\n\.]+)",
]

TYPE_KEYWORDS = {
    "scholarship": ["scholarship", "stipend", "tuition"],
    "fellowship": ["fellowship", "fellow"],
    "internship": ["internship", "intern "],
    "graduate_program": ["graduate program", "master", "msc", "m.sc"],
    "phd": ["phd", "doctoral", "doctorate"],
    "grant": ["grant", "funding"],
    "conference": ["conference", "symposium"],
    "workshop": ["workshop", "summer school"],
    "competition": ["competition", "hackathon", "challenge"],
}

REQUIREMENT_KEYWORDS = [
    "motivation letter", "recommendation", "transcript", "cv", "resume", "english proficiency",
    "statement of purpose", "portfolio",
]

EXTRACT_FULL = ["fully funded", "full scholarship", "full tuition", "full stipend"]
EXTRACT_PARTIAL = ["partial", "tuition waiver"]
EXTRACT_SELF = ["self-funded", "self funded"]

DEGREE_LABELS = [
    ("phd", "PhD"), ("doctoral", "PhD"), ("master", "MSc"), ("msc", "MSc"), ("undergraduate", "Undergraduate"),
    ("bachelor", "Undergraduate"), ("fellowship", "Fellowship"), ("internship", "Internship"),
]

# Degree levels by token, tried in this order.
DEGREE_TOKENS = {
    "high_school": ["high school", "secondary", "k-12", "k12"],
    "undergraduate": ["undergraduate", "bachelor", "bsc", "bs", "ba", "undergrad"],
    "master": ["master", "masters", "msc", "ms", "m.sc", "ma", "meng"],
    "phd": ["phd", "ph.d", "doctoral", "doctorate", "postdoc", "postdoctoral"],
}

CITIZENSHIP = [
    ("us_citizens_only", r"(?i)\bus\s+citizen[s]?\s+only\b", "Listing restricted to US citizens"),
    ("eu_citizens_only", r"(?i)\beu\s+citizen[s]?\s+only\b", "Listing restricted to EU citizens"),
    ("uk_citizens_only", r"(?i)\buk\s+citizen[s]?\s+only\b", "Listing restricted to UK citizens"),
    ("domestic_only", r"(?i)\bdomestic\s+student[s]?\s+only\b", "Domestic students only"),
]
US_NATIONALITIES = ["united states", "usa", "us", "u.s."]
EU_HINTS = ["germany", "france", "italy", "spain", "netherlands", "poland", "europe"]

DEGREE_NAMES = {
    "master": "Master's", "phd": "PhD", "undergraduate": "undergraduate", "high_school": "high-school",
}

STOPWORDS = [
    "the", "and", "for", "with", "you", "your", "are", "was", "were", "this", "that",
    "from", "have", "has", "had", "will", "can", "all", "any", "our", "their", "its",
    "who", "which", "what", "when", "where", "how", "not", "but", "out", "off", "than",
    "then", "them", "they", "she", "his", "her", "him", "one", "two", "new", "also",
    "more", "most", "other", "such", "into", "over", "under", "about", "after", "before",
    "open", "applications", "opportunity", "programme", "program", "apply", "applicants",
]

STATUS_SIGNAL = {
    "new": 0.5, "saved": 0.72, "in_progress": 0.88, "applied": 0.92, "archived": 0.25, "dismissed": 0.15,
}

COMPONENT_WEIGHTS = {"semantic": 0.45, "eligibility": 0.30, "urgency": 0.15, "affinity": 0.10}
STRONG_FIT = 0.62
MODERATE_FIT = 0.42
NEUTRAL_REASON = "Not enough information to explain this match"
RANKING_DEFAULTS = {"university": 0.2, "region": 0.1, "interest": 0.15, "language": 0.08}

COSINE_BANDS = {
    "default": (0.15, 0.55), "openai": (0.15, 0.55), "gemini": (0.50, 0.88), "fastembed": (0.42, 0.75),
}

TRUST_LABELS = {
    "verified": "Confirmed at source",
    "aggregator_only": "Aggregator only",
    "unchecked": "Not checked yet",
    "conflict": "Details differ",
}
TRUST_HINTS = {
    "verified": "We matched this listing against the official source page.",
    "aggregator_only": "Listed on an aggregator. We did not confirm it on an official page.",
    "unchecked": "We have not checked this against an official source yet.",
    "conflict": "The official page disagrees with the aggregator listing on key details.",
}

VERIFY_FUNDING = [
    ("self", ["self-funded", "self funded", "unfunded", "no funding", "not funded"]),
    ("partial", ["partial", "partially funded", "co-funded", "tuition only"]),
    ("full", [
        "fully funded", "fully-funded", "full funding", "full scholarship", "all expenses", "covers all", "full",
    ]),
]

INSTITUTIONAL_TOKENS = [".edu", ".ac.uk", ".ac.jp", ".ac.nz", ".ac.za", ".gov", ".gov.uk", ".gouv."]

NON_PRIMARY_DOMAINS = [
    "opportunitydesk.org", "opportunitiescorners.com", "opportunitiesforafricans.com",
    "opportunitiesforyouth.org", "profellow.com", "scholarshiptab.com", "scholarships.com",
    "scholarshiproar.com", "youthop.com", "youthopportunities.org", "globalsouthopportunities.com",
    "careerflora.com", "linkedin.com", "facebook.com", "twitter.com", "x.com", "instagram.com",
    "youtube.com", "reddit.com", "medium.com", "wikipedia.org", "t.me", "pinterest.com",
]

ORG_STOPWORDS = [
    "the", "of", "and", "for", "in", "at", "a", "an", "to", "on",
    "program", "programme", "programs", "fellowship", "fellowships",
    "scholarship", "scholarships", "grant", "grants", "award", "awards",
    "opportunity", "opportunities", "international", "students", "student",
    "apply", "application", "applications", "call", "cohort", "edition",
]
ORG_SUFFIXES = [" - Scholarship", " Scholarship", " Fellowship", " PhD", " MSc"]

SCAM_PHRASES = [
    "processing fee", "pay to apply", "guaranteed acceptance", "guaranteed admission", "wire transfer",
    "send money", "whatsapp only", "telegram only", "crypto payment", "registration fee required",
]

STALE_PAGE = (
    r"(?i)(no longer accepting|applications?\s+closed|deadline\s+has\s+passed|"
    r"this\s+(page|opportunity)\s+(has\s+)?expired|not\s+accepting\s+applications|"
    r"404\s+not\s+found|page\s+not\s+found)"
)

ARTICLE_PATH = r"(?i)/(blog|news|article|post|fellowship|scholarship|grant|opportunity)/[^/]+/?$"
LISTING_PATH = r"(?i)(scholarship|fellowship|funding|opportunit|grant|program|vacancy|position)"
DATE_PATH = r"/20\d{2}/|/\d{4}-\d{2}-\d{2}"
LISTING_TERMS = ["scholarship", "fellowship", "funding", "graduate", "phd", "opportunities", "grants"]

REGION_ALIASES = {
    "Germany": ["Germany", "German", "DAAD", "Deutschland"],
    "Europe": ["Europe", "European", "EU", "Erasmus"],
    "UK": ["UK", "United Kingdom", "Britain", "Chevening", "British"],
    "USA": ["USA", "United States", "America", "US"],
    "Canada": ["Canada", "Canadian"],
    "Australia": ["Australia", "Australian"],
}
DEGREE_SYNONYMS = {
    "MSc": ["MSc", "master", "masters", "MS", "graduate program", "postgraduate"],
    "PhD": ["PhD", "doctoral", "doctorate", "Ph.D"],
    "Fellowship": ["fellowship", "fellow"],
    "Internship": ["internship", "intern"],
    "Mixed": ["MSc", "master", "scholarship", "fellowship"],
}
MUST_MATCH_FUNDING = ["scholarship", "fellowship", "fully funded", "stipend", "tuition"]
ANTI_GOAL_DROPS = {
    "unpaid_internships": ["unpaid internship", "unpaid role", "volunteer only"],
    "non_stem": ["non-stem", "humanities only", "business administration only"],
    "no_funding_info": ["self-funded only", "no funding information"],
    "online_only": ["100% online", "online only degree", "fully remote degree"],
    "undergrad_only": ["undergraduate only", "high school only", "bachelor applicants only"],
    "bootcamp": ["coding bootcamp", "bootcamp scholarship"],
}
ALWAYS_DROP = ["webinar only", "conference registration", "high school"]
REJECT_PHRASES = [
    "PhD only", "EU citizens only", "domestic students only", "undergraduate only", "high school students",
    "unpaid", "volunteer only",
]
BOOST_PHRASES = [
    "international students", "developing countries", "global south", "DAAD", "fully funded", "tuition waiver",
]
FUNDING_RULE = {"full_only": "full_only", "partial_ok": "full_or_partial", "self_fund_possible": "any"}
ANTI_GOAL_LABELS = {
    "unpaid_internships": "Unpaid internships / volunteer-only roles",
    "non_stem": "Non-STEM fields",
    "no_funding_info": "Programs with no funding info for international students",
    "online_only": "Pure online degrees (no research component)",
    "undergrad_only": "Undergraduate-only opportunities",
    "bootcamp": "Generic coding bootcamp scholarships",
}
MONTH_NUMBERS = {
    "January": "01", "February": "02", "March": "03", "April": "04", "May": "05", "June": "06",
    "July": "07", "August": "08", "September": "09", "October": "10", "November": "11", "December": "12",
}
TARGET_DEGREES = ["MSc", "PhD", "Fellowship", "Internship", "Mixed"]
FUNDING_REQUIREMENTS = ["full_only", "partial_ok", "self_fund_possible"]
RESEARCH_HINTS = ["research", "teaching assistant", "fellow", "publication", "r&d"]
PREFILL_REVIEW = [
    "experiences", "publications", "skills", "search_keywords", "preferences.long_term_direction",
]
