"""Vocabularies and thresholds the operators take as parameters."""

# The results depend on these exact words, patterns and numbers.

EARTH_RADIUS_KM = 6371.0088

BLANK_WORDS = ["nan", "none", "null"]

TAG_RULES = {
    "oppisopimus": ["oppisopimus", "apprentice"],
    "trainee": ["trainee", "harjoittel", "intern"],
    "junior": ["junior"],
    "data": ["data", "analyyt", "analytics", "bi ", " sql", "sql "],
    "it_support": ["it-tuki", "helpdesk", "service desk", "support"],
    "marketing": ["marketing", "markkinointi"],
    "salesforce": ["salesforce"],
}
ACTIVITY_TAGS = ["data", "it_support", "salesforce", "oppisopimus"]

INDUSTRY_GROUPS = {
    "it": ["62", "63"],
    "marketing": ["73", "70"],
    "logistics": ["49", "52"],
    "retail": ["47"],
    "manufacturing": [
        "10", "11", "12", "13", "14", "15", "16", "17", "18", "19", "20", "21", "22", "23", "24", "25", "26", "27", "28", "29", "30", "31", "32",
        "33",
    ],
    "other": [],
}

HOUSING_FORMS = ["ASUNTO-OSAKEYHTIO", "AS OY", "ASUNTO OY", "ASUNTO-OSUUSKUNTA"]
HOUSING_NAME_PATTERNS = [
    r"^\s*as\.?\s*oy\b",
    r"\basunto\s*oy\b",
    r"\basunto[-\s]?oy\b",
    r"\basunto[-\s]?osakeyhtio\b",
    r"\bkiinteisto\s*oy\b",
]

SCORE_WEIGHTS = {
    "loc_ok": 3,
    "industry_ok": 3,
    "industry_blacklist": -5,
    "excluded": -10,
    "recruiting_active": 2,
    "new_jobs": 1,
    "tag": 1,
}

EVIDENCE_KEYWORDS = [
    "open positions", "open roles", "openings", "apply", "job", "jobs", "career", "careers",
    "hiring", "rekry", "rekrytointi", "ura", "tyopaikat", "avoin tehtava", "hae tahan",
]
NEGATIVE_KEYWORDS = [
    "no open positions", "no openings", "no vacancies", "no open roles", "not hiring",
    "not recruiting", "ei avoimia", "ei avoimia paikkoja",
]
COOKIE_WALL_KEYWORDS = [
    "cookie", "cookies", "we use cookies", "accept all", "reject all", "manage preferences",
    "consent", "gdpr", "eväste", "evästeet", "hyväksy evästeet", "salli kaikki",
    "hylkää kaikki", "tietosuoj",
]
COOKIE_WALL_SIGNALS = {
    "cookie_banner": ["cookie", "cookies", "we use cookies", "eväste", "evästeet"],
    "consent_manager": ["consent", "gdpr", "manage preferences", "tietosuoj"],
    "cookie_actions": ["accept all", "reject all", "salli kaikki", "hylkää kaikki"],
}
COOKIE_WALL_LIMITS = {"hits_min": 2, "score_min": 0.4, "text_max_len": 2000, "hits_hard": 5}
CONSENT_KEYWORDS = [
    "cookie", "cookies", "consent", "preferences", "accept", "manage cookies", "eväste",
    "evaste", "evästeet", "hyväksy", "suostumus", "valitse",
]
CONSENT_PAIR = ["cookie", "consent"]
CONSENT_STATUS_WORDS = ["cookie", "consent", "eväste", "evaste", "hyväksy"]
JOB_SIGNAL_PHRASES = [
    "open positions", "open roles", "apply", "tyopaikat", "avoin tehtava", "hae tahan",
]
STRUCTURED_MARKER = "jobposting"

JOB_URL_HINTS = ["/jobs", "/careers", "/positions", "/rekry", "/tyopaikat", "?job", "open-position"]
JOB_TEXT_HINTS = ["apply", "hae", "avoin", "position", "job", "role", "tehtävä"]
CAREER_HINTS = [
    "career", "careers", "job", "jobs", "open-position", "open-positions", "rekry",
    "rekrytointi", "ura", "tyopaikat", "työpaikat", "join",
]
SITEMAP_KEYWORDS = ["job", "career", "rekry", "tyopaikat", "ura"]
LISTING_PATHS = ["/jobs", "/careers", "/positions", "/open-positions", "/rekry", "/tyopaikat", "/ura"]
NON_JOB_PATH_HINTS = ["/people", "/team", "/privacy", "/terms", "/about", "/contact"]
NON_JOB_QUERY_HINTS = ["department_id=", "team_id=", "category="]
SCAN_PATHS = ["/careers", "/jobs", "/open-positions", "/rekry", "/ura", "/tyopaikat"]
CRAWL_PATHS = [
    "/careers", "/jobs", "/rekry", "/tyopaikat", "/ura", "/open-positions", "/positions", "/join-us",
]

ATS_HOSTS = [
    "greenhouse.io", "lever.co", "workable.com", "smartrecruiters.com", "recruitee.com",
    "teamtailor.com", "jobylon.com", "talentadore.com", "sympa.com", "jazzhr.com",
]
ATS_LINK_PATTERNS = {
    "greenhouse": r"boards\.greenhouse\.io/([^/]+)/?",
    "lever": r"jobs\.lever\.co/([^/]+)/?",
    "recruitee": r"\.recruitee\.com",
    "teamtailor": r"\.teamtailor\.com",
    "smartrecruiters": r"\.smartrecruiters\.com",
}
MAPS_HOSTS = ["www.google.com", "google.com", "maps.google.com", "maps.app.goo.gl", "goo.gl"]
PLACE_ID_KEYS = ["place_id", "placeid", "query_place_id"]

ROBOTS_ALL = "robots_disallow_all"
ROBOTS_URL = "robots_disallow_url"
ROBOTS_UNAVAILABLE = "robots_unavailable"

SIGNALS = ["yes", "no", "unclear"]
OUTPUT_FORMATS = ["csv", "jsonl"]
BOOL_TRUE = ["true", "1", "yes", "y", "t"]
BOOL_FALSE = ["false", "0", "no", "n", "f"]

MAP_FALLBACK_CENTER = (60.1699, 24.9384)
MARKER_RADIUS = (3.0, 10.0)

PROMPT_TEXT = (
    "You classify if a company page indicates hiring or recruiting. "
    "Return ONLY JSON with keys: hiring_signal (yes|no|unclear), confidence (0-1), "
    "evidence (short phrase), evidence_snippets (list of 2-6 short snippets), "
    "evidence_urls (list of URLs), next_url_hint (optional)."
)

PRESETS = {
    "Default": {"min_score": 0, "max_distance_km": 5.0},
    "Shortlist": {"statuses": ["shortlist"], "min_score": 0, "max_distance_km": 5.0},
    "Recruiting": {"only_recruiting": True, "min_score": 0, "max_distance_km": 3.0},
    "Cleanup Other": {
        "industries": ["other"], "include_hidden": True, "include_excluded": True,
        "min_score": 0, "max_distance_km": 10.0,
    },
    "Hidden review": {
        "include_hidden": True, "include_excluded": True, "include_housing": True,
        "min_score": 0, "max_distance_km": 10.0,
    },
    "Excluded review": {
        "statuses": ["excluded"], "include_hidden": True, "include_excluded": True,
        "include_housing": True, "min_score": 0, "max_distance_km": 10.0,
    },
}
PROFILES = {
    "commute_default": {"radius_km": 1.0, "max_distance_km": 2.0, "stations": "Pasila,Helsinki"},
    "data_junior": {
        "include_tags": "data", "exclude_tags": "senior,lead,principal", "min_score": 5, "max_items": 50,
    },
    "apprenticeship": {
        "include_tags": "oppisopimus,intern,trainee", "exclude_tags": "senior,lead,principal", "min_score": 0,
    },
}
