"""Word lists, lookup tables, patterns and message texts.

Everything below is data that results depend on literally; order matters where
a list is scanned front to back.  Patterns are written for Java's regex engine:
``(?U)`` makes ``\\s``, ``\\d``, ``\\b`` Unicode-aware and implies Unicode case
folding when ``i`` is also given.
"""

# ---------------------------------------------------------------- buyers
DEFAULT_BUYERS = ["ceo", "founder", "cto", "head_of_engineering", "technical_recruiter"]

BUYER_ALIASES = {
    "ceo": "ceo",
    "chief executive officer": "ceo",
    "founder": "founder",
    "cofounder": "founder",
    "cto": "cto",
    "chief technology officer": "cto",
    "head of engineering": "head_of_engineering",
    "vp engineering": "head_of_engineering",
    "engineering manager": "head_of_engineering",
    "technical recruiter": "technical_recruiter",
    "talent lead": "technical_recruiter",
    "head of talent": "technical_recruiter",
    "recruiter": "technical_recruiter",
}

# "chief executive officer" is an alias but is not searched for in free text.
ROLE_WORDS = [word for word in BUYER_ALIASES if word != "chief executive officer"]
ADJACENT_ROLE_WORDS = ["engineering", "founder", "technology", "talent", "recruit"]

# ---------------------------------------------------------------- countries
COUNTRY_ALIASES = {
    "spain": "es",
    "españa": "es",
    "espana": "es",
    "madrid": "es",
    "barcelona": "es",
    "europe": "eu",
    "europa": "eu",
    "portugal": "pt",
    "france": "fr",
    "germany": "de",
    "uk": "gb",
    "united kingdom": "gb",
}

COUNTRY_TERMS = {
    "es": ["Spain", "Spanish", "Madrid", "Barcelona", "Valencia"],
    "eu": ["Europe", "European"],
    "pt": ["Portugal", "Portuguese", "Lisbon", "Porto"],
    "fr": ["France", "French", "Paris", "Lyon"],
    "de": ["Germany", "German", "Berlin", "Munich"],
    "gb": ["United Kingdom", "UK", "London", "British"],
}
UNLISTED_COUNTRY_TERMS = ["Spain", "Madrid", "Barcelona"]
CITIES = ["Madrid", "Barcelona", "Valencia", "Lisbon", "Paris", "Berlin", "London"]

# ---------------------------------------------------------------- themes
DEFAULT_THEMES = ["genai", "ai engineering", "automation", "agentic workflows", "software company"]

THEME_ALIASES = {
    "genai": "genai",
    "generative ai": "genai",
    "ai engineering": "ai engineering",
    "automation": "automation",
    "workflow": "agentic workflows",
    "agentic": "agentic workflows",
    "software": "software company",
    "it": "software company",
    "engineering": "ai engineering",
}
# Searched for in briefs after the aliases above, never in evidence.
EXTRA_BRIEF_THEMES = {"llm": "genai", "machine learning": "ai engineering"}
# Override the aliases when a whole list entry is canonicalised.
THEME_ENTRY_OVERRIDES = {"llm": "genai", "machine learning": "ai engineering", "workflow": "automation"}

THEME_TERMS = {
    "genai": ["AI", "GenAI", "generative AI"],
    "ai engineering": ["AI software", "machine learning", "data intelligence"],
    "automation": ["automation", "workflow automation", "customer automation"],
    "agentic workflows": ["AI agents", "agentic workflows", "workflow automation"],
    "software company": ["software company", "B2B software", "SaaS"],
}

# ---------------------------------------------------------------- hosts and names
DIRECTORY_HOSTS = [
    "apollo.io",
    "crunchbase.com",
    "designrush.com",
    "eu-startups.com",
    "f6s.com",
    "linkedin.com",
    "rocketreach.co",
    "seedtable.com",
    "startupstash.com",
    "techbehemoths.com",
    "tracxn.com",
    "wellfound.com",
]
SOCIAL_HOSTS = ["facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "tiktok.com"]
NO_WEBSITE_HOST_SUFFIXES = ["eu-startups.com", "seedtable.com", "wellfound.com"]
GENERIC_COMPANY_NAMES = ["artificial intelligence", "ai", "software company", "startup", "company"]

# ---------------------------------------------------------------- patterns
SPACE = r"[\s\x1c-\x1f]"
COUNT_PATTERN = r"(?iU)\b(?:find|search|busca|buscar)?\s*(\d+)\s+leads?\b"
ANY_NUMBER_PATTERN = r"(?U)\b(\d+)\b"
SIZE_RANGE_PATTERN = r"(?iU)(?:entre|between)\s*(\d+)\s*(?:y|and|-)\s*(\d+)\s*(?:empleados|employees)"
SIZE_MIN_PATTERN = r"(?iU)(?:more than|over|mas de|más de)\s*(\d+)\s*(?:empleados|employees)"
SIZE_MAX_PATTERN = r"(?iU)(?:less than|under|menos de)\s*(\d+)\s*(?:empleados|employees)"
ROLE_WORD_PATTERN = r"(?iU)\b(" + "|".join(ROLE_WORDS) + r")\b"

EMPLOYEES_LABEL = r"(?iU)(?:employees|empleados)\s*[:\-]?\s*(\d+)"
COUNTRY_LABEL = r"(?iU)(?:country|pais|país)\s*[:\-]?\s*([A-Za-zñáéíóú ]+)"
PERSON_LABEL = r"(?iU)(?:person|persona|contact)\s*[:\-]?\s*([^\n|]+)"
ROLE_LABEL = r"(?iU)(?:role|puesto|title|cargo)\s*[:\-]?\s*([^\n|]+)"
COMPANY_LABEL = r"(?iU)(?:company|empresa)\s*[:\-]?\s*([^\n|]+)"

# Upper-case words without which the pattern of the same name cannot match.
LABEL_WORDS = {
    PERSON_LABEL: ["PERSON", "CONTACT"],
    ROLE_LABEL: ["ROLE", "PUESTO", "TITLE", "CARGO"],
    COMPANY_LABEL: ["COMPANY", "EMPRESA"],
    COUNTRY_LABEL: ["COUNTRY", "PAIS", "PAÍS"],
    EMPLOYEES_LABEL: ["EMPLOYEES", "EMPLEADOS"],
    ROLE_WORD_PATTERN: [word.upper() for word in ROLE_WORDS],
}

NAME_NOISE_WORDS = r"(?i)\b(page|directory|startups?|companies?)\b"
LISTING_TITLE_WORDS = r"(?iU)\b(startups?|companies?|jobs?|rankings?)\b"
TITLE_SEPARATOR = r"(?U)\s+[|\-]\s+"
URL_IN_TEXT = r"(?iU)https?://[^\s\x1c-\x1f)]+"
LINE_BREAK = r"\R|[\x1c\x1d\x1e]"

# ---------------------------------------------------------------- limits
MAX_RESULTS = 5
SHORTLIST_SIZE = 5
SOURCE_ATTEMPT_BUDGET = 6
ENRICH_ATTEMPT_BUDGET = 1
EXCERPT_CHARS = 2000
TARGET_COUNT_RANGE = (1, 20)
COMPANY_SIZE_RANGE = (1, 100000)

# ---------------------------------------------------------------- memory kinds
QUERY_HISTORY = "query_history"
VISITED_URLS = "visited_urls"
COMPANY_NAMES = "searched_company_names"
LEAD_NAMES = "registered_lead_names"
MISS_STREAK = "consecutive_hard_miss_runs"
RESET_FIELDS = {
    "queryHistory": QUERY_HISTORY,
    "visitedUrls": VISITED_URLS,
    "searchedCompanyNames": COMPANY_NAMES,
    "consecutiveHardMissRuns": MISS_STREAK,
}

# ---------------------------------------------------------------- notes and reasons
NOTE_NO_QUERY = "no_unused_queries_left"
NOTE_ALL_VISITED = "all_results_were_already_visited"
NOTE_NO_RESULT = "no_candidate_from_search_results"
NOTE_NO_COMPANY = "unable_to_extract_company"
NOTE_EXPLORED = "company_already_terminally_explored"
NOTE_HEURISTIC = "candidate_selected_by=heuristic"
NOTE_EXTERNAL = "candidate_selected_by=llm"

NO_DOSSIER_SUMMARY = "No candidate dossier was found."
NO_DOSSIER_REASON = "sourcing did not produce a valid candidate"
REASONS = {
    "role_exact": "buyer persona matches the preferred targets",
    "role_adjacent": "role is adjacent to the preferred buyer persona",
    "role_none": "preferred buyer persona is not yet fully matched",
    "country_match": "company geography matches the requested country",
    "country_unknown": "company geography is not fully evidenced yet",
    "size_unknown": "company size is not fully evidenced yet",
    "size_match": "company size falls within the requested range",
    "signals": "company shows relevant automation or AI signals",
    "named": "named person found",
    "many_urls": "evidence is supported by multiple URLs",
    "one_url": "only one supporting URL is available",
}
MISS_PERSONA = "preferred buyer persona"
MISS_COUNTRY = "preferred_country"
MISS_SIZE = "company_size"
NO_MISS_NAMED = "strict exact match"
SUMMARIES = {
    "hard_miss": "Candidate fails at least one hard constraint.",
    "enrich": "Candidate looks promising but needs more evidence.",
    "unknown_close": "Candidate is commercially interesting but cannot be confirmed as an exact match.",
    "unknown_reject": "Candidate lacks proof for one or more hard constraints.",
    "accept": "Candidate is a strong exact match.",
    "close": "Candidate is commercially interesting but misses part of the preferred fit.",
    "weak": "Candidate is not strong enough for this request.",
}
CLOSE_MATCH_SUMMARY = "Commercially interesting candidate with exact-match gaps."

# ---------------------------------------------------------------- query templates
# {country} first country term, {term} theme term, {city}, {buyer}, {hint} size hint.
TERM_TEMPLATES = [
    "site:eu-startups.com/directory/ {country} {term} software",
    "{country} startup {term} software company",
]
SIZED_TERM_TEMPLATE = "{country} startup {term} {hint}"
CITY_TEMPLATES = [
    "site:seedtable.com best AI startups in {city}",
    "{city} B2B software startup automation",
]
BUYER_TEMPLATE = "{country} {buyer} {term} software startup"
STAGE_TEMPLATES = {
    1: [
        "site:eu-startups.com {country} startup automation",
        "site:startupstash.com {country} startup AI",
        "{country} AI startup founder software",
    ],
    2: [
        "{country} software startup AI",
        "{country} SaaS automation startup",
        "site:techbehemoths.com artificial intelligence companies {country}",
    ],
}

# ---------------------------------------------------------------- outreach templates
# {person} {company} {role} {two} / {three}: first two / three topics.
NO_EVIDENCE_NOTE = "No explicit evidence captured."
HOOK_TEMPLATES = [
    "{company} appears active around {two}.",
    "The contact role aligns with {role}.",
]
CONNECTION_NOTE_TEMPLATE = (
    "Hola {person}, he visto varias señales de que {company} está trabajando temas de {two}. "
    "Yo ayudo a equipos IT a convertir esas iniciativas en automatizaciones y workflows agentic útiles."
)
DM_TEMPLATE = (
    "Hola {person}, estuve mirando {company} y creo que puede haber una oportunidad clara "
    "para acelerar procesos internos con GenAI y automatización aplicada. "
    "Si te encaja, te comparto 2 o 3 ideas muy concretas."
)
SUBJECT_TEMPLATE = "Idea concreta de automatización para {company}"
BODY_TEMPLATE = (
    "Hola {person},\n\n"
    "He revisado {company} y veo señales útiles en torno a {three}. "
    "Trabajo como freelancer de sistemas agentic y GenAI para equipos IT que quieren aterrizar mejoras reales, "
    "no solo pruebas.\n\n"
    "Si te interesa, puedo proponerte unas cuantas automatizaciones o flujos aplicables a vuestro contexto.\n\n"
    "Un saludo."
)
