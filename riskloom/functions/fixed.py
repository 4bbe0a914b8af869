"""Fixed values that results depend on, stated plainly in one place."""
from __future__ import annotations

# Exchange rates to GBP.
FX_TO_GBP = {"GBP": 1.0, "EUR": 0.85, "USD": 0.78}

# Severity of an event by its alert level; anything else is 0.
ALERT_SEVERITY = {"Red": 1.0, "Orange": 0.6, "Green": 0.2}

# Commodity chapters in scope (first two digits of the CN8 code).
CHAPTERS = ("29", "72", "84", "85")

# Trade-statistics country codes that are not ISO alpha-2.
TRADE_COUNTRY_OVERRIDES = {
    "XS": "SRB", "XK": "XKX", "XC": "ESP", "XL": "ESP", "DH": "ARE", "DU": "ARE", "HA": "ARE",
}

# Sanctions-regime subjects whose name is not a country-register name.
REGIME_COUNTRY_OVERRIDES = {
    "Democratic People's Republic of Korea": "PRK",
    "Republic of Belarus": "BLR",
    "Republic of Guinea-Bissau": "GNB",
    "Democratic Republic of the Congo": "COD",
    "Russia": "RUS",
    "Iran": "IRN",
    "Syria": "SYR",
    "Venezuela": "VEN",
}

# Country names outside the ISO register.
EXTRA_COUNTRY_NAMES = {"XKX": "Kosovo"}

# Fixed value: risk of a country under a sanctions regime.
SANCTIONS_RISK = 0.8

# Weight of each fragility signal; the sum is capped at 1.
FRAGILITY_WEIGHTS = {
    "not_active": 1.0,
    "accounts_overdue": 0.35,
    "confirmation_overdue": 0.20,
    "younger_than_2y": 0.15,
    "charges_outstanding": 0.10,
}

# Weight of a supplier's criticality in its priority; anything else counts as medium.
CRITICALITY_WEIGHT = {"high": 1.0, "medium": 0.6, "low": 0.3}

# Percent-rank of spend from which a supplier is high / medium.
CRITICALITY_CUTS = {"high": 0.8, "medium": 0.4}

# Fixed values: (method, lowest score, confidence); the first rule that holds decides.
MATCH_RULES = (
    ("registration_number", 70, 0.99),
    ("postcode_name", 92, 0.95),
    ("exact_name", 100, 0.85),
    ("postcode_name", 80, 0.75),
)
# Lowest name similarity of a postcode candidate, lowest accepted and lowest unreviewed confidence.
POSTCODE_JW_FLOOR = 0.80
ACCEPT_AT = 0.75
REVIEW_BELOW = 0.90

# Legal status moves of an alert.
ALERT_TRANSITIONS = {
    "open": ("acknowledged", "closed"),
    "acknowledged": ("closed", "mitigating"),
    "mitigating": ("closed",),
    "closed": (),
}

# Fixed value: the country whose suppliers inherit the national sourcing mix.
HOME_COUNTRY = "GBR"

# White space that is cut off both ends of what people type.
WHITE_SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# The steps that make company names comparable, in order (pattern, replacement). Listed letters are looked up
# in a bitmap; a class of ranges ([^A-Z0-9 ]) takes four times as long.
NAME_STEPS = (
    ("&", " AND "),
    ("[^ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ]", " "),
    (r"\bLTD\b", "LIMITED"),
    (r"\bCO\b", "COMPANY"),
    ("^THE ", ""),
    ("  +", " "),
)

# Words that state the legal form, and the pattern of a misspelt LIMITED at the end.
LEGAL_FORMS = ("LIMITED", "PLC", "LLP", "LP", "INCORPORATED", "INC", "CORPORATION", "CORP", "GMBH")
MISSPELT_FORM = r"\bL[IMTED]{4,7}$"

# Fixed value: the subject of a sanctions regime in its title.
REGIME_SUBJECT = r"^(?:The )?(.+?) \(Sanctions\)"

# Industry codes in the company file, and the word for none.
SIC_CODE = "^[0-9]{5} - "
NO_SIC_CODE = "^None Supplied$"

# What callers are told when an action is rejected, %s in order of appearance.
REJECTIONS = {
    "vendor": "Unknown supplier %s",
    "event": "Unknown event %s",
    "alert": "Unknown alert %s",
    "owner": "An alert needs an owner",
    "open": "An open alert already exists for this supplier and event (%s)",
    "move": "Cannot move %s -> %s. Allowed: %s",
    "no_move": "none (closed)",
    "closing": "Closing an alert requires a note explaining the outcome",
    "company": "%s is not a registered company number",
    "criticality": "Criticality must be one of %s",
}

# The parts of the sentence that explains an exposure, joined by " > ".
PATH_TEXTS = {
    "country": "affects %s",
    "inferred": "which supplies %s%% of UK imports of %s (%s) > which we buy from %s",
    "direct": "where %s is located (direct supplier)",
}
