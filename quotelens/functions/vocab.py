"""Word lists, weights and limits that decide results.

Everything here is data. Operators take these lists as parameters, so a site can extend them.
"""

# --- endpoint URL evidence (fixed values) ---------------------------------------------------------
API_LIKE = ["/api", "graphql", "pricing", "quote", "calculate"]

URL_NOISE = [
    "analytics", "tracking", "pixel", "gtm", "fonts", "doubleclick", "/_nuxt/", "/builds/meta/", "/meta/",
    "deeplink", "kameleoon", "useinsider", "userlike", "linkedin", "googletagmanager", "consent", "segment",
    "bing.com", "usercentrics", "privacy-proxy", "consent-api", "typekit",
]
PRICE_NOISE_URL = [
    "kameleoon", "usercentrics", "consent", "privacy-proxy", "googletagmanager", "google-analytics",
    "doubleclick", "bing.com", "typekit", "facebook", "linkedin", "analytics", "track-traffic-source",
]
UNUSABLE_ENDPOINT = [
    "deeplink", "builds/meta", "/_nuxt/", ".js", ".css", "kameleoon", "useinsider", "userlike", "linkedin",
    "doubleclick", "googletagmanager", "consent", "segment", "bing.com", "premium-filecheck-price",
    "file-check/select-boxes",
]
SCORE_PENALTY_URL = [
    "deeplink", "builds/meta", "/_nuxt/", ".js", ".css", "media-by-file-name", "gtm", "kameleoon", "useinsider",
    "userlike", "linkedin", "doubleclick", "googletagmanager", "consent", "segment", "bing.com", "usercentrics",
    "privacy-proxy", "consent-api", "typekit",
]
URL_COMPOUND_HINTS = [
    "productdetails", "price-matrix", "price_matrix", "pricescale", "product-configuration", "get-product-prices",
]

# --- request families (fixed values) --------------------------------------------------------------
FAMILY_TOKENS = {
    "pricing_pipeline": [
        "price", "pricing", "quote", "calculate", "productdetails", "final_prices", "total_gross", "total_net",
        "price-matrix", "price_matrix", "pricescale", "get-product-prices", "product-configuration",
    ],
    "schema_pipeline": [
        "schema", "options", "option", "properties", "property", "propertyconfiguration", "repo", "catalog",
        "values", "value",
    ],
    "quantity_pipeline": [
        "quantity", "qty", "auflage", "matrix", "scale", "pricescale", "price-matrix", "price_matrix",
    ],
    "validation_pipeline": [
        "validate", "validation", "summary", "selected", "configuration", "check", "details", "verify",
    ],
}
INFRASTRUCTURE = [
    "translation", "translations", "i18n", "widget", "config", "auth", "auth-check", "countries", "country",
    "chatbot", "analytics", "consent", "tracking", "pixel", "gtm", "segment", "doubleclick", "usercentrics",
]
RESCUED_FAMILIES = ["pricing_pipeline", "quantity_pipeline", "schema_pipeline"]

# --- semantic token groups (fixed values) ---------------------------------------------------------
SEMANTIC = {
    "pricing": [
        "price", "pricing", "quote", "calculate", "final_prices", "total_gross", "total_net", "total", "gross",
        "net", "amount", "productdetails",
    ],
    "quantity": ["quantity", "qty", "auflage", "pricescale", "price_matrix", "price-matrix", "matrix", "scale"],
    "config": [
        "schema", "options", "option", "properties", "property", "propertyconfiguration", "configuration", "repo",
        "catalog", "values", "value",
    ],
    "validation": ["validate", "validation", "summary", "selected", "check", "details", "verify"],
}

# --- endpoint roles (fixed values); the order breaks ties ------------------------------------------
ROLES = ["schema", "pricing", "quantity_matrix", "delivery", "validation", "noise"]
ROLE_WEIGHT = {
    "pricing": 16, "quantity_matrix": 13, "validation": 10, "schema": 9, "delivery": 4, "noise": -20, "unknown": 0,
}
# (role, points, where, tokens); "where" is url (substring), payload / response (JSON key) or preview (substring).
# The response and preview rules count only for traces whose request body has JSON keys.
ROLE_RULES = [
    ("noise", 5, "url", URL_NOISE),
    ("schema", 3, "url", ["repo", "values", "schema", "options", "property"]),
    ("pricing", 4, "url", ["price", "pricing", "quote", "calculate", "get-product-prices"]),
    ("quantity_matrix", 4, "url", ["price-matrix", "pricescale", "scale", "auflage", "quantity"]),
    ("delivery", 3, "url", ["delivery", "shipping", "dispatch"]),
    ("validation", 3, "url", ["details", "summary", "selected", "validate"]),
    ("pricing", 5, "url", ["productdetails", "price-matrix", "pricescale", "/repo"]),
    ("quantity_matrix", 4, "url", ["price-matrix", "pricescale"]),
    ("pricing", -6, "url", ["premium-filecheck-price", "file-check/select-boxes"]),
    ("validation", 2, "url", ["premium-filecheck-price", "file-check/select-boxes"]),
    ("noise", 4, "url", ["premium-filecheck-price", "file-check/select-boxes"]),
    ("schema", 2, "payload", ["properties", "propertyconfiguration", "propertyid", "value", "id", "name"]),
    ("pricing", 1, "payload", ["properties", "propertyconfiguration", "propertyid", "value", "id", "name"]),
    ("quantity_matrix", 2, "payload", ["quantity", "qty", "auflage", "pricescale"]),
    ("delivery", 2, "payload", ["delivery", "shipping", "delivery_country_code"]),
    ("pricing", 2, "response", ["price", "total", "gross", "net", "amount", "vat"]),
    ("quantity_matrix", 2, "response", ["quantity", "qty", "auflage", "scale", "pricescale"]),
    ("schema", 2, "response", ["properties", "propertyconfiguration", "selectedproperties"]),
    ("pricing", 1, "preview", ['"price"', '"total"', '"amount"', '"gross"']),
    ("pricing", 5, "preview", ["final_prices", "total_gross", "total_gross_value", "price_matrix", "pricescale"]),
    ("quantity_matrix", 3, "preview", ["price_matrix", "pricescale", "quantity_heading"]),
]
BARE_PRICE_BODY = r'^\s*"?\d+[\.,]\d{2}\s*(?:€|eur)?\s*"?\s*$'

PAYLOAD_PRICE_KEYS = ["price", "total", "gross", "net", "amount", "final_prices", "total_gross_value"]
PAYLOAD_QUANTITY_KEYS = ["quantity", "qty", "auflage", "pricescale", "price_matrix"]
PAYLOAD_PROPERTY_KEYS = ["properties", "propertyconfiguration", "propertyid", "value", "id", "name"]
PAYLOAD_PRODUCT_KEYS = ["product_alias_id", "productgroupid", "uid", "type"]

# --- price mining (fixed values) ------------------------------------------------------------------
PRICE_KEY_WEIGHT = [
    ("finalprice", 18), ("endpreis", 18), ("grandtotal", 16), ("gesamtpreis", 16), ("totalgross", 15),
    ("gross", 12), ("brutto", 12), ("total", 10), ("sum", 9), ("price", 8), ("preis", 8), ("amount", 7),
    ("net", 4), ("netto", 4), ("unit", 3), ("stueck", 2),
]
PRICE_KEYS_PLAIN = ["price", "total", "amount", "gross", "net"]
PRICE_KEYWORD_GROUPS = [
    (r"finalprice|endpreis|gesamtpreis|grandtotal", 18),
    (r"total\s*gross|gross|brutto", 13),
    (r"total|sum", 10),
    (r"price|preis|amount", 8),
    (r"net|netto|unit|stueck", 4),
]
# literal words without which a group cannot match
PRICE_KEYWORD_GATES = [
    ["finalprice", "endpreis", "gesamtpreis", "grandtotal"], ["gross", "brutto"], ["total", "sum"], ["price", "preis", "amount"], ["net", "unit", "stueck"],
]
PRICE_NUMBER = r"\d{1,3}(?:[\.\s\u00a0]\d{3})*(?:[,\.]\d{2})|\d+(?:[,\.]\d{2})"
PRICE_NUMBER_GUARDED = r"(?<!\d)(?:\d{1,3}(?:[\.\s\u00a0]\d{3})*[,\.]\d{2}|\d+[,\.]\d{2})(?!\d)"
PATH_BONUS_VALUE = [
    "final_prices.total_gross_value", "final_prices.total_net_value", "total_gross_value", "total_net_value",
]
PATH_BONUS_TOTAL = [
    "final_prices.total_gross", "final_prices.total_net", "total_gross", "total_net", "grandtotal", "gesamtpreis",
    "endpreis",
]
PATH_MALUS_PART = ["product_gross", "product_net", "shipping", "delivery", "unit", "single"]
PATH_MALUS_EXTRA = ["cover", "umschlag", "surcharge", "aufschlag", "addon", "add_on", "option"]
GROUP_SHIPPING = ["shipping", "delivery", "versand", "fracht"]
GROUP_TOTAL = [
    "total_gross_value", "total_net_value", "total_gross", "total_net", "finalprice", "endpreis", "grandtotal",
    "gesamtpreis", "order_total", "named:total",
]
GROUP_COMPONENT = [
    "unit", "single", "stueck", "stück", "product_", "net", "vat", "tax", "cover", "umschlag", "surcharge",
    "aufschlag", "addon", "add_on", "component",
]
GROUP_PRIORITY = {"top_level_total": 8, "other": 2, "component": -6, "shipping": -10}
GROUP_REPORT_CAP = {"top_level_total": 60, "other": 35, "component": 20, "shipping": 10}
NAMED_NUMERIC = [
    "total_gross_value", "total_net_value", "product_gross_value", "product_net_value", "shipping_gross_value",
    "shipping_net_value", "total_vat_value",
]
NAMED_TEXT = [
    "total_gross", "total_net", "product_gross", "product_net", "shipping_gross", "shipping_net", "total_vat",
]
NAMED_PREFERRED = ["total_gross_value", "total_net_value", "total_gross", "total_net"]
SITE_REFERENCE_NAMED = ["total_gross_value", "total_gross", "total_net_value", "total_net"]
PRICE_TEXT_TOKENS = ["price", "total", "amount", "gross", "net", "eur", "€"]
PRICE_MAX = 1_000_000.0

# --- option vocabulary (fixed values) -------------------------------------------------------------
KEY_ALIASES = {
    "quantity": ["quantity", "qty", "auflage", "menge", "amount", "stuck", "stueck", "anzahl"],
    "format": [
        "format", "size", "endformat", "din", "groesse", "grosse", "content size", "content_size", "end format",
    ],
    "material": [
        "material", "papier", "paper", "gramm", "grammage", "bilderdruck", "karton", "content paper",
        "content_paper", "innenteil papier", "innenteil_papier",
    ],
    "pages": ["seiten", "seitig", "pages", "umfang", "page", "inner", "inner part", "innenteil", "seitenzahl"],
    "cover": [
        "cover", "umschlag", "zusatzlicher umschlag", "zusatzlicher_umschlag", "cover paper", "cover_paper",
        "cover material", "cover_material", "cover type", "covertype",
    ],
    "delivery": ["delivery", "lieferung", "lieferzeit", "arbeitstage", "production time", "versand"],
    "print": [
        "farbe", "color", "colour", "druck", "print", "printing", "content color", "content_color", "cover color",
        "cover_color", "ausfuhrung innenteil", "ausrichtung",
    ],
}
CLUSTER_PATTERNS = [
    ("material", "umschlag", r"(?i)^\s*umschlag\s+\d+\s*g\s*/\s*m[²2]?"),
    ("material", "innen", r"(?i)^\s*\d+\s*g\s*/\s*m[²2]?\s*\S"),
    ("color", "", r"(?i)^\s*\d+\s*/\s*\d+\s*(?:-?\s*farbig|\s+euroskala|\s+pantone|\s+hks)"),
    ("binding", "", r"(?i)\b(klammerheftung|klebebindung|spiralbindung|wire[-\s]?o|fadenheftung|ringbindung)\b"),
    ("finishing", "",
     r"(?i)\b(cellophan|matt\s*folien|gl(?:a|ä)nz\s*folien|uv[-\s]*lack|hei(?:ß|ss)folien|pr(?:ä|a)gung)\b"),
]
VALUE_ALIASES = {
    "a5": ["a5", "a 5", "din a5", "din-a5", "format a5", "endformat din a5"],
    "a4": ["a4", "a 4", "din a4", "din-a4", "format a4", "endformat din a4"],
    "130gsm": [
        "130gsm", "130 g/m2", "130 g/m²", "130 g", "130 g bilderdruckpapier", "130 g/m² bilderdruckpapier",
        "bilderdruckpapier 130 g",
    ],
    "135gsm": ["135gsm", "135 g/m2", "135 g/m²", "135 g", "135 g bilderdruckpapier"],
    "170gsm": ["170gsm", "170 g/m2", "170 g/m²", "170 g", "170 g bilderdruckpapier"],
}
CONFIDENCE_DEFAULT = ["confirmed", "partial"]
CONFIDENCE_OPT_IN = ["confirmed", "partial", "ui_only"]

# --- transport (fixed values) ---------------------------------------------------------------------
BLOCK_STATUS = [403, 429]
RETRYABLE_STATUS = [408, 425, 429, 500, 502, 503, 504]
REDACTED_HEADERS = ["cookie", "authorization", "proxy-authorization"]
