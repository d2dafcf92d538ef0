"""Word lists, lookup tables and formats that results depend on.

They are part of the data contract, not logic; change one and results change.
"""

# Defaults of a collection run.
DEFAULT_DOMAIN = "www.amazon.fr"
DEFAULT_LANGUAGE = "fr_FR"
DEFAULT_CURRENCY = "EUR"
DEFAULT_TIMEZONE = "Europe/Paris"
DEFAULT_SORT = "recent"
DEFAULT_REVIEWER_TYPE = "all_reviews"
DEFAULT_STAR_FILTER = "all_stars"
DEFAULT_MAX_PAGES = 5

# Domain suffix -> language.
LANGUAGE_BY_SUFFIX = {
    ".fr": "fr_FR",
    ".es": "es_ES",
    ".it": "it_IT",
    ".nl": "nl_NL",
    ".de": "de_DE",
    ".co.uk": "en_GB",
}

# Domain suffix -> time zone.
TIMEZONE_BY_SUFFIX = {
    ".uk": "Europe/London",
    ".es": "Europe/Madrid",
    ".de": "Europe/Berlin",
    ".it": "Europe/Rome",
    ".nl": "Europe/Amsterdam",
}

# Bare domain -> (locale, currency).
MARKETS = {
    "amazon.fr": ("fr_FR", "EUR"),
    "amazon.es": ("es_ES", "EUR"),
    "amazon.it": ("it_IT", "EUR"),
    "amazon.nl": ("nl_NL", "EUR"),
    "amazon.de": ("de_DE", "EUR"),
    "amazon.co.uk": ("en_GB", "GBP"),
}

# Star options, filter codes and labels, best to worst.
STAR_CODE_BY_OPTION = {
    "five": "five_star",
    "four": "four_star",
    "three": "three_star",
    "two": "two_star",
    "one": "one_star",
}
STAR_LABEL_BY_CODE = {
    "five_star": "5 étoiles",
    "four_star": "4 étoiles",
    "three_star": "3 étoiles",
    "two_star": "2 étoiles",
    "one_star": "1 étoile",
}
ALL_STARS_LABEL = "Toutes"

# Sentiment labels in display order.
POSITIVE, NEUTRAL, NEGATIVE = "Positif", "Neutre", "Négatif"

# Month names per language.
MONTHS_FR = {
    "janvier": "01", "février": "02", "fevrier": "02", "mars": "03", "avril": "04",
    "mai": "05", "juin": "06", "juillet": "07", "août": "08", "aout": "08",
    "septembre": "09", "octobre": "10", "novembre": "11", "décembre": "12",
    "decembre": "12",
}
MONTHS_EN = {
    "january": "01", "february": "02", "march": "03", "april": "04", "may": "05",
    "june": "06", "july": "07", "august": "08", "september": "09", "october": "10",
    "november": "11", "december": "12",
}
MONTHS_ES = {
    "enero": "01", "febrero": "02", "marzo": "03", "abril": "04", "mayo": "05",
    "junio": "06", "julio": "07", "agosto": "08", "septiembre": "09",
    "setiembre": "09", "octubre": "10", "noviembre": "11", "diciembre": "12",
}
MONTHS_IT = {
    "gennaio": "01", "febbraio": "02", "marzo": "03", "aprile": "04", "maggio": "05",
    "giugno": "06", "luglio": "07", "agosto": "08", "settembre": "09",
    "ottobre": "10", "novembre": "11", "dicembre": "12",
}
MONTHS_DE = {
    "januar": "01", "februar": "02", "märz": "03", "maerz": "03", "april": "04",
    "mai": "05", "juni": "06", "juli": "07", "august": "08", "september": "09",
    "oktober": "10", "november": "11", "dezember": "12",
}
MONTHS_NL = {
    "januari": "01", "februari": "02", "maart": "03", "april": "04", "mei": "05",
    "juni": "06", "juli": "07", "augustus": "08", "september": "09",
    "oktober": "10", "november": "11", "december": "12",
}

# Lower-case text that marks a challenge page.
CHALLENGE_MARKERS = (
    "captcha",
    "enter the characters you see",
    "saisissez les caractères que vous voyez",
    "robot verification",
    "vérification robot",
    "security check",
    "vérification de sécurité",
    "unusual traffic",
    "trafic inhabituel",
)

# Lower-case text that marks an error page.
ERROR_MARKERS = (
    "page not found",
    "page non trouvée",
    "product not available",
    "produit non disponible",
    "no reviews available",
    "aucun avis disponible",
    "error 404",
    "erreur 500",
    "dogs of amazon",
    "désolé! quelque chose s'est mal passé",
    "sorry! something went wrong",
)

# Lower-case markup that marks a login form.
LOGIN_MARKERS = (
    'id="ap_email"',
    'name="email"',
    'id="ap_password"',
    'name="password"',
    "authportal-center-section",
    "ap_signin_form",
)

# Invitation to sign in, per language (case-sensitive).
SIGN_IN_INVITATIONS = (
    "Identifiez-vous",
    "Sign in",
    "Accedi",
    "Anmelden",
    "Inloggen",
    "Identifícate",
)

# Aria-label text of a next-page link, per language.
NEXT_LINK_LABELS = ("Suivant", "Next", "Volgende", "Siguiente", "Avanti", "Weiter")

# Accepted column names of imported review files, best first.
IMPORT_ALIASES = {
    "review_id": ("review_id", "id"),
    "review_title": ("review_title", "title"),
    "review_body": ("review_body", "body", "content", "text"),
    "reviewer_name": ("reviewer_name", "author", "user"),
    "review_date": ("review_date", "date"),
    "rating": ("rating", "stars"),
    "variant": ("variant",),
}

# Longest stored text per column.
COLUMN_LIMITS = {
    "asin": 20,
    "review_id": 64,
    "review_title": 500,
    "review_date": 10,
    "reviewer_name": 255,
    "variant": 255,
    "domain": 64,
    "canonical_product_url": 255,
}


# The columns of a product's latest reviews.
LATEST_COLUMNS = ("review_id", "review_date", "rating", "title", "body")
