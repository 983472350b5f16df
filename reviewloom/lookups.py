"""Lookup values and defaults. All of them are parameters of the operators."""

# Place name -> country label. The order of the groups and of the
# names in them decides which name wins when several occur in a location.
CITY_COUNTRY = [
    ("USA", [
        "new york", "los angeles", "chicago", "san diego", "boston", "san francisco",
        "houston", "phoenix", "philadelphia", "dallas", "seattle", "denver",
        "atlanta", "miami", "minneapolis", "portland", "nashville", "charlotte",
        "austin", "las vegas", "washington", "dc", "new orleans", "kansas city",
        "pittsburgh", "cleveland", "baltimore", "columbus", "indianapolis", "memphis",
        "connecticut", "texas", "california", "florida", "new jersey", "ohio",
        "massachusetts", "illinois", "georgia",
    ]),
    ("UK", [
        "london", "manchester", "edinburgh", "birmingham", "glasgow", "liverpool",
        "bristol", "leeds", "sheffield", "newcastle", "oxford", "cambridge",
        "cardiff", "belfast", "nottingham", "leicester", "coventry", "bradford",
    ]),
    ("Australia", [
        "sydney", "melbourne", "brisbane", "perth", "adelaide", "gold coast",
        "canberra", "darwin", "hobart",
    ]),
    ("Canada", [
        "toronto", "vancouver", "montreal", "calgary", "edmonton", "ottawa",
        "winnipeg", "quebec", "halifax",
    ]),
    ("Germany", [
        "berlin", "munich", "hamburg", "cologne", "frankfurt", "stuttgart",
        "dusseldorf", "dortmund", "essen", "leipzig", "bremen", "dresden",
        "hannover", "nuremberg", "münchen", "köln", "düsseldorf",
    ]),
    ("France", [
        "paris", "lyon", "marseille", "toulouse", "nice", "nantes",
        "strasbourg", "bordeaux", "lille",
    ]),
    ("Netherlands", [
        "amsterdam", "rotterdam", "the hague", "utrecht", "eindhoven", "den haag",
    ]),
    ("Italy", [
        "rome", "milan", "naples", "turin", "palermo", "genoa",
        "bologna", "florence", "venice", "verona", "como", "bergamo",
        "brescia", "milano", "roma", "firenze", "venezia",
    ]),
    ("Other", [
        "zurich", "geneva", "bern", "vienna", "brussels", "stockholm",
        "oslo", "copenhagen", "helsinki", "madrid", "barcelona", "lisbon",
        "dublin", "warsaw", "prague", "budapest", "athens", "tokyo",
        "beijing", "shanghai", "hong kong", "singapore", "dubai", "johannesburg",
        "cape town", "são paulo", "buenos aires", "mexico city", "new zealand", "auckland",
    ]),
]

# US state codes.
STATE_CODES = [
    "ny", "ca", "tx", "fl", "il", "pa", "oh", "ga", "nc", "mi", "nj", "va", "wa", "az",
    "ma", "tn", "in", "mo", "md", "wi", "mn", "co", "al", "sc", "la", "ky", "or", "ok",
    "ct", "ut", "nv", "ia", "ms", "ar", "ks", "ne", "id", "nm", "wv", "nh", "me", "ri",
    "de", "sd", "nd", "ak", "vt", "wy", "mt", "hi",
]

# Occasion -> keywords, first group with a hit wins.
OCCASION_KEYWORDS = [
    ("honeymoon", ["honeymoon", "honey moon", "just married", "newlywed", "newly wed"]),
    ("anniversary", ["anniversary", "wedding anniversary", "years together", "years married"]),
    ("birthday", [
        "birthday", "birthday present", "birthday gift", "celebrate a birthday",
        "birthday treat", "birthday trip", "my birthday", "her birthday", "his birthday",
    ]),
    ("family", [
        "family", "kids", "children", "our family", "my kids", "my daughter",
        "my son", "grandchildren", "grandkids", "with my mom", "with my dad",
        "family trip", "family vacation", "family holiday",
    ]),
    ("hen_party", [
        "hen party", "bachelorette", "hen do", "girls trip", "girl trip",
        "girls weekend", "hen night", "stagette",
    ]),
    ("solo", [
        "solo trip", "by myself", "traveling alone", "travelling alone",
        "solo traveler", "solo traveller", "on my own", "just me",
    ]),
    ("friends", [
        "my friends", "group of friends", "friends trip", "with friends",
        "girlfriends", "boyfriend", "girlfriend",
    ]),
    ("business", ["corporate", "team building", "business trip", "work trip", "colleagues"]),
]

# Month spellings.
MONTHS = {
    "january": "01", "february": "02", "march": "03", "april": "04",
    "may": "05", "june": "06", "july": "07", "august": "08",
    "september": "09", "october": "10", "november": "11", "december": "12",
    "jan": "01", "feb": "02", "mar": "03", "apr": "04",
    "jun": "06", "jul": "07", "aug": "08", "sep": "09",
    "oct": "10", "nov": "11", "dec": "12",
}

# Language codes that keep a label of their own.
LANGUAGE_LABELS = {"en": "EN", "it": "IT", "de": "DE", "fr": "FR", "es": "ES", "nl": "NL"}

# Words in the title of a page that was refused.
BLOCKED_TITLE_WORDS = ["access denied", "captcha", "robot", "blocked"]

# Default stop words: Spark's English list without the entries that hold an
# apostrophe or one letter, which can never equal a phrase token.
STOP_WORDS = (
    "me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very can will just don should now cannot could ought would"
).split()

LONG_REVIEW_WORDS = 20
MIN_WORDS = 5
MIN_WORDS_FREE_TEXT = 10
TOP_LABELS = 20
TOP_PHRASES = 50
