"""Default rule data for Danish and German wartime letters.

Fixed values: word lists and patterns that results depend on. Every operator
takes them as parameters, so other collections bring their own.
"""

# Words after which a full stop does not end a sentence.
ABBREVIATIONS = (
    "Kl", "kl", "St", "Hr", "Fr", "Dr", "Nr", "Pr", "J", "Chr", "H", "C", "P", "M", "N", "A",
    "L", "T", "S", "E", "K", "Kilom", "kilom", "Feldw", "feldw", "Regt", "regt", "ca", "evt",
    "bl", "div", "osv", "dvs", "d", "f", "m",
)
SENTENCE_START = "A-ZÆØÅ"

# Greeting and closing formulas, as search patterns.
FORMULAIC = (
    r"(?iU)^(min (egen )?)?kære\b",
    r"(?iU)^min lille\b",
    r"(?U)^M\.M[.!]?$",
    r"(?iU)^lieber \w+",
    r"(?iU)^(mange )?(kærlige )?(hilsener|hilsen)\b",
    r"(?iU)^med (mange )?(kærlige )?(hilsener|hilsen)\b",
    r"(?U)^[Dd]in (egen )?\w+$",
    r"(?U)^[Jj]eres \w+$",
    r"(?U)^[Ee]ders \w+$",
    r"^Peter$",
    r"^Trine$",
)

# Marker lexicons.
MARKERS = {
    "first_person_singular": ("jeg", "mig", "min", "mit", "mine"),
    "first_person_plural": ("vi", "os", "vores", "vor", "vort"),
    "hedging": ("vist", "måske", "vel", "nok"),
    "absolutist": (
        "altid", "aldrig", "alt", "intet", "helt", "fuldstændig", "alle", "ingen", "enhver",
    ),
    "cognitive": (
        "fordi", "grund", "forstå", "forstår", "indse", "indser", "tænke", "tænker", "mene",
        "mener", "derfor", "årsag",
    ),
    "sensory": (
        "se", "ser", "så", "hører", "høre", "hørte", "føle", "føler", "følte", "lugte",
        "lugter", "smage", "smager",
    ),
}
REASSURANCE = (
    r"(?iU)\balt\s+vel\b",
    r"(?iU)\bdet\s+går\s+godt\b",
    r"(?iU)\bI\s+skal\s+ikke\s+bekymre\b",
    r"(?iU)\bjeg\s+har\s+det\s+godt\b",
    r"(?iU)\bellers\s+alt\s+vel\b",
    r"(?iU)\balt\s+er\s+godt\b",
    r"(?iU)\bjeg\s+er\s+rask\b",
    r"(?iU)\bdet\s+går\s+mig\s+godt\b",
)
GERMAN_MILITARY = (
    "feldvebel", "hauptmand", "hauptmann", "gefr", "regt", "unteroffizier", "leutnant",
    "zugführer", "kompagni", "batteri", "gefreiter", "kaserne", "lazarett", "etappe",
    "stellung", "graben", "gewehr", "granate", "geschütz", "munition", "patrone", "appell",
    "wache", "dienst", "urlaub", "marschbefehl", "ordenans", "sanitäter", "verbandplatz",
    "feldpost", "feldpostkarte", "zensur",
)
UMLAUT_FOLD = (("ä", "a"), ("ö", "o"), ("ü", "u"), ("ß", "ss"))

# Words that keep the digraph aa.
AA_PRESERVE = (
    "aalborg", "aarhus", "aaby", "aabenraa", "aarup", "aalestrup", "aadum", "aakirkeby",
)

# Letters folded when place names are compared; æ, ø, å stay.
PLACE_FOLD_FROM = "àáâãäèéêëìíîïòóôõöùúûüýÿñżźśćłęń"
PLACE_FOLD_TO = "aaaaaeeeeiiiiooooouuuuyynzzsclen"
PLACE_FOLD_PAIRS = (("ß", "ss"),)
# Letters folded for slugs, after lower-casing.
SLUG_FOLD_PAIRS = (("æ", "ae"), ("å", "aa"), ("ß", "ss"))
SLUG_FOLD_FROM = "øöäüàáâãèéêëìíîïòóôõùúûýÿñżźśćęńčšžğř"
SLUG_FOLD_TO = "ooauaaaaeeeeiiiioooouuuyynzzscencszgr"

# Characters the text audit reports, with the action to take.
AUDIT_CHARS = (
    ("\u0085", "remove"),
    ("´", "remove_eol"),
    ("á", "review"),
    ("«", "review"),
    ("¥", "review"),
)
# Characters a corrected text may hold, and those only under review.
ALLOWED_CHARS = r"[\x20-\x7E\n\tæøåÆØÅéÉüäöÜÄÖß½¼¾°]"
REVIEW_CHARS = "á«¥"
# Words before "korn" that speak of grain, and words before "lier" that call for another word.
FARMING = ("sæd", "høst", "mark", "rug", "byg", "havre", "hvede", "afgrøde", "kerne", "sæk", "lade")
NOUN_MARKERS = (
    "den", "det", "de", "en", "et", "min", "din", "sin", "vor", "hans", "hendes", "deres", "lille", "store", "gamle",
    "eneste", "første", "sidste",
)
KNOWN_ERRORS = ("Tak Tor", "ude st ", " dia ", " vj ", "love.e")

# Function words that mark a German passage.
GERMAN_FUNCTION_WORDS = (
    "der", "die", "das", "ein", "eine", "und", "ist", "ich", "sie", "er", "wir", "nicht",
    "mit", "auf", "den", "dem", "des", "von", "zu", "im", "an", "am", "bei", "nach", "aus",
    "über", "unter", "vor", "zwischen", "für", "durch", "gegen", "ohne", "um", "wie", "was",
    "aber", "oder", "wenn", "dann", "auch", "noch", "schon", "sehr", "hier", "dort", "jetzt",
    "hat", "haben", "war", "sein", "werden", "kann", "muss", "soll", "will", "doch", "mehr",
    "mir", "mich", "ihm", "ihn", "uns", "man", "habe", "sind", "alle", "dieser", "diese",
    "diesem", "diesen", "dieses",
)

# Audience keyword groups, first group wins.
AUDIENCES = (
    ("trine", ("trine",)),
    ("parents", ("forældre", "mor", "far", "moder", "fader", "hjem")),
)
