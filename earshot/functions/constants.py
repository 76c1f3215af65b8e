"""Lists and patterns that decide results, stated as they must be."""

# Fixed value: white space as text input has it, spelled out so that every engine agrees.
BLANK = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# Fixed value: any character but a line end.
IN_LINE = r"[^\n\r\x{2028}\x{2029}]"

# Fixed value: the name that stands for anything absent.
UNKNOWN = "Unknown"

# Band names that contain a separator and stay whole.
PROTECTED_CREDITS = [
    "Earth, Wind & Fire",
    "Tyler, The Creator",
    "Crosby, Stills & Nash",
    "Crosby, Stills, Nash & Young",
    "Blood, Sweat & Tears",
    "Emerson, Lake & Palmer",
    "Peter, Paul and Mary",
]

# Fixed value: what separates the artists of a collaboration credit.
CREDIT_SEPARATOR = (
    rf"(?i){BLANK}*(?:;|,{BLANK}+|{BLANK}+(?:feat\.?|ft\.?|featuring){BLANK}+){BLANK}*"
)

# What a listen title loses before the second library lookup.
LISTEN_TITLE_ROUND = rf"{BLANK}*\({IN_LINE}*?\){BLANK}*"
LISTEN_TITLE_SQUARE = rf"{BLANK}*\[{IN_LINE}*?\]{BLANK}*"
LISTEN_TITLE_FEAT = rf"(?is)\A(.*?){BLANK}*feat\.{IN_LINE}*"

# Bracketed markers a recording title loses; the catalog also knows "4k".
LIBRARY_MARKERS = r"(?i)[\[(](?:official(?: music)?(?: video| audio)?|lyrics?|audio|visualizer)[^\])]*[\])]"
CATALOG_MARKERS = (
    r"(?i)[\[(](?:official(?: music)?(?: video| audio)?|lyrics?|audio|visualizer|4k(?: remaster)?)[^\])]*[\])]"
)

# The guest-artist tail of a recording title; the catalog sees letters of any script as part of a word.
LIBRARY_FEAT_TAIL = (
    rf"(?i){BLANK}*[\[(]?{BLANK}*(?<![A-Za-z0-9_])(?:feat\.?|ft\.?|featuring){BLANK}+{IN_LINE}*\z"
)
CATALOG_FEAT_TAIL = (
    rf"(?i){BLANK}*[\[(]?{BLANK}*(?<![\p{{L}}\p{{N}}_])(?:feat\.?|ft\.?|featuring){BLANK}+{IN_LINE}*\z"
)

# Fixed value: how many characters of a title the containment lookup uses.
FUZZY_PREFIX = 50

# Chart playlists in order of preference.
CHART_TITLES = ["daily top music", "top 100 music", "trending"]

# Hosts (and their subdomains) images may come from.
IMAGE_HOSTS = ["googleusercontent.com", "ggpht.com", "ytimg.com", "dzcdn.net"]

# Fixed value: the countries a chart may be asked for; ZZ is worldwide.
COUNTRIES = (
    "ZZ AR AU AT BE BO BR CA CL CO CR CZ DK DO EC EG SV EE FI FR DE GT HN HK HU IS IN ID IE IL IT JP KE LU MY MX "
    "NL NZ NI NG NO PA PY PE PH PL PT RO RU SA RS SG ZA KR ES SE CH TW TZ TH TR UG UA AE GB US UY VN ZW"
).split()

# Fixed value: how a catalog id looks.
CATALOG_ID = r"\A[A-Za-z0-9_-]{8,100}\z"

# Weekday labels, Sunday first.
DAY_NAMES = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]

# Where catalog songs live and what providers are called.
WATCH_URL = "https://www.youtube.com/watch?v="
EMBED_URL = "https://www.youtube-nocookie.com/embed/"
CHART_URL = "https://music.youtube.com/playlist?list="
CATALOG_PROVIDER = "YouTube Music"
SECOND_PROVIDER = "Spotify"
SECOND_PROVIDER_URL = "https://open.spotify.com/"
