"""Word lists, sentences, label maps and thresholds.

Everything in this file is a fixed value that results depend on. Nothing
here is computed from data.
"""

# Topics that end the decision at the first gate.
NON_POLITICAL_KEYWORDS = [
    "weather", "temperature", "rain", "rainfall", "humidity", "forecast", "heatwave",
    "cold wave", "monsoon", "cyclone",
    "cricket", "ipl", "football", "fifa", "olympics", "match", "tournament", "series",
    "league", "player", "coach", "goal", "score",
    "movie", "film", "cinema", "actor", "actress", "box office", "trailer", "ott",
    "web series",
    "health", "fitness", "diet", "lifestyle", "yoga", "hospital", "doctor", "disease",
    "traffic", "road", "metro", "railway", "train", "airport", "flight", "school", "college",
    "technology", "mobile", "smartphone", "launch", "review", "features",
    "tourism", "travel",
]

# Topics a headline needs to pass the second gate.
POLITICAL_KEYWORDS = [
    "politics", "political", "governance", "administration", "democracy", "constitution",
    "constitutional", "sovereignty",
    "government", "govt", "central government", "state government", "union government",
    "parliament", "lok sabha", "rajya sabha", "vidhan sabha", "vidhan parishad",
    "supreme court", "high court", "district court", "president", "vice president",
    "prime minister", "chief minister", "governor", "bureaucracy", "ias", "ips", "irs",
    "election commission", "eci", "niti aayog", "cbi", "ed", "income tax department",
    "election", "elections", "poll", "polls", "vote", "voting", "evm", "ballot", "campaign",
    "manifesto", "model code of conduct", "by-election",
    "bjp", "bharatiya janata party", "congress", "indian national congress", "aap",
    "aam aadmi party", "cpi", "cpm", "left front", "tmc", "trinamool congress",
    "samajwadi party", "bahujan samaj party", "dmk", "aiadmk", "shiv sena", "ncp", "rjd",
    "jdu", "ysrcp", "trs", "bjd", "sad",
    "modi", "narendra modi", "rahul gandhi", "sonia gandhi", "priyanka gandhi", "amit shah",
    "yogi adityanath", "arvind kejriwal", "mamata banerjee", "nitish kumar",
    "uddhav thackeray", "mk stalin", "kcr", "naveen patnaik",
    "law", "bill", "act", "ordinance", "policy", "reform", "budget", "tax", "gst",
    "income tax", "privatization", "disinvestment", "inflation", "unemployment", "economy",
    "reservation", "quota", "caste census", "scheduled caste", "scheduled tribe", "obc",
    "minority", "majority", "secularism", "communal", "hindutva", "nationalism",
    "anti-national",
    "protest", "protests", "agitation", "strike", "farmer protest", "farm laws", "andolan",
    "demonstration",
    "defence", "military", "armed forces", "border dispute", "kashmir", "article 370",
    "citizenship", "caa", "nrc", "foreign policy", "diplomacy",
]

# Label ids, in id order.
LABELS = ["Left", "Neutral", "Right"]

# Five source categories to three labels; anything else is Right.
CATEGORY_TO_LABEL = {"Left": "Left", "Left-Center": "Left", "Center": "Neutral"}
OTHER_CATEGORY_LABEL = "Right"

# Hypotheses tested against a headline: (class, sentence).
HYPOTHESES = [
    ("Left", "This text criticizes the government or ruling party."),
    ("Left", "This text demands accountability from people in power."),
    ("Left", "This text highlights failures or corruption of the establishment."),
    ("Left", "This text advocates for social justice, minority rights, or civil liberties."),
    ("Right", "This text supports the government or ruling party."),
    ("Right", "This text promotes nationalism, national pride, or cultural heritage."),
    ("Right", "This text praises government policies or achievements."),
    ("Right", "This text frames opposition or dissent negatively."),
    ("Neutral", "This text is a factual news report without opinion or bias."),
    ("Neutral", "This text describes events objectively without taking sides."),
]

# A lead of the first class over the second below this gap is Neutral.
MARGIN = 0.08

# Confidence when every class score is zero, in label order.
NO_EVIDENCE = [0.33, 0.34, 0.33]

# Reasons given by the gates.
GATE_REASONING = {
    "non_political": "Non-political content (weather, sports, lifestyle, etc.)",
    "neutral_political": "Political topic with no ideological framing detected.",
}

# News sources in priority order: (source, base, category, sections).
SOURCES = [
    ("thewire.in", "https://thewire.in", "Left",
     ["/politics", "/science-technology", "/society"]),
    ("scroll.in", "https://scroll.in", "Left", ["/topic/politics", "/topic/social-issues"]),
    ("thenewsminute.com", "https://www.thenewsminute.com", "Left",
     ["/categories/politics", "/categories/national"]),
    ("caravanmagazine.in", "https://caravanmagazine.in", "Left", ["/", "/politics"]),
    ("thehindu.com", "https://www.thehindu.com", "Left-Center", ["/news", "/news/national"]),
    ("indianexpress.com", "https://indianexpress.com", "Left-Center",
     ["/section/india", "/section/politics"]),
    ("indiatoday.in", "https://www.indiatoday.in", "Center", ["/india", "/politics"]),
    ("aajtak.in", "https://www.aajtak.in", "Center", ["/english", "/news"]),
    ("ndtv.com", "https://www.ndtv.com", "Center-Right", ["/latest", "/india", "/politics"]),
    ("economictimes.indiatimes.com", "https://economictimes.indiatimes.com", "Center-Right",
     ["/policy", "/news/india"]),
    ("timesnownews.com", "https://www.timesnownews.com", "Right", ["/india", "/politics"]),
    ("republicworld.com", "https://www.republicworld.com", "Right",
     ["/national", "/politics"]),
    ("zeenews.india.com", "https://zeenews.india.com", "Right", ["/india", "/politics"]),
    ("news18.com", "https://www.news18.com", "Right", ["/news/india", "/news/politics"]),
]

# Collection sizes.
TARGET_TOTAL = 1500
MIN_PER_SITE = 60
MAX_PAGES_PER_SITE = 30
MAX_QUEUE = 500
MAX_ARTICLE_LINKS = 150
MAX_HOME_LINKS = 300
EXCLUDED_PATHS = ["/video", "/gallery", "/photos", "/tag/", "/author/"]
EXCLUDED_SCHEMES = ["mailto:", "javascript:"]

# Features, split and classifier.
MAX_TERMS = 8000
NGRAM_RANGE = (1, 3)
TEST_FRACTION = 0.2
SEED = 42
MAX_ITERATIONS = 3000

# Models a request may name.
MODELS = ["nli", "bert", "baseline", "lexical"]
DEFAULT_MODEL = "nli"

# English stop words that can occur as a token of two or more word characters.
STOP_WORDS = """
me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did
doing an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very can will just don should now would could
ought cannot
""".split()

# Inside of a character class: Unicode white space.
WHITE_SPACE = (
    r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# The same characters as text.
WHITE_SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
