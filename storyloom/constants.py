"""Fixed values.

Weights, brackets, word lists, lookup tables and text patterns that must have
exactly these values for results to be right.  No logic lives here.
"""

# --- fixed values: final feed score weights -------------------------------
WEIGHT_IMPORTANCE = 0.40
WEIGHT_URGENCY = 0.20
WEIGHT_FRESHNESS = 0.15
WEIGHT_RELEVANCE = 0.15
WEIGHT_VERIFICATION = 0.10

# --- fixed values: importance dimensions and their caps -------------------
DIMENSION_CAPS = {
    "human": 20.0,
    "safety": 20.0,
    "geographic": 15.0,
    "economic": 10.0,
    "policy": 10.0,
    "infrastructure": 10.0,
    "security": 10.0,
    "consequence": 5.0,
}

# --- fixed values: emergency floor and freshness contract -----------------
EMERGENCY_URGENCY = 90.0
EMERGENCY_FLOOR = 75.0
FRESH_THRESHOLD = 25.0
RECENT_THRESHOLD = 10.0
RECENT_DECAY = 0.75
HISTORICAL_DECAY = 0.40
RECENT_URGENCY_CAP = 45.0
HISTORICAL_URGENCY_CAP = 25.0
# (age in minutes, inclusive upper bound; score)
FRESHNESS_BRACKETS = [
    (15, 100.0), (30, 95.0), (60, 90.0), (120, 80.0), (240, 70.0),
    (480, 55.0), (720, 40.0), (1440, 25.0), (2880, 10.0),
]
FRESHNESS_OLDEST = 5.0
FRESHNESS_UNKNOWN = 25.0

# --- fixed values: relevance ----------------------------------------------
LOCATION_DISTRICT = 50.0
LOCATION_STATE = 40.0
LOCATION_NATIONAL = 25.0
LOCATION_GLOBAL = 15.0
INTEREST_TOP = 50.0
INTEREST_STEP = 5.0
INTEREST_MINIMUM = 20.0
INTEREST_UNRANKED = 25.0

# --- fixed values: publisher tiers (substring tests on the lower name) ----
SCORING_TIER_1 = [
    "bbc news", "bbc", "the new york times", "reuters", "associated press",
    "ap news", "the hindu", "the times of india", "the indian express",
    "ndtv", "bloomberg", "press trust of india", "pti", "newsonair.gov.in",
    "wion news", "wion",
]
SCORING_TIER_2 = [
    "hindustan times", "india today", "the print", "the quint", "telegraph india",
    "deccan herald", "financial express", "economic times", "livemint",
    "business standard", "tribune india", "telangana today", "sakshi",
]
CRAWL_TIER_1 = [
    "bbc news", "bbc", "the new york times", "the hindu", "the times of india",
    "the indian express", "ndtv", "reuters", "associated press", "ap news",
    "bloomberg", "newsonair.gov.in", "press trust of india", "pti",
]

# --- fixed values: tracking parameters dropped from URLs ------------------
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "ref", "ocid", "ncid", "igshid", "msclkid",
]

# --- fixed values: stopwords of the keyword extractors --------------------
# Entries with an apostrophe can never equal an [a-z0-9]{3,} keyword and are
# left out.
WORKER_STOPWORDS = (
    "a about above after again against all am an and any are as at be because been "
    "before being below between both but by cannot could did do does doing down during "
    "each few for from further had has have having he her here hers herself him himself "
    "his how i if in into is it its itself me more most my myself no nor not of off on "
    "once only or other ought our ours ourselves out over own same she should so some "
    "such than that the their theirs them themselves then there these they this those "
    "through to too under until up very was we were what when where which while who whom "
    "why with would you your yours yourself yourselves says said new news will"
).split()
CRAWL_STOPWORDS = (
    "a about above after again against all am an and any are as at be because been "
    "before being below between both but by cannot could did do does doing down during "
    "each few for from further had has have having he her here hers him his how i if in "
    "into is it its me more most my no nor not of off on once only or other ought our "
    "out over own same she should so some such than that the their them then there these "
    "they this those through to too under until up very was we were what when where "
    "which while who whom why with would you your says said news will"
).split()

# --- fixed values: impact terms -------------------------------------------
WORKER_IMPACT_TERMS = ["dies", "resigns", "law passed", "election", "market crash", "emergency"]
CRAWL_IMPACT_TERMS = [
    "emergency", "dies", "died", "killed", "kill", "dead", "death", "resigns",
    "resignation", "law passed", "bill passed", "election", "market crash",
    "summit", "brics", "strike", "budget", "war", "crisis", "disaster", "flood",
    "earthquake", "cabinet", "court", "probe", "arrest", "scam",
]

# --- fixed values: token sets of the quality gate -------------------------
BANNED_OPINION = [
    "shocking", "devastating", "slammed", "blasted", "hero", "disaster",
    "outrageous", "appalling", "miracle", "chaotic",
]
SENSITIVITY = [
    "killed", "death", "deaths", "dead", "riot", "unrest", "massacre", "outbreak",
    "epidemic", "election", "elections", "suicide", "explosion", "bomb",
]
VISUAL_SENSITIVE = [
    "kill", "dead", "death", "died", "toll", "collapse", "tragedy", "murder",
    "blast", "bomb", "casualt", "victim", "drown", "fire", "accident", "suicide",
    "shooting", "funeral", "grief",
]
QUALITY_LIMITS = {"words": (180, 260), "sentences": (7, 20), "grade": (5.0, 10.0)}

# --- fixed values: categories ---------------------------------------------
CANONICAL_CATEGORY = {
    "tech": "Technology", "technology": "Technology",
    "international": "World", "intl": "World", "world": "World",
    "world news": "World", "global": "World",
    "politics": "Politics",
    "business": "Business", "economy": "Business",
    "national": "National", "india": "National",
    "science": "Science", "health": "Health", "sports": "Sports",
    "entertainment": "Entertainment",
    "environment": "Environment", "climate": "Environment",
    "state": "State", "education": "Education",
}
PRIMARY_CATEGORIES = [
    "Technology", "Politics", "Business", "National", "World",
    "Science", "Health", "Sports", "Entertainment", "Environment",
]
FEED_SYNONYMS = {
    "tech": ["tech", "technology"],
    "technology": ["tech", "technology"],
    "international": ["international", "world", "global"],
    "world": ["world", "international", "global"],
    "global": ["world", "international", "global"],
    "national": ["national", "india", "politics", "political"],
    "politics": ["politics", "political", "national", "governance", "policy", "india"],
    "business": ["business", "economy", "finance"],
    "science": ["science", "space"],
    "health": ["health", "medical"],
    "sports": ["sports", "sport"],
    "entertainment": ["entertainment", "cinema", "movies", "culture"],
    "environment": ["environment", "climate", "nature"],
    "state": ["state", "regional"],
    "education": ["education"],
}
CLIENT_SYNONYMS = {
    "tech": ["tech", "technology"],
    "technology": ["tech", "technology"],
    "world": ["world", "international", "global"],
    "international": ["world", "international", "global"],
    "global": ["world", "international", "global"],
    "national": ["national", "india"],
    "state": ["state", "regional"],
    "politics": ["politics", "political"],
    "business": ["business", "economy", "finance"],
    "science": ["science", "space"],
    "health": ["health", "medical"],
    "sports": ["sports", "sport"],
    "entertainment": ["entertainment", "cinema", "movies", "culture"],
    "environment": ["environment", "climate", "nature"],
    "education": ["education", "learning", "academics"],
}
TITLE_CATEGORY_TERMS = [
    ("technology", ["anthropic", "ai ", "tech", "cyber", "software"]),
    ("business", ["currency", "market", "economy", "bank", "trade"]),
    ("politics", ["court", "high court", "minister", "parliament", "brics", "modi"]),
    ("disaster", ["flood", "accident", "killed", "collision", "deaths", "cyclone"]),
]
TITLE_CATEGORY_KEPT = [
    "national", "state", "business", "technology", "politics",
    "science", "health", "sports", "entertainment",
]
CONTENT_TYPES = ["NEWS", "NEWSLETTER", "PROMOTIONAL", "OPINION", "PRESS_RELEASE", "ANALYSIS", "UNKNOWN"]
PUBLIC_CREATORS = ["live_pipeline", "authentic_ingested", "website_scraping_bot", "editorially_created"]

# --- fixed values: states and union territories ---------------------------
STATES = [
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh",
    "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka",
    "Kerala", "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya",
    "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan", "Sikkim",
    "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand",
    "West Bengal",
]
UNION_TERRITORIES = [
    "Andaman and Nicobar Islands", "Chandigarh",
    "Dadra and Nagar Haveli and Daman and Diu", "Delhi", "Jammu and Kashmir",
    "Ladakh", "Lakshadweep", "Puducherry",
]

# --- fixed values: places that name a state (each state's own name counts as well) ---
PLACES = """
Andhra Pradesh: amaravati, visakhapatnam, vizag, vijayawada, tirupati, guntur, kurnool, nellore
Arunachal Pradesh: itanagar, tawang, pasighat, ziro
Assam: guwahati, dispur, dibrugarh, silchar, jorhat, kaziranga, brahmaputra
Bihar: patna, gaya, bhagalpur, muzaffarpur, darbhanga, purnia, nalanda
Chhattisgarh: raipur, bilaspur, durg, bhilai, bastar, korba
Goa: panaji, panjim, margao, vasco da gama, calangute
Gujarat: gandhinagar, ahmedabad, surat, vadodara, baroda, rajkot, bhavnagar, jamnagar, kutch
Haryana: gurugram, gurgaon, faridabad, panipat, ambala, rohtak, karnal, hisar
Himachal Pradesh: shimla, dharamshala, manali, kullu, mandi, solan, spiti
Jharkhand: ranchi, jamshedpur, dhanbad, bokaro, deoghar, hazaribagh
Karnataka: bengaluru, bangalore, mysuru, mysore, hubballi, mangaluru, mangalore, belagavi
Kerala: thiruvananthapuram, trivandrum, kochi, cochin, kozhikode, calicut, thrissur, kannur, wayanad, kollam
Madhya Pradesh: bhopal, indore, gwalior, jabalpur, ujjain, rewa
Maharashtra: mumbai, pune, nagpur, nashik, thane, aurangabad, sambhajinagar, solapur, kolhapur
Manipur: imphal, churachandpur, kangpokpi, bishnupur
Meghalaya: shillong, tura, cherrapunji, sohra
Mizoram: aizawl, lunglei, champhai
Nagaland: kohima, dimapur, mokokchung
Odisha: orissa, bhubaneswar, cuttack, rourkela, puri, sambalpur, balasore
Punjab: amritsar, ludhiana, jalandhar, patiala, bathinda, mohali
Rajasthan: jaipur, jodhpur, udaipur, kota, ajmer, bikaner, jaisalmer, alwar
Sikkim: gangtok, namchi, pelling
Tamil Nadu: chennai, madras, coimbatore, madurai, tiruchirappalli, trichy, salem, tirunelveli
Telangana: hyderabad, secunderabad, warangal, nizamabad, karimnagar, khammam, revanth
Tripura: agartala, dharmanagar
Uttar Pradesh: lucknow, kanpur, varanasi, kashi, prayagraj, allahabad, noida, greater noida, agra, meerut, ayodhya, gorakhpur, bareilly, mathura
Uttarakhand: dehradun, haridwar, rishikesh, nainital, kedarnath, badrinath, roorkee
West Bengal: kolkata, calcutta, howrah, durgapur, siliguri, asansol, darjeeling
Andaman and Nicobar Islands: andaman, nicobar, port blair
Chandigarh:
Dadra and Nagar Haveli and Daman and Diu: dadra, nagar haveli, daman, diu, silvassa
Delhi: new delhi, ncr, chawri bazar, connaught place, dwarka, rohini
Jammu and Kashmir: jammu & kashmir, j&k, srinagar, jammu, anantnag, baramulla, kashmir
Ladakh: leh, kargil
Lakshadweep: kavaratti
Puducherry: pondicherry, karaikal, mahe, yanam
"""

# --- fixed values: sentences of live summaries ---
LIVE_ACROSS = "According to verified reports across %s, %s."
LIVE_FURTHER = " Further developments reported that %s."
LIVE_DOSSIER = "Verified reporting dispatched by %s. Comprehensive background and wire telemetry are documented in the source dossier."
LIVE_CORROBORATED = "Corroborated across: %s"
LIVE_REGIONAL = "Reported from regional bureaus across %s by %s."
LIVE_PLAIN = "Verified news report dispatched by %s. Review the source dossier for complete reporting details."

# --- fixed values: nodes of article pages, (tag, attribute, value), in order of preference ---
CONTENT_NODES = [
    ("div", "id", "PdfDiv"),
    ("div", "class", "innner-page-main-about-us-content-right-part"),
    ("div", "class", "ReleaseContent"),
    ("div", "id", "ReleaseContent"),
    ("article", None, ""),
    ("body", None, ""),
]
PARAGRAPH_NODES = [("div", "class", "article-content"), ("div", "class", "content"), ("article", None, "")]
PAGE_AUTHOR = "WION Web Team"
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]

# --- fixed values: boilerplate and low-value phrases ----------------------
FEED_BOILERPLATE = [
    "In a significant development, primary news reports",
    "Technical committees and administrative task forces",
    "supervisory delegations will continue reviewing",
]
PURGE_BOILERPLATE = [
    "In a significant development",
    "The dispatch highlights key operational developments",
    "Technical committees and administrative task forces",
]
LOW_VALUE_LIVE = [
    "quordle hint", "wordle hint", "connections hint", "strands hint",
    "daily clue", "clues and answers", "horoscope today", "daily horoscope",
    "today's tarot", "crossword clue", "word puzzle",
]
LOW_VALUE_CRAWL = LOW_VALUE_LIVE + ["answers today", "hints and answers"]
WIRE_MARKERS = ["(pti)", "(ani)", "(reuters)", "press trust of india", "asian news international"]

# --- fixed values: plain-language rewrites (case-insensitive) -------------
PLAIN_REWRITES = [
    ("In a significant development|primary news reports|confirm that key public officials",
     "Official reports show"),
    ("administrative, economic, and policy considerations", "practical and daily issues"),
    ("operational benchmarks|regulatory compliance", "safety standards and protocols"),
    ("stakeholders and community members", "citizens and local communities"),
]

# --- fixed values: text patterns ------------------------------------------
PAYWALL_PATTERNS = [
    r"ONLY\s+AVAILABLE\s+IN\s+PAID\s+PLANS.*",
    r"Subscribe\s+now\s+to\s+read.*",
    r"You\s+don['’]t\s+have\s+any\s+Active\s+Subscription.*",
]
SUMMARY_PUBLISHERS = (
    "NBC News|BBC News|BBC|Reuters|CNN|The Hindu|Times of India|NDTV News|NDTV|Livemint|The Economic Times"
)
SHORT_SUMMARY_TEXT = (
    "Read the verified journalistic reporting and full timeline developments in the dossier below."
)
WIRE_AGENCIES = "Reuters|PTI|AP|Associated Press|ANI|IANS|AFP|Bloomberg"
LIFESTYLE = r"\b(museum|painting|exhibition|art gallery|celebrity|actor spotted|fashion show|red carpet)\b"
LIFESTYLE_CAP = 30.0

# --- fixed values: number words -------------------------------------------
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
}

# --- fixed values: casualty patterns, tried in order (group 1 = count) ----
_VICTIMS = r"(?:people\s+|residents\s+|civilians\s+|passengers\s+|children\s+)?"
CASUALTY_NUMBER_PATTERNS = [
    r"\bclaim(?:s|ed)?\s+(?:at least\s+)?([0-9,]+)\s+lives\b",
    r"\bdeath toll\s+(?:of|at|rises to|reaches|hits|stood at|climbs to)\s+(?:at least\s+)?([0-9,]+)\b",
    r"\bat least\s+([0-9,]+)\s+" + _VICTIMS + r"(?:have died|died|dead|killed|fatalities|deaths)\b",
    r"\b([0-9,]+)\s+" + _VICTIMS
    + r"(?:have died|died|dead|killed|fatalities|deaths|lives lost|lost their lives)\b",
]
CASUALTY_WORD_PATTERNS = [
    r"\b(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|"
    r"sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty)\s+" + _VICTIMS
    + r"(?:have died|died|dead|killed|fatalities|deaths|lives lost)\b",
    r"\bclaim(?:s|ed)?\s+(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+lives\b",
]

# --- fixed values: context patterns ---------------------------------------
NOTABLE_PERSON = r"\b(actor|actress|star|singer|director|celebrity|author|aged \d+|at \d+)\b"
MASS_HARM = r"\b(thousands|hundreds|mass|displaced|injured|toll hits|killed in)\b"
ISOLATED = (
    r"\b(car (hit|crash|accident)|bike accident|motorcycle|scooter|auto-rickshaw|"
    r"truck (hit|collided|overturned)|bus collided|hit-and-run|pedestrian (hit|killed)|"
    r"road accident|traffic mishap|suicide|local crime|theft|murder suspect arrested|"
    r"stabbed in fight|body found|fatal accident)\b"
)
WIDE_HARM = (
    r"\b(flood|cyclone|earthquake|tsunami|landslide|avalanche|evacuat|chemical spill|"
    r"toxic|terror attack|mass casualty|dozens|hundreds|thousands|train derailment|plane crash)\b"
)

# --- fixed values: importance ladders, (pattern, score, evidence) ---------
HUMAN_LADDER = [
    (r"\b(millions|mass casualty|tens of thousands displaced)\b", 20.0,
     "Millions or massive population affected"),
    (r"\b(thousands displaced|thousands affected|thousands injured|hundreds dead|hundreds killed|"
     r"toll hits \d{2,}|mandatory evacuation|evacuation order)\b", 16.0,
     "Thousands directly displaced/injured, hundreds dead, or mandatory evacuation"),
    (r"\b(\d{2,}\s+(killed|dead|fatalities|injured)|hundreds affected|hundreds injured|dozens dead)\b", 12.0,
     "Dozens to hundreds of casualties/affected"),
    (r"\b(emergency room diversions|patient monitoring offline|surgeries canceled|vulnerable population|"
     r"hospital.*diversion)\b", 12.0,
     "Critical healthcare disruption directly jeopardizing patient care"),
]
FATAL_ACCIDENT = r"\b(crash|accident killed)\b"
SAFETY_LADDER = [
    (r"\b(cyclone|earthquake|tsunami|flash flood|major flood|flooding|evacuat|landslide|toxic leak|"
     r"chemical spill|toxic plume|state of emergency|emergency declared|air pollution|aqi severe|grap stage)\b",
     18.0, "Active natural disaster or life safety threat"),
    (r"\b(epidemic|disease outbreak|virus outbreak|fire breaks out|building collapse|terror attack|strike on|"
     r"emergency room diversion|ambulances diverted|patient.*offline)\b", 15.0,
     "Serious acute danger to public life/safety"),
    (r"\b(warning issued|alert sounded|precautionary advisory|storm alert)\b", 10.0,
     "Official alert or hazard warning in effect"),
]
LOCAL_SAFETY = r"\b(fatal collision|accident|encounter|arrested under sc/st)\b"
GEOGRAPHIC_LADDER = [
    (r"\b(global|international|world|nepal|cross-border|foreign|un security council|brics summit|unsc|"
     r"multilateral|nato)\b", ["international"], 14.0, "International or multi-country scope"),
    (r"\b(nationwide|across india|union cabinet|parliament|prime minister|supreme court)\b",
     ["national"], 11.0, "National scale scope"),
    (r"\b(statewide|high court|chief minister|assembly|across the state|metropolitan)\b",
     ["state"], 8.0, "Statewide or metropolitan administrative scale"),
    (r"\b(district|city|municipal|panchayat|ward)\b", ["district", "local"], 5.0,
     "District or city level impact"),
]
ECONOMIC_LADDER = [
    (r"\b(market crash|sensex plunges|recession|gdp contracted|sanctions imposed|bank collapse|tariff war)\b",
     9.0, "Critical macro financial disruption"),
    (r"\b(union budget|interest rate|repo rate|inflation surges|tax bill|trade agreement|currency settlement|"
     r"liquidity boost|food supply|commodity prices)\b", 7.0, "Major national economic or trade policy"),
    (r"\b(derailment|chemical spill|toxic plume|hazardous waste|factory explosion|building collapse)\b", 5.0,
     "Major industrial or disaster damage"),
]
BUSINESS_ROUTINE = r"\b(ipo opens|stock exchange|quarterly profit|revenue up|investment deal)\b"
POLICY_LADDER = [
    (r"\b(law passed|bill enacted|constitutional amendment|general election|ordinance promulgated)\b", 10.0,
     "Statutory enactment or major election"),
    (r"\b(cabinet approves|policy unveiled|statutory framework|supreme court rules|high court refuses|"
     r"treaty signed)\b", 7.0, "Executive approval, treaty, or high court ruling"),
    (r"\b(assembly session|mlas suspended|protest march|party demands)\b", 3.0,
     "Legislative debate or political positioning"),
]
INFRASTRUCTURE_LADDER = [
    (r"\b(power grid|airports shut|flights grounded|railways halted|hospital.*(shut|paralyz|halt|network)|"
     r"water supply cut|healthcare.*system|banking network|payment gateways?|building collapse)\b", 9.0,
     "Severe disruption to critical utilities, buildings, healthcare, or transit"),
    (r"\b(train derailment|derailment|metro services delayed|train collision|highway blocked|telecom outage)\b",
     8.0, "Major transport corridor severance or train derailment"),
    (r"\b(pipeline maintenance|traffic diversion|road repairs)\b", 2.0, "Minor routine maintenance"),
]
CYBER = r"\b(cyberattack|ransomware|data breach|critical infrastructure hack|malware|ddos grid)\b"
CYBER_ESSENTIAL = r"\b(hospital|health.*network|defense|power grid|bank|banking)\b"
SECURITY_LADDER = [
    (r"\b(terrorist encounter|militant neutralized|weapons recovered|ied blast|cross-border firing)\b", 8.0,
     "National security counter-terror operation"),
    (r"\b(poacher trap|theft arrested|contraband seized)\b", 3.0, "Routine criminal law enforcement"),
]
CONSEQUENCE_LADDER = [
    (r"\b(decade-long|generational|historic treaty|war declared|permanent shift|law will change)\b", 5.0,
     "Multi-year or permanent structural change"),
    (r"\b(bilateral pact|reconstruction|new declaration|summit outcome)\b", 3.0,
     "Medium-term geopolitical or economic impact"),
]
NO_EVIDENCE = {
    "human": "No mass casualty or displacement reported",
    "safety": "No immediate physical safety threat",
    "geographic": "Localized or unverified scope",
    "economic": "No significant economic consequence",
    "policy": "No major legislative or executive policy shift",
    "infrastructure": "No public infrastructure failure",
    "security": "No major security or cyber emergency",
    "consequence": "Transient news cycle item",
}

# --- fixed values: urgency ------------------------------------------------
EVACUATION = r"\b(?:(?:mandatory |immediate )?evacuat(?:e|ion|ing|ions))\b"
EVACUATION_EXCLUDED = r"(?!\s+(?:protocols?|agreements?|frameworks?|drills?|plans?\b))"
EMERGENCY_NOW = (
    r"\b(take shelter|red alert|danger level|curfew imposed|do not travel|immediate danger|"
    r"emergency diversions? in effect|emergency declared|declared an emergency|state of emergency|"
    r"flash floods?|severe flooding|massive flooding|dam breach|cyclone warning|toxic plume)\b"
)
CRISIS = (
    r"\b(search and rescue|toll expected to rise|firefighters battling|active shooter|hostage|"
    r"developing crisis|death toll rises|emergency room diversions?|ambulances diverted)\b"
)
ANNOUNCED_TODAY = (
    r"\b(today|hours ago|just in|breaking|approves|announces new|verdict delivered|signed agreement)\b"
)
PROCEDURE = r"\b(investigation ongoing|probe ordered|review scheduled|trial continues|monitored|committee)\b"
RETROSPECTIVE = (
    r"\b(years ago|anniversary|reminisces|historic lookback|op-ed|editorial|opinion|review of)\b"
)
URGENCY_TEXT = {
    95.0: "Immediate public action or safety precaution required right now",
    82.0: "Critical situation currently unfolding with active emergency response",
    60.0: "Significant real-time announcement or confirmed today",
    40.0: "Ongoing institutional procedure under official monitoring",
    15.0: "Retrospective analysis, feature, or commentary",
}
URGENCY_ISOLATED = "Isolated local incident under routine handling"
URGENCY_ISOLATED_EXTERNAL = "Isolated local incident; urgency adjusted to routine level"
URGENCY_EXTERNAL = "Assessed based on live situational development"
URGENCY_STANDARD = "Standard informational news update"

# --- fixed values: publisher entities, (key, name parts, exact names, URL parts)
PUBLISHER_RULES = [
    ("the_hindu", ["hindu"], [], ["thehindu.com"]),
    ("bbc", ["bbc"], [], ["bbci.co.uk", "bbc.com"]),
    ("times_of_india", ["times of india"], ["toi"], ["indiatimes.com"]),
    ("hindustan_times", ["hindustan times"], [], ["hindustantimes.com"]),
    ("indian_express", ["indian express"], [], ["indianexpress.com"]),
    ("ndtv", ["ndtv"], [], ["ndtv.com"]),
    ("reuters", ["reuters"], [], ["reuters.com", "reutersagency.com"]),
    ("associated_press", ["associated press", "ap news"], ["ap"], ["apnews.com"]),
    ("wire_pti", ["press trust of india"], ["pti"], []),
    ("wire_ani", ["asian news international"], ["ani"], []),
    ("the_guardian", ["guardian"], [], ["theguardian.com"]),
    ("amar_ujala", ["amar ujala"], [], ["amarujala.com"]),
    ("oneindia", ["oneindia"], [], ["oneindia.com"]),
    ("techcrunch", ["techcrunch"], [], ["techcrunch.com"]),
    ("the_verge", ["the verge"], [], ["theverge.com"]),
    ("nature", ["nature"], [], ["nature.com"]),
    ("sciencedaily", ["sciencedaily"], [], ["sciencedaily.com"]),
]
SCORING_PUBLISHER_RULES = [
    ("the_hindu", ["hindu"], [], ["thehindu.com"]),
    ("bbc", ["bbc"], [], ["bbc.com", "bbci.co.uk"]),
    ("times_of_india", ["times of india"], ["toi"], ["indiatimes.com"]),
    ("hindustan_times", ["hindustan times"], [], ["hindustantimes.com"]),
    ("indian_express", ["indian express"], [], ["indianexpress.com"]),
    ("ndtv", ["ndtv"], [], ["ndtv.com"]),
    ("reuters", ["reuters"], [], ["reuters.com"]),
    ("associated_press", ["associated press"], ["ap"], ["apnews.com"]),
    ("the_guardian", ["guardian"], [], ["theguardian.com"]),
]
UNRESOLVED_ENTITIES = ["unresolved", "unknown", "aggregator_unresolved"]
SENTINEL_SOURCE_ID = "00000000-0000-0000-0000-000000000000"

# --- fixed values: stock-photo query rules --------------------------------
VISUAL_TOPICS = [
    (["ai", "openai", "microsoft", "tech"], "artificial intelligence technology"),
    (["plane", "aircraft", "airport"], "airplane runway airport"),
    (["france", "modi", "diplomacy"], "paris diplomacy international relations"),
    (["temple"], "architecture monument temple"),
    (["parliament", "assembly", "politics", "election"], "government politics assembly"),
    (["court", "sue", "lawsuit"], "courtroom law justice"),
    (["space", "isro", "moon"], "space rocket astronomy"),
]
VISUAL_CATEGORIES = {
    "tech": "modern technology digital",
    "science": "science research laboratory",
    "national": "india city architecture",
    "international": "world globe international",
    "state": "india landscape city",
    "district": "indian city street",
}
VISUAL_DEFAULT = "editorial modern news"

# --- fixed values: trending stopwords -------------------------------------
TREND_STOPWORDS = (
    "the a an in on at to for of and or is are was were has have had been will with from by as it "
    "this that its says said new after over into amid ahead under news india indian verified report "
    "reports day days today more about state government police court case high delhi center first "
    "two three years time"
).split()

# --- fixed values: daily request budgets ----------------------------------
DAILY_BUDGETS = {"currents_api": 250, "newsdata_api": 200}

# --- fixed values: client ranking points ----------------------------------
RECENCY_POINTS = [(1, 120), (3, 115), (6, 110), (12, 100), (24, 90), (48, 50), (168, 20)]
PRIORITY_POINTS = [35, 25, 15, 10]
