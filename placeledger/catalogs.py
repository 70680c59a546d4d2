"""Word lists, lookup tables, patterns and limits.

Everything here is data that results depend on. Every operator takes these as default arguments, so a caller
can pass other lists. Patterns are written once and used by Spark's regex engine.
"""

# --- fixed values: statuses, sources, categories -------------------------------------------------------------
PUBLIC_STATUSES = ["active", "verified", "candidate"]
STORE_STATUSES = ["candidate", "verified", "active", "unresponsive", "closed"]
STORE_CATEGORIES = ["lgs", "comic_shop", "retro_games", "hobby_miniatures"]
STORED_CATEGORIES = STORE_CATEGORIES + ["riftbound"]
DISCOVERY_SOURCES = [
    "wpn", "google_places", "tcgplayer", "manual", "games_workshop", "comicbookstores",
    "league_comic_geeks", "video_game_sage",
]
WPN_LEVELS = ["core", "premium"]
CHANNEL_TYPES = ["website", "tcgplayer", "ebay", "facebook", "other"]
PLATFORMS = [
    "crystal_commerce", "binderpos", "shopify", "squarespace", "woocommerce", "wordpress_stripe",
    "custom", "unknown",
]
INVENTORY_SIZES = ["none", "small", "medium", "large"]
PRICING_METHODS = ["manual", "synced", "unknown"]
PRESENCE_STATUSES = ["active", "unreachable", "dead"]
CHECK_TYPES = [
    "http_check", "platform_detect", "singles_detect", "closure_detect", "freshness_check",
    "pricing_check", "manual_review", "content_extract",
]
ECOMMERCE_PLATFORMS = [
    "crystal_commerce", "binderpos", "shopify", "squarespace", "woocommerce", "wordpress_stripe",
]
TRUSTED_SOURCES = [
    "wpn", "games_workshop", "comicbookstores", "league_comic_geeks", "video_game_sage", "manual",
]
# (from, to) pairs a store may move between.
STATUS_TRANSITIONS = [
    ("candidate", "verified"),
    ("verified", "active"),
    ("verified", "closed"),
    ("active", "unresponsive"),
    ("active", "closed"),
    ("unresponsive", "active"),
    ("unresponsive", "closed"),
]
DEFAULT_CATEGORIES = {
    "wpn": ["lgs"],
    "google_places": ["lgs"],
    "games_workshop": ["hobby_miniatures"],
    "comicbookstores": ["comic_shop"],
    "league_comic_geeks": ["comic_shop"],
    "video_game_sage": ["retro_games"],
}
PRODUCT_CATEGORIES = {
    "mtg": "lgs",
    "pokemon": "lgs",
    "yugioh": "lgs",
    "fab": "lgs",
    "board_games": "lgs",
    "dnd": "lgs",
    "miniatures": "hobby_miniatures",
    "warhammer": "hobby_miniatures",
    "games workshop": "hobby_miniatures",
    "comics": "comic_shop",
    "comic": "comic_shop",
    "retro": "retro_games",
    "vintage": "retro_games",
    "classic games": "retro_games",
}

# --- fixed values: addresses and names -----------------------------------------------------------------------
STREET_WORDS = {
    "ST": "STREET", "AVE": "AVENUE", "AV": "AVENUE", "BLVD": "BOULEVARD", "DR": "DRIVE", "RD": "ROAD",
    "LN": "LANE", "CT": "COURT", "PL": "PLACE", "CIR": "CIRCLE", "TRL": "TRAIL", "PKWY": "PARKWAY",
    "HWY": "HIGHWAY", "WAY": "WAY", "SQ": "SQUARE", "LOOP": "LOOP", "TER": "TERRACE", "TERR": "TERRACE",
    "PT": "POINT", "ALY": "ALLEY", "PLZ": "PLAZA", "STE": "SUITE", "FLR": "FLOOR",
    "N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST",
    "NE": "NORTHEAST", "NW": "NORTHWEST", "SE": "SOUTHEAST", "SW": "SOUTHWEST",
}
SUITE_PATTERN = (
    r"\b(?:STE|SUITE|UNIT|APT|APARTMENT|#|BLDG|BUILDING|FLOOR|FLR|RM|ROOM)\b\.?\s*\S*"
)
NAME_SUFFIX_WORDS = [
    "LLC", "INC", "INCORPORATED", "CORP", "CORPORATION", "LTD", "CO", "COMPANY",
    "GAMES", "GAMING", "COMICS", "CARDS", "HOBBIES", "HOBBY", "TOYS", "COLLECTIBLES",
]
STATE_CODES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA",
    "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "DISTRICT OF COLUMBIA": "DC",
    "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN",
    "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO",
    "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ",
    "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH",
    "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI",
    "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT",
    "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI",
    "WYOMING": "WY",
}
US_STATE_CODES = sorted(STATE_CODES.values())
GOOGLE_ADDRESS_PATTERN = r"^(.+?),\s*([^,]+),\s*([A-Z]{2})\s+(\d{5}(?:-\d{4})?)"
LEGAL_SUFFIX_PATTERN = (
    r"[,\s]+(l\.?l\.?c\.?|inc\.?|incorporated|corp\.?|corporation|ltd\.?|limited|co\.?|company)\s*$"
)
SLUG_QUOTES = "'‘’‛“”‟\""
MAX_STORE_SLUG = 160
SHORT_ID_LENGTH = 6
UUID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
DISPLAY_ACRONYMS = [
    "MTG", "TCG", "CCG", "RPG", "D&D", "DND", "WH40K", "AOS", "LGS", "FLGS", "FGC", "USA", "US", "NYC",
    "LA", "SF", "DC",
]

# --- fixed values: blocklists --------------------------------------------------------------------------------
INGEST_BLOCKED_DOMAINS = ["wizards.com", "wpn.wizards.com", "magic.wizards.com", "locator.wizards.com"]
SCRAPE_BLOCKED_DOMAINS = [
    "facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "tiktok.com",
    "ebay.com", "amazon.com", "etsy.com", "tcgplayer.com", "yelp.com", "google.com",
    "warhammer.com", "games-workshop.com", "gamestop.com", "hobbylobby.com", "hobbytown.com",
    "2ndandcharles.com", "learningexpress.com", "scientificgames.com", "drafthouse.com",
    "wizards.com", "locator.wizards.com", "sportscard-stores.com", "perfectgame.org",
]
ENRICH_EXCLUDED_HOSTS = [
    "facebook.com", "instagram.com", "m.facebook.com", "wpn.wizards.com", "warhammer.com",
]
NAME_BLOCK_PATTERNS = [
    r"\bliquor\b", r"\bwine\b", r"\bbeer\b", r"\bbrewery\b", r"\bpharmacy\b", r"\bdrugstore\b",
    r"\bgrocery\b", r"\bsupermarket\b", r"\bgas\s+station\b", r"\blaundromat\b", r"\bdry\s+clean",
    r"\bnail\s+salon\b", r"\bbarber\b", r"\bhair\s+salon\b", r"\bauto\s+repair\b", r"\bcar\s+wash\b",
    r"\bdentist\b", r"\bdental\b", r"\bmedical\b", r"\bveterinar", r"\bpet\s+store\b", r"\bpet\s+shop\b",
    r"\bconvenience\s+store\b", r"\bdollar\s+(store|tree|general)\b", r"\btattoo\b", r"\bpawn\b",
    r"\bcheck\s+cash", r"\btobacco\b", r"\bvape\b", r"\bsmoke\s+shop\b", r"\bcbd\b", r"\bdispensary\b",
    r"\bcigar", r"\bthrift", r"\bantique", r"\bice\s+cream\b", r"\bsporting\s+goods\b", r"\bappliance\b",
    r"\bcrafting\b", r"\bphone\s+repair\b", r"\bmobile\s+repair\b", r"\bdata\s+recovery\b",
    r"\bbarnes\s+&?\s*noble\b", r"\bbest\s+buy\b", r"\bhobby\s+lobby\b", r"\btarget\b", r"\bh-e-b\b",
    r"\btractor\s+supply\b", r"\bbuild-a-bear\b", r"\bwalmart\b", r"\bdollar\s+general\b",
    r"\bdollar\s+tree\b", r"\bfamily\s+dollar\b", r"\bfive\s+below\b", r"\bmarshalls\b", r"\btj\s*maxx\b",
    r"\bross\b", r"\bhomegoods\b", r"\bbed\s+bath\b", r"\blids\b", r"\bdgx\b", r"\bwalgreens\b", r"\bcvs\b",
    r"\bmichaels\b", r"\barmory\b", r"\barmoury\b", r"\bgun\b", r"\bfirearm\b", r"\bembroidery\b",
    r"\bfitness\b", r"\bgym\b", r"\bhemp\b", r"\bcookie\b", r"\bbakery\b",
]
NAME_ALLOW_PATTERNS = [
    r"\bgame", r"\bcomic", r"\bhobby\b", r"\btrading\s*cards?\b", r"\bcollectible\s*cards?\b",
    r"\bcard\s*(game|shop|store)\b", r"\btcg\b", r"\btabletop\b", r"\bminiature", r"\bwarhammer\b",
    r"\bpok[eé]mon\b", r"\bmtg\b", r"\bd&d\b", r"\brpg\b", r"\bboard\s+game",
    r"\bretro\s+(game|gaming|video|arcade)\b",
]
BLOCKED_PLACE_TYPES = [
    "liquor_store", "grocery_store", "pharmacy", "gas_station", "laundromat", "beauty_salon", "hair_care",
    "dentist", "veterinary_care", "car_repair", "car_wash", "convenience_store", "supermarket", "doctor",
    "hospital", "bar", "night_club", "florist", "funeral_home", "insurance_agency", "real_estate_agency",
    "travel_agency", "bank", "atm", "post_office", "laundry", "locksmith", "moving_company", "painter",
    "plumber", "roofing_contractor", "electrician", "pet_store",
]
OVERRIDE_PLACE_TYPES = ["book_store", "toy_store", "store"]
OFFTOPIC_NAME_PATTERNS = [
    r"\b(college|university|campus)\s+bookstore\b", r"\bbookstore\b", r"\bgamestop\b", r"\bgame\s+stop\b",
]
CHAIN_CLOSE_PATTERNS = [r"\bgamestop\b", r"\bgame\s+stop\b"]
CLOSE_NAME_PATTERNS = [
    r"\bgamestop\b", r"\bgame\s+stop\b", r"\bbarnes\s+&?\s*noble\b", r"\bbest\s+buy\b", r"\bhobby\s+lobby\b",
    r"\bmichaels\b", r"\bwalmart\b", r"\btarget\b", r"\bacademy\s+sports\b", r"\btractor\s+supply\b",
    r"\bdollar\s+(general|tree|store)\b", r"\bfamily\s+dollar\b", r"\bfive\s+below\b", r"\bwalgreens\b",
    r"\bcvs\b", r"\bgrocery\b", r"\bsupermarket\b", r"\bcasino\b", r"\bliquor\b", r"\bpharmacy\b",
    r"\bgas\s+station\b", r"\bpawn\b", r"\btobacco\b", r"\bvape\b", r"\bhemp\b", r"\bdispensary\b",
    r"\barmory\b", r"\barmoury\b", r"\bgun\b", r"\bfirearm\b", r"\bfitness\b", r"\bgym\b", r"\bdental\b",
    r"\bmedical\b", r"\bveterinar", r"\blaundromat\b", r"\bauto\s+repair\b", r"\bcar\s+wash\b",
]
PROTECT_NAME_PATTERNS = [
    r"\bgame", r"\bwargames?\b", r"\bcomic", r"\bhobb(y|ies)\b", r"\bcards?\b", r"\btcg\b", r"\btabletop\b",
    r"\bwarhammer\b", r"\bpok[eé]mon\b", r"\bmtg\b", r"\bminiature", r"\bcollect",
]

# --- fixed values: page evidence -----------------------------------------------------------------------------
SOFT_404_PATTERNS = [
    r"page\s+not\s+found", r"domain\s+(is\s+)?for\s+sale", r"parked\s+(free|domain|page)",
    r"this\s+domain\s+(has\s+)?expired", r"buy\s+this\s+domain",
    r"website\s+(is\s+)?(coming\s+soon|under\s+construction)", r"godaddy\.com/parking",
    r"sedoparking\.com", r"hugedomains\.com",
]
PARKED_PATTERNS = [r"parking-lander", r"adsense/domains/caf\.js", r"window\._trfd.*parking"]
PRODUCT_CATALOG = [
    ("mtg", [r"magic\s*:?\s*the\s+gathering", r"\bmtg\b"]),
    ("pokemon", [r"pok[eé]mon"]),
    ("yugioh", [r"yu[\-\s]?gi[\-\s]?oh"]),
    ("fab", [r"flesh\s+and\s+blood"]),
    ("board_games", [r"board\s+games?", r"tabletop\s+games?"]),
    ("dnd", [r"dungeons?\s*&?\s*dragons?", r"\bd&d\b", r"\brpgs?\b", r"pathfinder"]),
    ("miniatures", [r"miniatures?", r"warhammer", r"40k\b"]),
    ("comics", [r"\bcomics?\b", r"graphic\s+novels?"]),
]
WIDE_PRODUCT_CATALOG = [
    ("mtg", [r"magic\s*:?\s*the\s+gathering", r"\bmtg\b", r"\bcommander\b"]),
    ("pokemon", [r"pok[eé]mon"]),
    ("yugioh", [r"yu[\-\s]?gi[\-\s]?oh"]),
    ("lorcana", [r"\blorcana\b"]),
    ("fab", [r"flesh\s+and\s+blood"]),
    ("warhammer", [r"\bwarhammer\b", r"\b40k\b", r"age\s+of\s+sigmar"]),
    ("dnd", [r"dungeons?\s*&?\s*dragons?", r"\bd&d\b", r"\brpgs?\b", r"\bpathfinder\b"]),
    ("board_games", [r"board\s+games?", r"tabletop\s+games?"]),
    ("comics", [r"\bcomics?\b", r"graphic\s+novels?"]),
    ("sports_cards", [r"sports?\s+cards?", r"\bpanini\b", r"\btopps\b"]),
    ("retro_games", [r"retro\s+(video\s+)?games?", r"video\s+games?"]),
    ("miniatures", [r"\bminiatures?\b", r"\bpaints?\b", r"\bterrain\b"]),
]
EVENT_CATALOG = [
    ("events", [r"\bevents?\b"]),
    ("calendar", [r"\bcalendar\b"]),
    ("fnm", [r"friday\s+night\s+magic", r"\bfnm\b"]),
    ("commander", [r"\bcommander\b"]),
    ("prerelease", [r"\bpre[\-\s]?release\b"]),
    ("tournament", [r"\btournaments?\b"]),
    ("pokemon_league", [r"pok[eé]mon\s+league", r"league\s+challenge"]),
    ("event_calendar", [r"event\s+calendar", r"calendar\s+of\s+events"]),
]
EVENT_PATH_PATTERNS = [
    r"/events?(?:[/\?#]|$)", r"/calendar(?:[/\?#]|$)", r"/schedule(?:[/\?#]|$)", r"/tournaments?(?:[/\?#]|$)",
]
EVENT_TEXT_PATTERNS = [
    r"friday\s+night\s+magic", r"\bfnm\b", r"event\s+schedule", r"upcoming\s+events?", r"weekly\s+events?",
    r"tournament\s+schedule", r"in[\-\s]store\s+events?", r"prerelease",
]
PRODUCT_LINK_HINTS = ["/product", "/card", "/item", "/p/"]
EVENT_LINK_HINTS = ["event", "calendar", "tournament"]
USEFUL_LINK_HINTS = [
    "about", "calendar", "contact", "event", "hours", "magic", "pokemon", "product", "shop", "tcg",
    "tournament", "warhammer",
]
SINGLES_KEYWORDS = [
    r"magic\s+the\s+gathering", r"\bmtg\s+singles?\b", r"\bsingle\s+cards?\b", r"\bmtg\b.*\bsingles?\b",
    r"\bsingles?\b.*\bmtg\b",
]
# (pattern, case-insensitive)
CARD_ATTRIBUTE_PATTERNS = [
    (r"\b(?:NM|LP|MP|HP|DMG)\b", False),
    (r"\b(?:Near Mint|Lightly Played|Moderately Played)\b", True),
    (r"\bfoil\b", True),
    (r"\b(?:mythic|rare|uncommon|common)\b", True),
]
CARD_SET_PATTERNS = [
    r"\b(?:Modern Horizons|Murders at Karlov Manor|Thunder Junction)\b",
    r"\b(?:Commander|Foundations|Bloomburrow|Duskmourn)\b",
    r"\b(?:Innistrad|Ravnica|Dominaria|Eldraine|Ikoria)\b",
]
# (platform, HTML patterns, (header, pattern) pairs, URL patterns); the first platform that matches wins.
PLATFORM_SIGNATURES = [
    ("crystal_commerce", [r"crystalcommerce\.com", r"cc-product-list"], [], []),
    ("binderpos", [r"binderpos\.com"], [], [r"/products\.json"]),
    ("shopify", [r"cdn\.shopify\.com", r"Shopify\.theme"],
     [("x-shopid", r"\d+"), ("x-shopify-stage", r".*")], []),
    ("woocommerce", [r"wc-add-to-cart", r"wp-content/plugins/woocommerce"], [], []),
    ("squarespace", [r"squarespace\.com", r"static\d*\.squarespace\.com"], [], []),
    ("wordpress_stripe", [r"wp-content"], [], [r"js\.stripe\.com"]),
]
MARKETPLACE_URL_PATTERN = r"store\.tcgplayer\.com"
HOURS_TEXT_PATTERN = (
    r"\b(?:mon|tue|wed|thu|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
    r"[^<\n]{0,80}?\b(?:am|pm|closed)\b"
)
PHONE_PATTERN = r"(?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}"
SCRIPT_REDIRECT_PATTERN = r"""window\.location\.href\s*=\s*["']([^"']+)["']"""
UPDATED_PREFIX = r"(?:prices?\s+updated|last\s+updated|updated\s+on)\s*:?\s*"
UPDATED_PATTERNS = [r"(\w+\s+\d{1,2},?\s+\d{4})", r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", r"(\d{4}-\d{2}-\d{2})"]
COPYRIGHT_PATTERN = r"©\s*(\d{4})"
JSON_LD_PATTERN = r"""<script\s+type=["']application/ld\+json["']\s*>(.*?)</script>"""
PLATFORM_PRICE_PATTERNS = {
    "crystal_commerce": r"""class=["'](?:regular\s+)?price["'][^>]*>\s*\$(\d{1,4}\.\d{2})""",
    "shopify": r"""class=["'][^"']*price[^"']*["'][^>]*>\s*\$(\d{1,4}\.\d{2})""",
    "binderpos": r"""class=["'][^"']*price[^"']*["'][^>]*>\s*\$(\d{1,4}\.\d{2})""",
    "woocommerce":
        r"""class=["']woocommerce-Price-amount[^"']*["'][^>]*>\s*(?:<[^>]+>)*\s*\$(\d{1,4}\.\d{2})""",
}
PRICE_PATTERN = r"\$(\d{1,4}\.\d{2})"
PROBE_CARDS = [
    "Lightning Bolt", "Counterspell", "Sol Ring", "Thoughtseize", "Collected Company", "Cyclonic Rift",
    "Arid Mesa", "Ragavan, Nimble Pilferer",
]

# --- fixed values: published text ----------------------------------------------------------------------------
PRODUCT_LABELS = {
    "mtg": "Magic: The Gathering", "pokemon": "Pokemon TCG", "yugioh": "Yu-Gi-Oh!", "fab": "Flesh and Blood",
    "board_games": "Board Games", "dnd": "D&D / RPGs", "miniatures": "Miniatures", "comics": "Comics",
}
CATEGORY_LABELS = {
    "lgs": "Local Game Store", "comic_shop": "Comic Book Store", "retro_games": "Retro Video Game Store",
    "hobby_miniatures": "Warhammer & Hobby Shop",
}
PLATFORM_LABELS = {
    "crystal_commerce": "CrystalCommerce", "binderpos": "BinderPOS", "shopify": "Shopify",
    "squarespace": "Squarespace", "woocommerce": "WooCommerce", "wordpress_stripe": "WordPress + Stripe",
    "custom": "Custom", "unknown": "Unknown",
}
TITLE_LABELS = {
    "lgs": "TCG", "comic_shop": "Comic", "retro_games": "Retro game", "hobby_miniatures": "Warhammer",
}
CATEGORY_PHRASES = {
    "lgs": "local game store for Magic, Pokémon & board games",
    "comic_shop": "local comic shop with new releases & back issues",
    "retro_games": "retro video game store for classic consoles & cartridges",
    "hobby_miniatures": "Warhammer & miniatures hobby shop",
}
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
STATIC_SECTIONS = [
    "comics", "retro-games", "warhammer", "near-me", "stores", "affiliate-disclosure", "privacy-policy",
]
# bucket -> (likely cause, expected indexability, action)
URL_BUCKETS = {
    "static_asset": ("Next.js static asset", "not an indexable HTML page", "ignore"),
    "opengraph_image": ("Dynamic Open Graph image endpoint", "not an indexable HTML page", "ignore"),
    "store_claim": ("Store claim page", "noindex expected", "ignore"),
    "store_uuid": ("UUID store URL or slugless public row", "redirect/noindex expected", "redirect"),
    "store_slug": ("Store detail slug URL", "indexable unless thin/off-topic", "manual_review"),
    "state": ("State directory page", "indexable template", "fix_template"),
    "city": ("City directory page", "indexable when city has stores", "enrich"),
    "category_static": ("Category/static SEO page", "indexable", "fix_template"),
    "guide": ("Guide page", "indexable when published", "enrich"),
    "unknown": ("Unknown URL pattern", "unknown", "manual_review"),
}
# Ten metro points used for repeated radius searches: (name, latitude, longitude).
METRO_POINTS = [
    ("Los Angeles", 33.94, -118.40), ("New York", 40.71, -74.01), ("Chicago", 41.88, -87.63),
    ("Houston", 29.76, -95.37), ("Phoenix", 33.45, -112.07), ("Denver", 39.74, -104.99),
    ("Miami", 25.76, -80.19), ("Seattle", 47.61, -122.33), ("San Francisco", 37.77, -122.42),
    ("Boston", 42.36, -71.06),
]

# Published questions and answers of a store page, fixed text. Names in braces are filled in.
FAQ_TEXT = {
    "where": ("Where is {name} located?", "{name} is located at {address}."),
    "phone": ("What is {name}'s phone number?", "You can reach {name} by phone at {phone}."),
    "hours": ("What are {name}'s hours?", "{name}'s hours are: {hours}."),
    "website": ("Does {name} have a website?", "Yes, you can visit {name}'s website at {website}."),
    "games": ("What games does {name} sell?", "{name} carries {products}."),
    "mtg": ("Does {name} sell Magic: The Gathering cards?", "Yes, {name} sells Magic: The Gathering cards."),
    "pokemon": ("Does {name} sell Pokemon cards?", "Yes, {name} sells Pokemon TCG cards."),
    "miniatures": ("Does {name} have Warhammer products?", "Yes, {name} carries Warhammer and miniatures products."),
    "events": ("Does {name} host events?", "Yes, {name} hosts in-store events.{schedule}"),
    "singles": (
        "Can I buy Magic: The Gathering singles from {name} online?",
        "Yes, {name} sells Magic: The Gathering singles through their online presence.",
    ),
    "wpn": ("Is {name} a WPN store?", "Yes, {name} is a {level} member of Wizards Play Network."),
    "rating": ("What is {name}'s rating?", "{name} has a {rating} out of 5 star rating on Google based on {reviews} reviews."),
}
FAQ_SCHEDULE = " Check their events schedule at {event_url}."

# --- fixed values: limits and weights ------------------------------------------------------------------------
EARTH_RADIUS_MILES = 3958.8
FUZZY_NAME_THRESHOLD = 85
PROXIMITY_MILES = 0.5
PAGE_SIZE = 25
SITEMAP_LIMIT = 50_000
GRID = {"lat_min": 24, "lat_max": 50, "lng_min": -125, "lng_max": -66, "step": 2}
TRUST_WEIGHTS = {
    "wpn": 40, "products": 25, "confident": 15, "website": 10, "phone": 5, "place_id": 5,
    "low_content": -20, "google_only": -10,
}
TRUST_HIGH_CONFIDENCE = 0.7
TRUST_LOW_CONFIDENCE = 0.5
OCS_PRIORITY_ACTIONS = ["suppress_or_enrich", "review_for_reactivation", "enrich_then_review", "manual_review"]
TITLE_MAX = 60
DESCRIPTION_MAX = 160
# (path, priority, change frequency) of the fixed pages, and the category pages.
SITEMAP_STATIC = [("", 1.0, "weekly"), ("/affiliate-disclosure", 0.3, "yearly"), ("/guides", 0.7, "weekly")]
SITEMAP_CATEGORIES = ["/comics", "/retro-games", "/warhammer"]
