"""Fixed values of the domain: states, weights, word lists, patterns."""

from __future__ import annotations

# Fixed values. They decide results, so they are the domain's own, in its order.
STATES = ["DISCOVERED", "EVALUATED", "QUALIFIED", "SHORTLISTED", "OUTREACH_READY", "CONTACTED", "REPLIED", "CONVERSATION", "CLIENT", "REJECTED", "NURTURE", "NOT_NOW", "DO_NOT_CONTACT"]
FINAL_STATES = ["CONTACTED", "REPLIED", "CONVERSATION", "CLIENT", "REJECTED", "DO_NOT_CONTACT"]
QUEUE_STATES = ["QUALIFIED", "SHORTLISTED", "OUTREACH_READY", "NURTURE", "EVALUATED", "NOT_NOW"]
ADVANCED_STATES = ["OUTREACH_READY", "CONTACTED", "REPLIED", "CONVERSATION", "CLIENT", "REJECTED", "DO_NOT_CONTACT"]
WEIGHTS = {"fit": 20, "creative": 20, "money": 20, "need": 15, "contactability": 10, "personalization": 10, "conversion": 5}
QUEUE_FLOOR, QUALIFY_BAR, QUEUE_MAX, COOLDOWN_DAYS, GHOST_DAYS = 35, 68, 30, 45, 30
MX_LIVE_DAYS, MX_DEAD_DAYS = 30, 7
MULTI_PART_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "com.mx", "co.za", "com.tr", "com.sg", "co.kr"]
HANDLE_TAILS = "(co|shop|store|official|hq|thelabel|nyc|usa)$"
LEGAL_SUFFIXES = ["llc", "inc", "incorporated", "co", "corp", "ltd", "limited", "gmbh", "studio", "shop", "store", "the"]
CORPORATE_MARKERS = ["investor relations", "careers at", "nasdaq", "nyse:", "our global", "fortune 500", "annual report", "shareholder", "board of directors", "press@", "ir@", "corporate headquarters"]
MARKETPLACES = ["etsy.com", "instagram.com", "tiktok.com", "facebook.com", "amazon.com", "linktr.ee", "beacons.ai", "bio.link", "linktree.com", "twitter.com", "x.com", "pinterest.com", "youtube.com", "depop.com", "ebay.com", "shop.app", "bigcartel.com", "gumroad.com"]
PLATFORMS = [
    ("shopify", r"cdn\.shopify\.com|shopify\.com/s/files|Shopify\.theme|myshopify\.com"),
    ("squarespace", r"squarespace\.com|static1\.squarespace|Squarespace\.afterBodyLoad"),
    ("wix", r"wix\.com|wixstatic\.com|parastorage\.com"),
    ("webflow", r"webflow\.com|website-files\.com|wf-domain"),
    ("wordpress", r"wp-content|wp-includes|wordpress"),
    ("bigcartel", r"bigcartel\.com"),
    ("bigcommerce", r"bigcommerce\.com"),
    ("cargo", r"cargo\.site|cargocollective"),
    ("format", r"format\.com"),
    ("carrd", r"carrd\.co"),
]
CONTENT_FLAGS = {
    "has_wholesale": r"wholesale|stockist|stockists|retailers|where\s+to\s+buy|trade\s+account|faire\.com",
    "has_press": r"as\s+seen\s+in|press|featured\s+in|in\s+the\s+news|vogue|nylon|dazed|hypebeast|refinery29|the\s+cut|paper\s+magazine",
    "has_team": r"our\s+team|meet\s+the\s+team|about\s+us|founded\s+by|our\s+story|studio\s+team",
    "has_events": r"pop-?up|market\s+dates|craft\s+fair|trunk\s+show|our\s+events|upcoming\s+shows",
    "has_email_capture": r"newsletter|subscribe|join\s+the\s+list|sign\s+up\s+for|mailing\s+list",
    "manual_order_hint": r"dm\s+(me|us)\s+to\s+order|email\s+(me|us)\s+to\s+order|message\s+(me|us)\s+for|order\s+via\s+(dm|instagram)|custom\s+order\s+form|inquire\s+for\s+pricing|contact\s+for\s+pricing",
}
HTML_FLAGS = {
    "has_booking": r"calendly|acuityscheduling|squareup\.com/appointments|book\s+(a|an|now|online)|schedule\s+(a|an)\s+(call|session|consult)|appointment|reserve\s+your",
    "has_blog": r"/blog|/journal|/news|/stories|/diary",
}
US_STATES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY"
US_WORDS = r"united states|usa|u\.s\.a|brooklyn|los angeles|new york|portland|austin|chicago|seattle|nashville|philadelphia|oakland|atlanta|denver|minneapolis|richmond|providence"
# Hosts that are not public names.
PRIVATE_HOSTS = [r"^localhost$", r"\.localhost$", r"^127\.", r"^0\.", r"^10\.", r"^169\.254\.", r"^192\.168\.", r"^172\.(?:1[6-9]|2\d|3[01])\.", r"^\[?::1\]?$", r"^\[?f[cd][0-9a-f]{2}:", r"^\[?fe80:", r"\.internal$", r"\.local$", r"\.lan$", r"\.home$", r"^metadata\.google", r"^instance-data"]
# Praise that names nothing.
VAGUE_PRAISE = r"^(?:the\s+)?(?:aesthetic|brand|unique|strong|beautiful|lovely|great|nice|good|distinct|creative)\b[\w\s]*(?:personality|identity|aesthetic|products?|brand|vibe|feel|style|values?)\s*$"
