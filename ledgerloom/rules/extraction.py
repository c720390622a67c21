"""Transaction-extraction rules (fixed values)."""

# --- fixed values: promotional and informational mail ------------------------------
PROMO_MERCHANTS = ("ziprecruiter", "indeed", "linkedin jobs", "job alert", "career", "groupon")
PROMO_SUBJECTS = (
    r"\b(?:sale|deal|offer|discount|save|off)\b",
    r"\b\d+%\s*off\b",
    r"\binvite(?:\s*only|-only)\b",
    r"\breward\s*points?\b",
    r"\bapply\s*now\b",
    r"\bjob\s*(?:alert|opening)\b",
    r"\blimited\s*time\b",
    r"\bexclusive\s*(?:deal|offer)\b",
    r"\bfree\s*(?:shipping|trial|gift)\b",
    r"\bnew\s*arrivals?\b",
    r"\bshop\s*now\b",
    r"\bflash\s*sale\b",
    r"\bclearance\b",
    r"\bspring\s*break\b",
    r"\bready,?\s*set\b",
    r"\bcheck\s*out\s*(?:these|our)\b",
    r"\bdon't\s*miss\b",
    r"\b\d+\s*months?\s*(?:of|free)\b",
)
INFO_SUBJECTS = (
    r"security\s*alert",
    r"sign[-\s]in\s*(?:detected|alert)",
    r"password\s*(?:reset|changed)",
    r"credit\s*(?:score|journey|summary)",
    r"your\s+credit\s+score",
    r"account\s*statement",
    r"annual\s+fee",
    r"apply\s+now",
    r"pre[-\s]?approved",
    r"tips?\s*(?:and|&)\s*updates?",
    r"welcome\s*to\s*google",
    r"review\s*your\s*(?:account\s*)?settings",
    r"(?:out|in)\s+for\s+delivery",
    r"your\s+delivery\s+(?:should|will)\s+arrive",
    r"track\s+(?:your\s+)?(?:order|package|shipment)",
    r"billing\s+document\s+available",
    r"credit\s+limit\s+increase",
)
PROMO_BODIES = (
    r"unsubscribe",
    r"manage\s*(?:your\s*)?preferences",
    r"click\s*here\s*to\s*(?:shop|save|claim)",
    r"promotional\s*(?:email|offer)",
)

# --- fixed values: wording that confirms a purchase ----------------------------------
CONFIRMATIONS = (
    r"\b(?:you\s+(?:purchased|paid|ordered|booked))\b",
    r"\b(?:order|booking|purchase|payment)\s+(?:confirmed|confirmation)\b",
    r"\b(?:receipt|invoice)\s+for\s+your\b",
    r"\btransaction\s+(?:alert|notification)\b",
    r"\b(?:charged|billed)\s+\$",
    r"\byour\s+card\s+(?:ending|was\s+charged)",
)

# --- fixed values: merchant, amount and date patterns, in order; all ignore case -----
MERCHANT_SUBJECTS = (
    r"receipt from ([^,\n]+)",
    r"order from ([^,\n]+)",
    r"payment to ([^,\n]+)",
    r"your ([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*) (?:order|receipt|subscription)",
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*) order confirmation",
    r"thank you for.*?(?:shopping|order).*?at ([A-Z][a-z]+)",
)
MERCHANT_BODIES = (
    r"receipt from ([^\n,]+)",
    r"order from ([^\n,]+)",
    r"sold (?:locally )?by ([^\n,]+)",
    r"merchant:\s*([^\n,]+)",
    r"payment to ([^\n,]+)",
    r"purchased at ([^\n,]+)",
    r"you paid ([^\n,]+) \$",
)
AMOUNTS = (
    r"\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?)",
    r"(\d{1,3}(?:,\d{3})*\.\d{2})\s*USD",
    r"(?:total|amount|paid|charge|price|cost|subtotal|grand\s+total)[\s:]+\$?\s*(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?)",
    r"(?:you paid|you're paying|payment of)[\s:]+\$?\s*(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?)",
    r"(?:order total|total due|amount due)[\s:]+\$?\s*(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?)",
)
DATES = (
    r"date(?:\s+paid)?:\s*([A-Z][a-z]{2}\s+\d{1,2},?\s+\d{4})",
    r"(\d{1,2}/\d{1,2}/\d{4})",
    r"(\d{4}-\d{2}-\d{2})",
    r"([A-Z][a-z]{2,8}\s+\d{1,2},?\s+\d{4})",
)
DOLLARS = r"\$[\d,]+\.?\d{0,2}"
AMOUNT_RANGE = (0.01, 999999.0)
LARGE_AMOUNT = 500.0
SCAN_CONFIDENCE = 0.8
RULE_CONFIDENCE = 0.6

# --- fixed values: how many characters of a text each rule looks at -------------------
PROMO_BODY_CHARS = 500
CONFIRM_BODY_CHARS = 500
FOOTER_MIN_CHARS = 1000
FOOTER_TAIL_CHARS = 500
MERCHANT_CHARS = 50
MERCHANT_BODY_CHARS = 800
DATE_CHARS = 500
PAYMENT_CHARS = 600
MAIL_BODY_CHARS = 1500
TRUNCATION_MARK = "\n[...truncated]"

# --- fixed values: payment methods in order; every word of one group must occur -------
PAYMENT_METHODS = (
    ("visa", (("visa", "ending in"),)),
    ("discover", (("discover", "ending in"), ("discover", "apple pay"))),
    ("mastercard", (("mastercard", "ending in"),)),
    ("amex", (("american express",), ("amex",))),
    ("paypal", (("paypal",),)),
    ("apple_pay", (("apple pay",),)),
    ("google_pay", (("google pay",),)),
    ("venmo", (("venmo",),)),
    ("zelle", (("zelle",),)),
    ("cashapp", (("cash app",), ("cashapp",))),
)

# --- fixed values: which mail counts as financial ---------------------------------------
FINANCIAL_DOMAINS = (
    "chase.com", "bankofamerica.com", "wellsfargo.com", "capitalone.com", "citibank.com", "discover.com",
    "usbank.com", "pnc.com",
    "paypal.com", "venmo.com", "zelle.com", "zellepay.com", "cashapp.com", "cash.app", "square.com", "stripe.com",
    "amazon.com", "walmart.com", "target.com", "bestbuy.com", "costco.com", "homedepot.com", "lowes.com",
    "macys.com", "nordstrom.com", "ebay.com", "etsy.com",
    "doordash.com", "grubhub.com", "ubereats.com", "uber.com", "instacart.com", "postmates.com",
    "spotify.com", "netflix.com", "hulu.com", "disneyplus.com", "apple.com", "google.com", "adobe.com",
    "microsoft.com", "dropbox.com", "openai.com",
    "airbnb.com", "booking.com", "expedia.com", "united.com", "delta.com", "southwest.com", "hilton.com",
    "marriott.com",
    "lyft.com",
    "t-mobile.com", "verizon.com", "att.com", "xfinity.com",
)
FINANCIAL_SUBJECTS = (
    "receipt", "payment", "order", "invoice", "charged", "transaction", "statement", "subscription", "renewal",
    "confirmation", "purchase", "total", "paid", "billing",
)
