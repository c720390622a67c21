"""Category rules (fixed values)."""

# --- fixed values: subscription merchants and context words ------------------------------
SUBSCRIPTION_MERCHANTS = (
    "netflix", "spotify", "hulu", "disney", "disney+", "apple tv", "apple music", "amazon prime", "youtube",
    "youtube premium", "hbo", "hbo max", "paramount", "paramount+", "peacock", "espn+", "showtime", "starz",
    "crunchyroll", "tidal", "pandora", "deezer", "apple one",
    "adobe", "microsoft", "office 365", "microsoft 365", "dropbox", "icloud", "google one", "google workspace",
    "github", "jetbrains", "notion", "evernote", "lastpass", "1password", "dashlane", "grammarly", "canva",
    "figma", "slack", "zoom", "webex", "teams",
    "new york times", "washington post", "wall street journal", "medium", "substack", "patreon", "audible",
    "kindle unlimited",
    "peloton", "strava", "myfitnesspass", "headspace", "calm", "noom",
    "playstation", "xbox", "nintendo", "steam", "epic games", "ea play",
    "onlyfans", "memberful", "squarespace", "wix", "godaddy",
)
SUBSCRIPTION_CONTEXT = (
    "subscription", "renewed", "membership", "monthly", "annual", "recurring", "auto-renew", "plan has been",
    "premium plan",
)

# --- fixed values: ledger categories, priority patterns first ------------------------------
PRIORITY_PATTERNS = (
    (r"\b(?:discover|chase|capital one|citi|citibank|amex|american express|bank of america)\b.*\b(?:cashback|cash back|reward|bonus|rebate)\b", "Income"),
    (r"\b(?:cashback|cash back|reward|bonus|rebate)\b.*\b(?:discover|chase|capital one|citi|citibank|amex|american express|bank of america)\b", "Income"),
    (
        r"\b(?:discover|chase|capital one|citi|citibank|amex|american express|bank of america)\b.*\b(?:payment received|payment confirmation|thank you for your payment|statement|balance due|minimum payment|amount due)\b",
        "Bills/Utilities",
    ),
    (
        r"\b(?:statement|balance due|minimum payment|amount due|payment received)\b.*\b(?:discover|chase|capital one|citi|citibank|amex|american express|bank of america)\b",
        "Bills/Utilities",
    ),
    (
        r"\b(?:discover card|chase sapphire|chase freedom|capital one|citi card|citibank|amex|american express"
        r"|bank of america)\b",
        "Bills/Utilities",
    ),
    (r"\b(?:cashback|cash back|reward|refund|reimbursement)\b", "Income"),
    (r"\b(?:received|deposit)\b.*(?:from|payment)", "Income"),
    (r"\bpayment\s+(?:to|for)\b", "Bills/Utilities"),
    (r"\b(?:credit card|card)\s+payment\b", "Bills/Utilities"),
    (r"\b(?:southwest|united|delta|american airlines|jetblue)\b", "Travel"),
    (r"\b(?:doordash|grubhub|ubereats|postmates)\b", "Dining"),
)
CATEGORY_KEYWORDS = (
    ("Groceries", ("whole foods", "trader joe", "grocery", "safeway", "kroger", "costco", "target", "walmart grocery")),
    ("Dining", ("restaurant", "starbucks", "mcdonald", "chipotle", "nobu", "dinner", "cafe", "grubhub", "doordash", "ubereats")),
    ("Transport", ("uber", "lyft", "gas", "shell", "chevron", "parking", "transit", "payrange", "gofun")),
    ("Entertainment", ("netflix", "spotify", "hulu", "disney", "movie", "theater", "concert", "event")),
    ("Subscriptions", ("subscription", "renewed", "membership", "monthly", "annual")),
    ("Shopping", ("amazon", "best buy", "walmart", "ebay", "order", "shipped", "staples", "ulta", "groupon")),
    ("Bills/Utilities", ("electric", "water", "internet", "phone bill", "insurance", "statement", "payment due")),
    ("Healthcare", ("pharmacy", "doctor", "hospital", "medical", "dental", "health", "alevea")),
    ("Travel", ("airline", "hotel", "airbnb", "booking", "flight", "travel", "southwest", "expedia")),
    ("Income", ("received", "deposit", "payroll", "salary", "cashback", "cash back", "reward", "refund", "reimbursement")),
    ("Transfer", ("venmo", "zelle", "cashapp", "transfer", "sent you", "paid you", "ziprecruiter")),
)
DEFAULT_CATEGORY = "Other"

# --- fixed values: category hints of the summary, issuer rule first ---------------------------
HINT_ISSUERS = ("discover", "chase", "capital one", "citi", "citibank", "amex", "american express", "bank of america")
HINT_REWARDS = ("cashback", "cash back", "reward", "bonus", "rebate")
HINT_KEYWORDS = (
    ("subscription", ("netflix", "spotify", "hulu", "disney", "subscription", "renewed", "membership")),
    ("food_delivery", ("doordash", "grubhub", "ubereats", "postmates")),
    ("rideshare", ("uber", "lyft", "ride")),
    ("shopping", ("amazon", "order", "shipped", "delivered", "purchase")),
    ("groceries", ("whole foods", "trader joe", "grocery", "safeway", "kroger")),
    ("dining", ("restaurant", "dinner", "lunch", "cafe", "nobu")),
    ("transfer", ("venmo", "zelle", "cashapp", "transfer", "sent", "received", "payment")),
    ("gas", ("shell", "chevron", "gas", "fuel", "exxon")),
    ("bills", ("statement", "bill", "due", "balance", "payment due")),
    ("income", ("cashback", "cash back", "reward", "refund", "reimbursement")),
)
DEFAULT_HINT = "other"
