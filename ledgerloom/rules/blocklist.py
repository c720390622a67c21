"""Default blocklist (fixed values); matching ignores case."""

# --- fixed values -----------------------------------------------------------------
SENDERS = (
    "noreply@groupon.com", "U-Mail@e.ulta.com", "jobs-listings@linkedin.com", "noreply@ziprecruiter.com",
    "offers@southwest.com", "marketing@ulta.com", "deals@groupon.com", "noreply@indeed.com",
    "promotions@retailmenot.com", "offers@slickdeals.net", "noreply@uber.com",
    "sde-university-applicants@amazon.com",
)
DOMAINS = (
    "e.ulta.com", "marketing.ulta.com", "promo.groupon.com", "offers.southwest.com", "ziprecruiter.com",
    "indeed.com", "linkedin.com", "retailmenot.com", "slickdeals.net", "em.target.com", "email.walmart.com",
    "e.walmart.com", "click.em.target.com", "email.apple.com",
)
SUBJECTS = (
    "job alert", "invite-only", "spring break", "ready, set", "flash sale", "limited time offer",
    "exclusive deal", "new arrivals", "clearance", "your credit score", "annual fee", "apply now",
    "pre-approved", "check out these", "don't miss", "free shipping", "free gift with",
    "online purchase see details", "see details", "free pc gift", "free 4pc", "free 11 pc", "swoon-worthy",
    "professional makeup gift", "valentine", "spring arrivals", "caught your eye", "time to restock",
    "editors picks", "curated styles", "blooms pastels", "garden parties", "hosting the big game",
    "shop denim", "the tech aisle", "shopping list", "this just in", "set-to-jet", "spring styles",
)
