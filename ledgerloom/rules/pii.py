"""Redaction rules: patterns and tags of pass 1, pass 2 and pass 3.

Fixed values. ``(?U)`` gives the Java regex engine Unicode ``\\d \\w \\s \\b``.
"""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    name: str
    regex: str
    replacement: str
    gate: str  # cheap necessary condition, a name in operators.redact.GATES
    words: tuple[str, ...] = ()  # and one of these words must occur
    skip_spans: bool = False  # matches that do not start with a digit are harmless spans, not finds


# --- fixed values: pass 1 patterns in the order they are applied ---------------
MASKED_CARD = r"(?U)\*{3,4}[\-]?\d{4}\b"

PATTERNS = (
    Pattern(
        "credit_card",
        r"(?U)(?<!\d)(?:4\d{3}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?(\d{4})"
        r"|(?:5[1-5]\d{2}|2[2-7]\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?(\d{4})"
        r"|3[47]\d{2}[\s\-]?\d{6}[\s\-]?\d(\d{4})"
        r"|(?:6011|65\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?(\d{4}))(?!\d)",
        "[CARD_****$1$2$3$4]",
        "card",
    ),
    Pattern("ssn", r"(?U)\b\d{3}\-\d{2}\-\d{4}\b|\*{3}\-\*{2}\-\d{4}\b", "[SSN_REDACTED]", "ssn"),
    Pattern("routing_number", r"(?iU)((?:routing|aba|transit)[\s#:]*)\d{9}\b", "$1[ROUTING_REDACTED]", "nine", ("routing", "aba", "transit")),
    Pattern(
        "account_number",
        r"(?iU)((?:account|acct|acct\.)[\s#:]*(?:number[\s#:]*|num[\s#:]*|no[\s#:]*)?)\d{8,17}\b",
        "$1[ACCT_REDACTED]",
        "eight", ("account", "acct"),
    ),
    Pattern(
        "generic_long_number",
        r"(?iU)((?:order|confirmation|reference|tracking|transaction|member|policy|claim|invoice)[\s#:]*)[\d\-]{10,}\b",
        "$1[NUMBER_REDACTED]",
        "ten", ("order", "confirmation", "reference", "tracking", "transaction", "member", "policy", "claim", "invoice"),
    ),
    Pattern(
        "phone_number",
        r"(?U)\b1[\-\.]?\(?\d{3}\)?[\s\-\.]?\d{3}[\s\-\.]?\d{4}\b|\(?\d{3}\)?[\s\-\.]?\d{3}[\s\-\.]?\d{4}\b",
        "[PHONE_REDACTED]",
        "phone",
    ),
    Pattern(
        "secure_url",
        r"(?iU)https?://[^\s]+[?&](?:token|session|auth|password|key|id)=[^\s]*",
        "[SECURE_URL_REDACTED]",
        "url",
    ),
    Pattern("email_address", r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL_REDACTED]", "at"),
    Pattern(
        "address",
        r"(?U)\b\d{1,6}\s+[A-Za-z0-9\.\s]{2,40}(?:,?\s*(?:Apt|Suite|Ste|Unit|#)\s*[A-Za-z0-9]+)?"
        r",?\s*[A-Za-z\s]{2,30},?\s*[A-Z]{2}\s+\d{5}(?:\-\d{4})?\b",
        "[ADDRESS_REDACTED]",
        "zip",
    ),
)

# --- fixed values: sentinel and pass 3 tag -------------------------------------
REDACTION_ERROR = "[REDACTION_ERROR: content withheld for safety]"
LEAK_TAG = "[UNKNOWN_PII_REDACTED]"

# --- fixed values: spans in which a run of digits is harmless (amounts, tags, order numbers) ---
HARMLESS = (r"\$[\d,]+\.?\d*", r"\[[\w*]+\]", r"#\d+")

# --- leak rules of pass 3, in order ---------------------------------------------
# Of these only the digit-run rule can lie inside a harmless span. Its regex therefore also matches
# those spans, whole and from the left, so that a run of digits that is found lies in none of them;
# matches that do not start with a digit are spans and stay (``skip_spans``).
LEAKS = (
    Pattern("long_number", rf"(?U)(?:{'|'.join(HARMLESS)})|(?<![\[$,])\b\d{{6,}}\b(?!\])", LEAK_TAG, "six", skip_spans=True),
    Pattern("ssn_like", r"(?U)(?<!\[)\b\d{3}\-\d{2}\-\d{4}\b(?!\])", LEAK_TAG, "ssn_digits"),
    Pattern("partial_ssn", r"(?U)\*+\-\*+\-\d{4}", LEAK_TAG, "stars"),
    Pattern(
        "email_like",
        r"(?U)(?<!\[)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b(?!\])",
        LEAK_TAG,
        "at",
    ),
    Pattern("phone_like", r"(?U)(?<!\[)\(?\d{3}\)?[\s\-\.]\d{3}[\s\-\.]\d{4}(?!\])", LEAK_TAG, "phone"),
)

# --- structured entity rules of pass 2 (tags are fixed values) ------------------
# The guard (?<![\[\w.-]) / (?![\w\]-]) keeps them out of existing tags and words.
ENTITIES = (
    Pattern("entity_IBAN_CODE", r"(?U)(?<![\[\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w\]])", "[IBAN_REDACTED]", "iban"),
    Pattern(
        "entity_CREDIT_CARD",
        r"(?U)(?<![\[\w.\-*])\d(?:[ \-]?\d){12,18}(?![\w\]\-])",
        "[CARD_REDACTED]",
        "card_digits",
    ),
    Pattern(
        "entity_IP_ADDRESS",
        r"(?U)(?<![\[\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w\]]|\.\d)",
        "[IP_REDACTED]",
        "dots",
    ),
    Pattern("entity_US_SSN", r"(?U)(?<![\[\w\-])(?!000|666|9)\d{3}[\- ](?!00)\d{2}[\- ](?!0000)\d{4}(?![\w\]\-])", "[SSN_REDACTED]", "ssn_digits"),
    Pattern("entity_US_ITIN", r"(?U)(?<![\[\w\-])9\d{2}[\- ](?:5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])[\- ]\d{4}(?![\w\]\-])", "[SSN_REDACTED]", "ssn_digits"),
    Pattern("entity_US_PASSPORT", r"(?iU)(passport(?:\s+(?:number|no\.?|#))?[\s#:]*)(?:[A-Z]\d{8}|\d{9})(?![\w\]])", "$1[PASSPORT_REDACTED]", "eight", ("passport",)),
    Pattern("entity_US_DRIVER_LICENSE", r"(?iU)((?:driver'?s?\s+licen[cs]e|licen[cs]e\s+(?:number|no\.?|#)|DL)[\s#:]*)[A-Z]\d{6,8}(?![\w\]])", "$1[LICENSE_REDACTED]", "six", ("licen", "dl")),
    Pattern("entity_MEDICAL_LICENSE", r"(?iU)((?:DEA|medical\s+licen[cs]e)[\s#:]*)[A-Z]{2}\d{7}(?![\w\]])", "$1[LICENSE_REDACTED]", "seven", ("dea", "medical")),
    Pattern("entity_US_BANK_NUMBER", r"(?iU)((?:bank|checking|savings|debit)(?:\s+(?:account|acct))?(?:\s+(?:number|no\.?|#))?[\s#:]+)\d{8,17}(?![\w\]])", "$1[ACCT_REDACTED]", "eight", ("bank", "checking", "savings", "debit")),
    Pattern("entity_EMAIL_ADDRESS", r"(?U)(?<![\[\w.])[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+(?![\w\]])", "[EMAIL_REDACTED]", "at"),
    Pattern("entity_PHONE_NUMBER", r"(?U)(?<![\[\w])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?![\w\]])", "[PHONE_REDACTED]", "plus"),
)
