"""Prompt-injection rules (fixed values)."""

# --- fixed values: named patterns in report order; all ignore case ---------------
PATTERNS = (
    ("ignore_instructions", r"ignore\s+(all\s+)?(previous|prior|above|your)\s+(instructions|rules|guidelines|directives)"),
    ("ignore_all_rules", r"ignore\s+all\s+(safety\s+)?rules"),
    ("system_prompt", r"(system\s+prompt|system\s+message|initial\s+prompt)"),
    (
        "output_reveal",
        r"(output|reveal|show|display|list|print|include)\s+(?:\w+\s+){0,3}(all|every)\s+(?:\w+\s+){0,2}"
        r"(credit|card|ssn|account|personal|private|pii|secret)\s+numbers?",
    ),
    (
        "data_exfiltration",
        r"(all|every)\s+(credit\s+card|account|ssn|personal|private)\s+numbers?\s*\(?(full|unmasked|complete)",
    ),
    ("forget_instructions", r"forget\s+(your|all|previous)\s+(instructions|rules|guidelines|training)"),
    ("role_override", r"you\s+are\s+now\s+(?!a\s+secure)"),
    ("act_as", r"act\s+as\s+(if\s+you\s+are|a|an)\s+(?!secure\s+finance)"),
    (
        "disregard",
        r"(disregard|override|bypass|circumvent|disable)\s+(your|all|the|any)\s+\w*\s*"
        r"(rules|instructions|safety|security|guidelines|restrictions|protections?)",
    ),
    ("do_not_redact", r"do\s+not\s+(redact|censor|hide|mask|remove|filter)"),
)

# --- fixed values: the encoded-payload rule --------------------------------------
BASE64 = "base64_block"
BASE64_RUN = r"[A-Za-z0-9+/]{60,}={0,2}"
MIME_MARKS = (
    "Content-Type:", "Content-Transfer-Encoding:", "boundary=", "multipart/", "text/html", "text/plain",
    "image/", "MIME-Version:", "charset=", "name=", "filename=",
)
PAYLOAD_KEYWORDS = (
    "ignore", "disregard", "override", "bypass", "system prompt", "reveal", "output all", "disable",
    "redact", "unfiltered", "unrestricted", "admin", "credit card", "ssn", "account number", "pii",
)
PAYLOAD_COMMANDS = ("ignore", "disregard", "override", "bypass", "disable", "reveal", "output")
PAYLOAD_TARGETS = ("instructions", "rules", "safety", "redact", "credit", "ssn", "account", "pii")

# --- fixed values: risk classes ----------------------------------------------------
HIGH_RISK = (
    "ignore_instructions", "ignore_all_rules", "output_reveal", "disregard", "do_not_redact",
    "forget_instructions", "data_exfiltration",
)
MEDIUM_RISK = ("system_prompt", "role_override", "act_as", BASE64)
