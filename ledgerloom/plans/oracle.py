"""Building blocks of the DuckDB side of the check.

RE2 has no look-around: a guard becomes a captured neighbour that is put back,
and the replacement runs twice because neighbours of adjacent matches overlap.
"""

from __future__ import annotations

from ..operators.blocklist import Blocklist
from ..rules import categories as C
from ..rules import extraction as X
from ..rules import injection as I
from ..sources import views as V

CARD = (
    r"(?:4[0-9]{3}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?([0-9]{4})"
    r"|(?:5[1-5][0-9]{2}|2[2-7][0-9]{2})[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?([0-9]{4})"
    r"|3[47][0-9]{2}[\s\-]?[0-9]{6}[\s\-]?[0-9]([0-9]{4})"
    r"|(?:6011|65[0-9]{2})[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?([0-9]{4}))"
)
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
W = r"\pL\pN_"
# name -> (tag, pattern, replacement, flags, passes)
PASS1 = {
    "credit_card": ("[CARD_****", rf"(^|[^0-9]){CARD}($|[^0-9])", r"\1[CARD_****\2\3\4\5]\6", "g", 2),
    "ssn": ("[SSN_REDACTED]", r"\b\d{3}\-\d{2}\-\d{4}\b|\*{3}\-\*{2}\-\d{4}\b", "[SSN_REDACTED]", "g", 1),
    "routing_number": ("[ROUTING_REDACTED]", r"((?:routing|aba|transit)[\s#:]*)\d{9}\b", r"\1[ROUTING_REDACTED]", "gi", 1),
    "account_number": (
        "[ACCT_REDACTED]",
        r"((?:account|acct|acct\.)[\s#:]*(?:number[\s#:]*|num[\s#:]*|no[\s#:]*)?)\d{8,17}\b", r"\1[ACCT_REDACTED]", "gi", 1,
    ),
    "generic_long_number": (
        "[NUMBER_REDACTED]",
        r"((?:order|confirmation|reference|tracking|transaction|member|policy|claim|invoice)[\s#:]*)[\d\-]{10,}\b",
        r"\1[NUMBER_REDACTED]", "gi", 1,
    ),
    "phone_number": (
        "[PHONE_REDACTED]",
        r"\b1[\-\.]?\(?\d{3}\)?[\s\-\.]?\d{3}[\s\-\.]?\d{4}\b|\(?\d{3}\)?[\s\-\.]?\d{3}[\s\-\.]?\d{4}\b", "[PHONE_REDACTED]", "g", 1,
    ),
    "secure_url": (
        "[SECURE_URL_REDACTED]",
        r"https?://[^\s]+[?&](?:token|session|auth|password|key|id)=[^\s]*", "[SECURE_URL_REDACTED]", "gi", 1,
    ),
    "email_address": ("[EMAIL_REDACTED]", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL_REDACTED]", "g", 1),
    "address": (
        "[ADDRESS_REDACTED]",
        r"\b\d{1,6}\s+[A-Za-z0-9\.\s]{2,40}(?:,?\s*(?:Apt|Suite|Ste|Unit|#)\s*[A-Za-z0-9]+)?,?\s*[A-Za-z\s]{2,30},?\s*[A-Z]{2}\s+\d{5}(?:\-\d{4})?\b",
        "[ADDRESS_REDACTED]", "g", 1,
    ),
}
ENTITIES = {
    "entity_IBAN_CODE": ("[IBAN_REDACTED]", rf"(^|[^\[{W}])[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?($|[^{W}\]])", r"\1[IBAN_REDACTED]\2", "g", 2),
    "entity_IP_ADDRESS": ("[IP_REDACTED]", rf"(^|[^\[{W}.])(?:{OCTET}\.){{3}}{OCTET}($|[^{W}\].]|\.$|\.[^0-9])", r"\1[IP_REDACTED]\2", "g", 2),
    "entity_US_SSN": ("[SSN_REDACTED]", rf"(^|[^\[{W}\-])[0-8]\d{{2}}[\- ]\d{{2}}[\- ]\d{{4}}($|[^{W}\]\-])", r"\1[SSN_REDACTED]\2", "g", 2),
    "entity_US_ITIN": ("[SSN_REDACTED]", rf"(^|[^\[{W}\-])9\d{{2}}[\- ](?:5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])[\- ]\d{{4}}($|[^{W}\]\-])", r"\1[SSN_REDACTED]\2", "g", 2),
    "entity_US_PASSPORT": ("[PASSPORT_REDACTED]", rf"(passport(?:\s+(?:number|no\.?|#))?[\s#:]*)(?:[A-Z]\d{{8}}|\d{{9}})($|[^{W}\]])", r"\1[PASSPORT_REDACTED]\2", "gi", 2),
    "entity_US_DRIVER_LICENSE": ("[LICENSE_REDACTED]", rf"((?:driver'?s?\s+licen[cs]e|licen[cs]e\s+(?:number|no\.?|#)|DL)[\s#:]*)[A-Z]\d{{6,8}}($|[^{W}\]])", r"\1[LICENSE_REDACTED]\2", "gi", 2),
    "entity_MEDICAL_LICENSE": ("[LICENSE_REDACTED]", rf"((?:DEA|medical\s+licen[cs]e)[\s#:]*)[A-Z]{{2}}\d{{7}}($|[^{W}\]])", r"\1[LICENSE_REDACTED]\2", "gi", 2),
    "entity_US_BANK_NUMBER": ("[ACCT_REDACTED]", rf"((?:bank|checking|savings|debit)(?:\s+(?:account|acct))?(?:\s+(?:number|no\.?|#))?[\s#:]+)\d{{8,17}}($|[^{W}\]])", r"\1[ACCT_REDACTED]\2", "gi", 2),
    "entity_EMAIL_ADDRESS": ("[EMAIL_REDACTED]", rf"(^|[^\[{W}.])[{W}.+\-]+@[{W}\-]+(?:\.[{W}\-]+)+($|[^{W}\]])", r"\1[EMAIL_REDACTED]\2", "g", 2),
    "entity_PHONE_NUMBER": ("[PHONE_REDACTED]", rf"(^|[^\[{W}])\+\d{{1,3}}[ .\-]?\(?\d{{1,4}}\)?(?:[ .\-]?\d{{2,4}}){{2,4}}($|[^{W}\]])", r"\1[PHONE_REDACTED]\2", "g", 2),
}
LEAK = "[UNKNOWN_PII_REDACTED]"
LEAKS = {
    "long_number": (LEAK, rf"(^|[^{W}\[$,#])\d{{6,}}($|[^{W}\]])", rf"\1{LEAK}\2", "g", 2),
    "ssn_like": (LEAK, rf"(^|[^\[{W}])\d{{3}}\-\d{{2}}\-\d{{4}}($|[^{W}\]])", rf"\1{LEAK}\2", "g", 2),
    "partial_ssn": (LEAK, r"\*+\-\*+\-\d{4}", LEAK, "g", 1),
    "email_like": (LEAK, r"(^|[^\[])\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b($|[^\]])", rf"\1{LEAK}\2", "g", 2),
    "phone_like": (LEAK, r"(^|[^\[])\(?\d{3}\)?[\s\-\.]\d{3}[\s\-\.]\d{4}($|[^\]])", rf"\1{LEAK}\2", "g", 2),
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replace(expression: str, rule: tuple) -> str:
    _, pattern, replacement, flags, passes = rule
    for _ in range(passes):
        expression = f"regexp_replace({expression}, {q(pattern)}, {q(replacement)}, '{flags}')"
    return expression


def _tags(expression: str, tag: str) -> str:
    return f"((length({expression}) - length(replace({expression}, {q(tag)}, ''))) // {len(tag)})"


def luhn(digits: str) -> str:
    """True when the check digit of a digit text is right."""
    return (
        f"(list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 1"
        f" THEN CASE WHEN 2 * cast(substr({digits}, i, 1) as int) > 9 THEN 2 * cast(substr({digits}, i, 1) as int) - 9"
        f" ELSE 2 * cast(substr({digits}, i, 1) as int) END ELSE cast(substr({digits}, i, 1) as int) END)) % 10 = 0)"
    )


def stages(source: str, column: str, rules: dict[str, tuple], name: str) -> str:
    """CTE ``name``: the rows of ``source`` with text ``t_last`` and one ``n_<rule>`` per rule."""
    ctes, before = [], f"SELECT *, {column} AS t0 FROM {source}"
    ctes.append(f"{name}_0 AS ({before})")
    for i, rule in enumerate(rules.values()):
        ctes.append(f"{name}_{i + 1} AS (SELECT *, {_replace(f't{i}', rule)} AS t{i + 1} FROM {name}_{i})")
    counts = ", ".join(
        f"{_tags(f't{i + 1}', rule[0])} - {_tags(f't{i}', rule[0])} AS n_{key}" for i, (key, rule) in enumerate(rules.items())
    )
    ctes.append(f"{name} AS (SELECT *, t{len(rules)} AS t_last, {counts} FROM {name}_{len(rules)})")
    return ",\n".join(ctes)


ALL_PASSES = {**PASS1, **ENTITIES, **LEAKS}


def redacted(source: str, column: str, name: str) -> str:
    """CTE ``name`` with clean_text, redaction_count, fixes, is_valid over all three passes."""
    found = " + ".join(f"n_{k}" for k in ALL_PASSES)
    fixes = " + ".join(f"n_{k}" for k in LEAKS)
    return (
        stages(source, column, ALL_PASSES, f"{name}_st")
        + f",\n{name} AS MATERIALIZED (SELECT *, t_last AS clean_text, {found} AS redaction_count, {fixes} AS fixes, ({fixes}) = 0 AS is_valid FROM {name}_st)"
    )


# --- rule expressions ------------------------------------------------------------------


def any_regex(column: str, patterns, flags: str = "i") -> str:
    return f"regexp_matches({column}, {q('|'.join(f'(?:{p})' for p in patterns))}, '{flags}')"


def any_word(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def block_reason(sender: str = "sender", subject: str = "subject") -> str:
    rules = Blocklist.default()
    listed = lambda values: "(" + ", ".join(q(v) for v in values) + ")"
    address = f"trim(split_part(lower({sender}), '<', -1), '>')"
    return (
        f"CASE WHEN lower({sender}) IN {listed(rules.senders)} THEN 'sender'"
        f" WHEN contains({sender}, '@') AND trim(split_part({address}, '@', -1)) IN {listed(rules.domains)} THEN 'domain'"
        f" WHEN {any_word(f'lower({subject})', rules.subjects)} THEN 'subject' ELSE '' END"
    )


def _head(text: str, chars: int | None) -> str:
    return text if chars is None else f"left({text}, {chars})"


def is_promotional(subject: str, body: str, chars: int | None = None) -> str:
    return (
        f"({any_regex(f'lower({subject})', X.PROMO_SUBJECTS + X.INFO_SUBJECTS)}"
        f" OR {any_regex(f'lower({_head(body, chars)})', X.PROMO_BODIES)})"
    )


def promo_merchant(merchant: str) -> str:
    return any_word(f"lower({merchant})", X.PROMO_MERCHANTS)


def amounts(text: str, subject: str) -> str:
    full = f"concat({subject}, chr(10), {text})"
    found = "flatten([" + ", ".join(f"regexp_extract_all({full}, {q('(?i)' + p)}, 1)" for p in X.AMOUNTS) + "])"
    values = f"list_transform({found}, lambda m: cast(replace(m, ',', '') as double))"
    return f"list_sort(list_distinct(list_filter({values}, lambda v: v >= 0.01::DOUBLE AND v <= 999999)))"


def marketing_footer(body: str) -> str:
    return (
        f"(length({body}) > 1000 AND contains(lower(right({body}, 500)), 'unsubscribe')"
        f" AND len({amounts(f'left({body}, 1000)', q(''))}) = 0)"
    )


def has_confirmation(subject: str, body: str, chars: int | None = None) -> str:
    return any_regex(f"lower(concat({subject}, ' ', {_head(body, chars)}))", X.CONFIRMATIONS, "c")


def merchant(sender: str, subject: str, body: str, chars: int | None = None, name_chars: int | None = None) -> str:
    shown = f"trim(replace(trim(split_part({sender}, '<', 1)), '\"', ''))"
    found = [f"CASE WHEN NOT starts_with({sender}, 'no-reply') AND NOT starts_with({sender}, 'noreply') THEN {shown} END"]
    found += [f"trim(regexp_extract({subject}, {q(p)}, 1, 'i'))" for p in X.MERCHANT_SUBJECTS]
    found += [
        f"regexp_replace(trim(regexp_extract({_head(body, chars)}, {q(p)}, 1, 'i')), '\\s+', ' ', 'g')" for p in X.MERCHANT_BODIES
    ]
    label = f"split_part(split_part(trim(split_part({sender}, '<', -1), '>'), '@', -1), '.', 1)"
    found.append(f"CASE WHEN contains({sender}, '@') THEN concat(upper(left({label}, 1)), lower(substr({label}, 2))) END")
    return "coalesce(" + ", ".join(f"CASE WHEN length({m}) > 2 THEN {_head(m, name_chars)} END" for m in found) + ")"


def _month(text: str) -> str:
    flat = f"regexp_replace({text}, '\\s+', ' ', 'g')"
    return f"coalesce(try_strptime({flat}, '%b %d, %Y'), try_strptime({flat}, '%B %d, %Y'))"


def body_date(body: str, chars: int | None = None) -> str:
    paid, slashed, iso, named = (f"regexp_extract({_head(body, chars)}, {q(p)}, 1, 'i')" for p in X.DATES)
    return (
        f"strftime(coalesce({_month(paid)}, try_strptime({slashed}, '%m/%d/%Y'), try_strptime({iso}, '%Y-%m-%d'),"
        f" {_month(named)}), '%Y-%m-%d')"
    )


def header_date(value: str, as_of: str) -> str:
    rfc = f"try_strptime(regexp_extract({value}, '\\b(\\d{{1,2}} [A-Za-z]{{3}} \\d{{4}})\\b', 1), '%d %b %Y')"
    return (
        f"CASE WHEN regexp_matches({value}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {value}"
        f" WHEN regexp_matches({value}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T') THEN left({value}, 10)"
        f" ELSE strftime(coalesce({rfc}, TIMESTAMP {q(as_of)}), '%Y-%m-%d') END"
    )


def payment_method(body: str, chars: int | None = None) -> str:
    early = _head(f"lower({body})", chars)
    whens = []
    for name, groups in X.PAYMENT_METHODS:
        tests = " OR ".join("(" + " AND ".join(f"contains({early}, {q(w)})" for w in words) + ")" for words in groups)
        whens.append(f"WHEN {tests} THEN {q(name)}")
    return "CASE " + " ".join(whens) + " END"


def category(merchant_sql: str, context: str) -> str:
    text = f"lower(concat({merchant_sql}, ' ', {context}))"
    whens = [f"WHEN regexp_matches({text}, {q(p)}, 'i') THEN {q(name)}" for p, name in C.PRIORITY_PATTERNS]
    whens += [f"WHEN {any_word(text, words)} THEN {q(name)}" for name, words in C.CATEGORY_KEYWORDS]
    return "CASE " + " ".join(whens) + f" ELSE {q(C.DEFAULT_CATEGORY)} END"


def category_hint(subject: str, merchant_sql: str) -> str:
    text = f"lower(concat({subject}, ' ', {merchant_sql}))"
    issuer = any_word(text, C.HINT_ISSUERS)
    whens = [f"WHEN {issuer} AND {any_word(text, C.HINT_REWARDS)} THEN 'income'", f"WHEN {issuer} THEN 'bills'"]
    whens += [f"WHEN {any_word(text, words)} THEN {q(name)}" for name, words in C.HINT_KEYWORDS]
    return "CASE " + " ".join(whens) + f" ELSE {q(C.DEFAULT_HINT)} END"


def is_subscription(merchant_sql: str, context: str) -> str:
    return f"({any_word(f'lower({merchant_sql})', C.SUBSCRIPTION_MERCHANTS)} OR {any_word(f'lower({context})', C.SUBSCRIPTION_CONTEXT)})"


def summary_merchant() -> str:
    label = "regexp_extract(sender_email, '@([\\w\\-]+)\\.', 1)"
    words = f"string_split(replace({label}, '-', ' '), ' ')"
    titled = f"array_to_string(list_transform({words}, lambda w: concat(upper(left(w, 1)), lower(substr(w, 2)))), ' ')"
    return f"CASE WHEN sender_name <> '' AND sender_name <> sender_email THEN sender_name WHEN {label} <> '' THEN {titled} ELSE 'Unknown' END"


# The two patterns with a look-ahead: a hit exists when more openings than excused ones do.
LOOKAHEAD = {
    "role_override": (r"you\s+are\s+now\s+", r"you\s+are\s+now\s+a\s+secure"),
    "act_as": (r"act\s+as\s+(?:if\s+you\s+are|a|an)\s+", r"act\s+as\s+(?:if\s+you\s+are|a|an)\s+secure\s+finance"),
}


def base64_payload(text: str) -> str:
    runs = f"list_filter(regexp_extract_all({text}, {q(I.BASE64_RUN)}), lambda r: length(r) % 4 = 0)"
    decoded = "lower(decode(from_base64(r)))"
    tests = " AND ".join(any_word(decoded, w) for w in (I.PAYLOAD_KEYWORDS, I.PAYLOAD_COMMANDS, I.PAYLOAD_TARGETS))
    return f"(NOT {any_word(text, I.MIME_MARKS)} AND len(list_filter({runs}, lambda r: {tests})) > 0)"


def patterns_found(text: str) -> str:
    items = []
    for name, regex in I.PATTERNS:
        if name in LOOKAHEAD:
            opening, excused = LOOKAHEAD[name]
            test = f"len(regexp_extract_all({text}, {q('(?i)' + opening)})) > len(regexp_extract_all({text}, {q('(?i)' + excused)}))"
        else:
            test = f"regexp_matches({text}, {q(regex)}, 'i')"
        items.append(f"CASE WHEN {test} THEN {q(name)} END")
    items.append(f"CASE WHEN {base64_payload(text)} THEN {q(I.BASE64)} END")
    return f"list_filter([{', '.join(items)}], lambda n: n IS NOT NULL)"


def risk(found: str) -> str:
    listed = lambda names: "[" + ", ".join(q(n) for n in names) + "]"
    return (
        f"CASE WHEN len({found}) = 0 THEN 'none' WHEN list_has_any({found}, {listed(I.HIGH_RISK)}) THEN 'high'"
        f" WHEN list_has_any({found}, {listed(I.MEDIUM_RISK)}) THEN 'medium' ELSE 'low' END"
    )


def html_to_text(html: str, max_chars: int | None) -> str:
    """Lines of a page without tables: what stands between its tags, a line for each piece."""
    text = html
    for unread in (r"(?s)<!--.*?-->", *(rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>" for tag in ("script", "style", "head", "svg", "noscript"))):
        text = f"regexp_replace({text}, {q(unread)}, chr(1), 'g')"
    pieces = f"list_filter(string_split_regex({text}, '<[/!?a-zA-Z][^>]*>|' || chr(1)), lambda s: NOT regexp_matches(s, '(?i)data:image|content-transfer-encoding:\\s*base64'))"
    text = f"array_to_string({pieces}, chr(10))"
    for entity, code in (("nbsp", 160), ("lt", 60), ("gt", 62), ("quot", 34), ("#39", 39), ("middot", 183), ("copy", 169), ("amp", 38)):
        text = f"replace({text}, '&{entity};', chr({code}))"
    lines = f"list_transform(string_split_regex({text}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]'), lambda s: regexp_replace(s, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g'))"
    joined = f"array_to_string(list_filter({lines}, lambda s: s <> ''), chr(10))"
    return truncated(joined, max_chars)


def truncated(text: str, max_chars: int | None) -> str:
    if max_chars is None:
        return text
    return f"(SELECT CASE WHEN length(x) > {max_chars} THEN concat(left(x, {max_chars}), chr(10), '[...truncated]') ELSE x END FROM (SELECT {text} AS x))"


# --- shared CTEs ------------------------------------------------------------------------


def clean_mail(extra: str = "") -> str:
    """WITH clause: mail, its block reason, and ``clean`` (unblocked mail after all passes)."""
    return (
        f"WITH {V.mail_cte()},\n"
        f"reasons AS (SELECT *, {block_reason()} AS reason FROM mail),\n"
        f"open_mail AS (SELECT * FROM reasons WHERE reason = ''),\n"
        + redacted("open_mail", "body", "clean")
        + (",\n" + extra if extra else "")
    )


def extracted_ctes(source: str = "clean", name: str = "extracted") -> str:
    text = "clean_text"
    return (
        f"{name}_a AS (SELECT * FROM {source} WHERE {text} <> '' AND NOT {is_promotional('subject', text)} AND NOT {marketing_footer(text)}),\n"
        f"{name}_b AS (SELECT *, {merchant('sender', 'subject', text)} AS merchant, list_max({amounts(text, 'subject')}) AS amount FROM {name}_a),\n"
        f"{name} AS MATERIALIZED (SELECT id AS email_id, seq, subject, merchant, amount, coalesce({body_date(text)}, {header_date('date', V.MAIL_AS_OF)}) AS date,"
        f" {payment_method(text)} AS payment_method_type FROM {name}_b WHERE merchant IS NOT NULL AND NOT {promo_merchant('merchant')}"
        f" AND amount IS NOT NULL AND (amount <= 500 OR {has_confirmation('subject', text)}))"
    )


def ledger_ctes() -> str:
    return extracted_ctes() + (
        f",\nledger AS MATERIALIZED (SELECT sha256(concat_ws('|', email_id, merchant, AMOUNT_TEXT, date)) AS id, strptime(date, '%Y-%m-%d') AS date,"
        f" merchant, amount, {category('merchant', 'subject')} AS category, {is_subscription('merchant', 'subject')} AS is_subscription,"
        " email_id AS source_email_id, 0.8::DOUBLE AS confidence, subject, payment_method_type, seq FROM extracted)"
    ).replace("AMOUNT_TEXT", "cast(amount as varchar)")


def duplicate_pairs(ledger: str = "txn") -> str:
    """CTE ``dups``: first later match of every row, by comparing all rows of a merchant."""
    micros = "abs(date_diff('microsecond', a.date, b.date))"
    return (
        f"dups AS (SELECT a.seq, min(a.id) AS id, min(b.seq) AS dup_seq, arg_min(b.id, b.seq) AS dup_id, min(a.merchant) AS merchant,"
        f" min(a.amount) AS amount, arg_min({micros}, b.seq) / 3.6e9 AS hours FROM {ledger} a JOIN {ledger} b"
        " ON lower(a.merchant) = lower(b.merchant) AND a.seq < b.seq AND abs(a.amount - b.amount) <= 0.01::DOUBLE"
        f" AND (a.date IS NULL OR b.date IS NULL OR {micros} <= 86400000000)"
        " WHERE a.merchant <> '' AND a.amount <> 0 GROUP BY a.seq)"
    )


def audit_ctes() -> str:
    """CTE ``chain``: the audit rows of every chain segment linked one after the other."""
    entry = "concat_ws('|', acc, r.id, r.timestamp, r.action, r.tool_used, r.details, cast(r.redactions_applied as varchar), cast(r.security_flags as varchar), r.level)"
    return (
        f"{V.audit_events_cte()},\n"
        "audit_rows AS (SELECT *, seq // 4096 AS segment, row_number() OVER (PARTITION BY chain_id, seq // 4096 ORDER BY seq) AS pos FROM audit_events),\n"
        "linked AS (SELECT r.chain_id, r.segment, r.seq, r.pos, 'GENESIS' AS acc, sha256(" + entry.replace("acc", "'GENESIS'", 1) + ") AS h FROM audit_rows r WHERE pos = 1\n"
        " UNION ALL SELECT r.chain_id, r.segment, r.seq, r.pos, l.h, sha256(" + entry.replace("acc", "l.h", 1) + ") FROM linked l JOIN audit_rows r"
        " ON r.chain_id = l.chain_id AND r.segment = l.segment AND r.pos = l.pos + 1),\n"
        "chain AS (SELECT a.*, l.acc AS previous_hash, l.h AS entry_hash FROM audit_rows a JOIN linked l USING (chain_id, segment, seq))"
    )
