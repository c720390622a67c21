"""Scalar rules as SQL functions, so that Catalyst still sees plain expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.redact import GATES, replaced
from ..rules import categories, extraction, injection, pii
from .text import IGNORE_CASE, quoted_alternation, sql_literal


def _redact(expression: str) -> str:
    """All three passes, stage by stage as in ``operators.redact``; a stage is given its text by name and passes it on where its gate is shut."""
    for p in pii.PATTERNS + pii.ENTITIES + pii.LEAKS:
        gate = GATES[p.gate].format(t="whole", d="whole")
        expression = f"transform(array({expression}), whole -> CASE WHEN {gate} THEN {replaced('whole', p)} ELSE whole END)[0]"
    return f"coalesce({expression}, '{pii.REDACTION_ERROR}')"


def _risk() -> str:
    tests = {name: f"x RLIKE {sql_literal(IGNORE_CASE + regex)}" for name, regex in injection.PATTERNS}
    words = lambda text, listed: f"{text} RLIKE {sql_literal(quoted_alternation(listed))}"
    order = " AND ".join(words("d", listed) for listed in (injection.PAYLOAD_KEYWORDS, injection.PAYLOAD_COMMANDS, injection.PAYLOAD_TARGETS))
    runs = f"filter(regexp_extract_all(x, {sql_literal(injection.BASE64_RUN)}, 0), r -> length(r) % 4 = 0)"
    decoded = f"transform({runs}, r -> lower(make_valid_utf8(cast(try_to_binary(r, 'base64') AS string))))"
    tests[injection.BASE64] = f"(x RLIKE '[A-Za-z0-9+/]{{60}}' AND NOT {words('x', injection.MIME_MARKS)} AND exists({decoded}, d -> coalesce({order}, false)))"
    any_of = lambda names: " OR ".join(tests[n] for n in names) or "false"
    rest = [n for n in tests if n not in injection.HIGH_RISK + injection.MEDIUM_RISK]
    return f"CASE WHEN {any_of(injection.HIGH_RISK)} THEN 'high' WHEN {any_of(injection.MEDIUM_RISK)} THEN 'medium' WHEN {any_of(rest)} THEN 'low' ELSE 'none' END"


def _category() -> str:
    text = "lower(concat(coalesce(merchant, ''), ' ', coalesce(context, '')))"
    whens = [f"WHEN {text} RLIKE {sql_literal(IGNORE_CASE + p)} THEN '{name}'" for p, name in categories.PRIORITY_PATTERNS]
    whens += [
        f"WHEN {text} RLIKE {sql_literal(quoted_alternation(words))} THEN '{name}'"
        for name, words in categories.CATEGORY_KEYWORDS
    ]
    return "CASE " + " ".join(whens) + f" ELSE '{categories.DEFAULT_CATEGORY}' END"


def _payment() -> str:
    early = "lower(x)"
    whens = []
    for name, groups in extraction.PAYMENT_METHODS:
        tests = [" AND ".join(f"contains({early}, '{w}')" for w in words) for words in groups]
        whens.append("WHEN " + " OR ".join(f"({t})" for t in tests) + f" THEN '{name}'")
    return "CASE " + " ".join(whens) + " END"


def register(spark: SparkSession) -> None:
    """Create redact_text, injection_risk, category_of and payment_method in this session."""
    definitions = {
        "redact_text(x STRING)": _redact("x"),
        "injection_risk(x STRING)": _risk(),
        "category_of(merchant STRING, context STRING)": _category(),
        "payment_method(x STRING)": _payment(),
    }
    for signature, body in definitions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {body}")
