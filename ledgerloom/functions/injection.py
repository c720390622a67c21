"""Prompt-injection functions; each returns a Column over one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import injection as R
from .text import IGNORE_CASE, any_word, contains_any, folded, text_or_empty


def base64_payload(text: Column) -> Column:
    """True when a long base64 run decodes to an order about protected data."""

    def is_order(run: Column) -> Column:
        decoded = F.lower(F.make_valid_utf8(F.try_to_binary(run, F.lit("base64")).cast("string")))
        return F.coalesce(
            contains_any(decoded, R.PAYLOAD_KEYWORDS)
            & contains_any(decoded, R.PAYLOAD_COMMANDS)
            & contains_any(decoded, R.PAYLOAD_TARGETS),
            F.lit(False),
        )

    runs = F.filter(F.regexp_extract_all(text, F.lit(R.BASE64_RUN), F.lit(0)), lambda r: F.length(r) % 4 == 0)
    no_run = ~text.rlike("[A-Za-z0-9+/]{60}")
    return F.when(no_run | contains_any(text, R.MIME_MARKS), F.lit(False)).otherwise(F.exists(runs, is_order))


# Words one of which must occur before the regex is tried; substring tests are far cheaper.
HINTS = {
    "ignore_instructions": ("ignore",),
    "ignore_all_rules": ("ignore",),
    "system_prompt": ("prompt", "message"),
    "output_reveal": ("number",),
    "data_exfiltration": ("number",),
    "forget_instructions": ("forget",),
    "role_override": ("now",),
    "act_as": ("act",),
    "disregard": ("disregard", "override", "bypass", "circumvent", "disable"),
    "do_not_redact": ("not",),
}
# And one of these, for the patterns whose first word is frequent.
MORE_HINTS = {
    "output_reveal": ("all", "every"),
    "data_exfiltration": ("all", "every"),
    "role_override": ("are",),
    "disregard": ("your", "all", "the", "any"),
}


def patterns_found(text: Column, low: Column | None = None) -> Column:
    """Names of the matching patterns in list order; ``low`` is ``folded(text)`` where it is at hand."""
    safe = text_or_empty(text)
    low = folded(safe) if low is None else text_or_empty(low)
    names = []
    for name, regex in R.PATTERNS:
        hint = low.contains(HINTS[name][0])
        for word in HINTS[name][1:]:
            hint = hint | low.contains(word)
        if name in MORE_HINTS:
            hint = hint & any_word(low, MORE_HINTS[name])
        names.append(F.when(hint & safe.rlike(IGNORE_CASE + regex), F.lit(name)))
    names.append(F.when(base64_payload(safe), F.lit(R.BASE64)))
    return F.array_compact(F.array(*names))


def risk_level(found: Column) -> Column:
    high = F.array(*[F.lit(n) for n in R.HIGH_RISK])
    medium = F.array(*[F.lit(n) for n in R.MEDIUM_RISK])
    return (
        F.when(F.size(found) == 0, F.lit("none"))
        .when(F.arrays_overlap(found, high), F.lit("high"))
        .when(F.arrays_overlap(found, medium), F.lit("medium"))
        .otherwise(F.lit("low"))
    )
