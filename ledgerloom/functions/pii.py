"""Redaction as plain Column expressions, for SQL functions and short texts.

``operators.redact`` is the form for large tables: it tests cheap conditions
first and also returns counts and details.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import pii as R
from .text import let


def fold_digits(text: Column) -> Column:
    """Full-width digits to ASCII, so that look-alike digits are seen by every rule."""
    wide = "".join(chr(0xFF10 + i) for i in range(10))
    return F.translate(text, wide, "0123456789")


def redact_patterns(text: Column) -> Column:
    """Pass 1: every pattern in order, each on the output of the one before."""
    for p in R.PATTERNS:
        text = F.regexp_replace(text, p.regex, p.replacement)
    return text


def redact_leaks(text: Column) -> Column:
    """Pass 3: whatever still looks like personal data."""
    for p in R.LEAKS:
        text = let(text, _finds_replaced(p)) if p.skip_spans else F.regexp_replace(text, p.regex, p.replacement)
    return text


def _finds_replaced(p: R.Pattern) -> Callable[[Column], Column]:
    """Matches that are harmless spans stay, those that start with a digit go."""
    shown = lambda m: F.when(m.rlike(r"(?U)^\d"), p.replacement).otherwise(m)

    def replace(text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)), shown)
        return F.array_join(F.zip_with(F.split(text, p.regex, -1), F.concat(found, F.array(F.lit(""))), lambda t, m: F.concat(t, m)), "")

    return replace


def redact_text(text: Column) -> Column:
    """Pass 1 and pass 3; NULL gives the sentinel."""
    return F.coalesce(redact_leaks(redact_patterns(text)), F.lit(R.REDACTION_ERROR))
