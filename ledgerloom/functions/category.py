"""Category functions over a merchant name and its context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import categories as R
from .text import IGNORE_CASE, any_word, contains_any, let, searchable, text_or_empty

# Word lists of which each must have a word in the text before the priority pattern in the same place is tried.
_ISSUERS = ("discover", "chase", "capital one", "citi", "amex", "american express", "bank of america")
_REWARDS = ("cashback", "cash back", "reward", "bonus", "rebate")
_DUE = ("statement", "balance due", "minimum payment", "amount due", "payment received")
PRIORITY_HINTS = (
    (_ISSUERS, _REWARDS),
    (_ISSUERS, _REWARDS),
    (_ISSUERS, (*_DUE, "payment confirmation", "thank you for your payment")),
    (_ISSUERS, _DUE),
    (("discover card", "chase sapphire", "chase freedom", "capital one", "citi card", "citibank", "amex", "american express", "bank of america"),),
    (("cashback", "cash back", "reward", "refund", "reimbursement"),),
    (("received", "deposit"),),
    (("payment",),),
    (("payment",), ("card",)),
    (("southwest", "united", "delta", "american airlines", "jetblue"),),
    (("doordash", "grubhub", "ubereats", "postmates"),),
)


def _chain(rules: list[tuple[Column, str]], default: str) -> Column:
    out = None
    for hit, name in rules:
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default))


def category(merchant: Column, context: Column) -> Column:
    """Ledger category: priority patterns first, then keyword lists in order."""
    text = F.lower(F.concat(text_or_empty(merchant), F.lit(" "), text_or_empty(context)))

    def of(t: Column, low: Column) -> Column:
        rules = []
        for (regex, name), lists in zip(R.PRIORITY_PATTERNS, PRIORITY_HINTS, strict=True):
            hit = any_word(low, lists[0])
            for words in lists[1:]:
                hit = hit & any_word(low, words)
            rules.append((hit & t.rlike(IGNORE_CASE + regex), name))
        rules += [(any_word(t, words), name) for name, words in R.CATEGORY_KEYWORDS]
        return _chain(rules, R.DEFAULT_CATEGORY)

    return let(text, lambda t: let(searchable(t), lambda low: of(t, low)))


def category_hint(subject: Column, merchant: Column) -> Column:
    """Coarse hint of the mail summary: card issuers first, then keyword lists."""
    text = F.lower(F.concat(text_or_empty(subject), F.lit(" "), text_or_empty(merchant)))
    issuer = contains_any(text, R.HINT_ISSUERS)
    rules = [(issuer & contains_any(text, R.HINT_REWARDS), "income"), (issuer, "bills")]
    rules += [(contains_any(text, words), name) for name, words in R.HINT_KEYWORDS]
    return _chain(rules, R.DEFAULT_HINT)


def is_subscription(merchant: Column, context: Column) -> Column:
    known = contains_any(F.lower(text_or_empty(merchant)), R.SUBSCRIPTION_MERCHANTS)
    return known | contains_any(F.lower(text_or_empty(context)), R.SUBSCRIPTION_CONTEXT)
