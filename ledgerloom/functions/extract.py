"""Merchant, amount, date and payment method of one mail, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import extraction as R
from .text import (
    all_groups,
    any_word,
    collapse_spaces,
    contains_any,
    first_long_enough,
    group1,
    head,
    let,
    matches_any,
    searchable,
    strip,
    text_or_empty,
)


# Words one of which must occur before a rule's regex is tried, in the order of the rules.
PROMO_BODY_HINTS = ("unsubscribe", "preferences", "click", "promotional")
CONFIRMATION_HINTS = ("purchased", "paid", "ordered", "booked", "confirm", "receipt", "invoice", "transaction", "charged", "billed", "card")
MERCHANT_SUBJECT_HINTS = ("receipt from ", "order from ", "payment to ", "your ", " order confirmation", "thank you for")
MERCHANT_BODY_HINTS = ("receipt from ", "order from ", "sold ", "merchant:", "payment to ", "purchased at ", "you paid ")
AMOUNT_HINTS = (
    ("$",), ("usd",), ("total", "amount", "paid", "charge", "price", "cost"), ("you paid", "you're paying", "payment of"), ("order total", "total due", "amount due"),
)


def is_promotional(subject: Column, body: Column, merchant: Column | None = None, chars: int | None = None) -> Column:
    """Marketing or informational mail rather than a purchase; ``chars`` limits how much of the body is read."""
    subject_hit = matches_any(F.lower(text_or_empty(subject)), R.PROMO_SUBJECTS + R.INFO_SUBJECTS)
    body_hit = let(F.lower(head(text_or_empty(body), chars)), lambda t: let(searchable(t), lambda low: any_word(low, PROMO_BODY_HINTS)) & matches_any(t, R.PROMO_BODIES))
    hit = subject_hit | body_hit
    if merchant is None:
        return hit
    return is_promotional_merchant(merchant) | hit


def is_promotional_merchant(merchant: Column) -> Column:
    return contains_any(F.lower(text_or_empty(merchant)), R.PROMO_MERCHANTS)


def marketing_footer(body: Column, start: int = R.FOOTER_MIN_CHARS, end: int = R.FOOTER_TAIL_CHARS) -> Column:
    """Long mail that ends in an unsubscribe footer and names no amount early on."""
    tail = F.lower(F.right(body, F.lit(end)))
    early = amounts(head(body, start), F.lit(""))
    return (F.length(body) > start) & tail.contains("unsubscribe") & (F.size(early) == 0)


def has_confirmation(subject: Column, body: Column, chars: int | None = None) -> Column:
    text = F.lower(F.concat(text_or_empty(subject), F.lit(" "), head(text_or_empty(body), chars)))
    return let(text, lambda t: any_word(t, CONFIRMATION_HINTS) & matches_any(t, R.CONFIRMATIONS, flags="(?Ud)"))


def domain_label(sender: Column) -> Column:
    """'alerts@walmart.com' -> 'walmart'; NULL without an @."""
    address = F.regexp_replace(F.substring_index(sender, "<", -1), r"^>+|>+$", "")
    label = F.substring_index(F.substring_index(address, "@", -1), ".", 1)
    return F.when(sender.contains("@"), label)


def merchant(sender: Column, subject: Column, body: Column, chars: int | None = None, name_chars: int | None = None) -> Column:
    """Display name, else subject wording, else body wording, else the domain label; NULL without one."""
    sender, subject, body = text_or_empty(sender), text_or_empty(subject), text_or_empty(body)
    shown = strip(F.replace(strip(F.substring_index(sender, "<", 1)), F.lit('"'), F.lit("")))
    robot = sender.startswith("no-reply") | sender.startswith("noreply")
    early_body = head(body, chars)
    label = domain_label(sender)
    found = lambda candidates: first_long_enough(candidates, longer_than=2, cut=name_chars)
    in_subject = lambda t, low: found([F.when(low.contains(w), strip(group1(t, p))) for p, w in zip(R.MERCHANT_SUBJECTS, MERCHANT_SUBJECT_HINTS, strict=True)])
    in_body = lambda t, low: found([F.when(low.contains(w), collapse_spaces(strip(group1(t, p)))) for p, w in zip(R.MERCHANT_BODIES, MERCHANT_BODY_HINTS, strict=True)])
    return F.coalesce(
        found([F.when(~robot, shown)]),
        let(subject, lambda t: let(searchable(t), lambda low: in_subject(t, low))),
        let(early_body, lambda t: let(searchable(t), lambda low: in_body(t, low))),
        found([F.concat(F.upper(head(label, 1)), F.lower(F.substr(label, F.lit(2))))]),
    )


def amounts(text: Column, subject: Column, strict: bool = False) -> Column:
    """Distinct amounts in ascending order.

    A plain number of four or more digits yields its first three, as the fixed
    patterns say; ``strict`` reads it whole.
    """
    full = F.concat(text_or_empty(subject), F.lit("\n"), text_or_empty(text))
    grouped = r"\d{1,3}(?:,\d{3})*"
    patterns = R.AMOUNTS
    if strict:
        patterns = [p.replace(grouped, r"(?:\d{1,3}(?:,\d{3})+(?!\d)|\d+)") for p in patterns]
    none = F.array().cast("array<string>")
    groups = lambda t, low: F.flatten(F.array(*[F.when(any_word(low, words), all_groups(t, p)).otherwise(none) for p, words in zip(patterns, AMOUNT_HINTS, strict=True)]))
    found = let(full, lambda t: let(searchable(t), lambda low: groups(t, low)))
    values = F.transform(found, lambda m: F.replace(m, F.lit(","), F.lit("")).try_cast("double"))
    low, high = R.AMOUNT_RANGE
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.between(low, high))))


def _named_month(text: Column) -> Column:
    # A format that fails costs an exception: none is tried on an empty text, nor the short names on a long one.
    short = lambda t: F.when(~t.rlike(r"^\S{4}"), F.try_to_date(t, "MMM d, yyyy"))
    return let(collapse_spaces(text), lambda t: F.when(t != "", F.coalesce(short(t), F.try_to_date(t, "MMMM d, yyyy"))))


def body_date(text: Column, chars: int | None = None) -> Column:
    """First parsable date of a body, or of its first ``chars`` characters, as 'yyyy-MM-dd'; NULL without one."""
    early = head(text_or_empty(text), chars)
    paid, slashed, iso, named = R.DATES

    def numbers(found: Column, form: str) -> Column:
        return let(found, lambda f: F.when(f != "", F.try_to_date(f, form)))

    def day(t: Column) -> Column:
        return F.coalesce(
            F.when(searchable(t).contains("date"), _named_month(group1(t, paid))),
            F.when(t.contains("/"), numbers(group1(t, slashed), "M/d/yyyy")),
            F.when(t.contains("-"), numbers(group1(t, iso), "yyyy-MM-dd")),
            F.when(t.rlike(r"(?Ud)\d,?\s+\d{4}"), _named_month(group1(t, named))),
        )

    return F.date_format(let(early, day), "yyyy-MM-dd")


def header_date(value: Column, as_of: Column) -> Column:
    """Date header as 'yyyy-MM-dd' in its own time zone; ``as_of`` when it cannot be read."""
    value = text_or_empty(value)
    rfc = F.try_to_date(F.regexp_extract(value, r"\b(\d{1,2} [A-Za-z]{3} \d{4})\b", 1), "d MMM yyyy")
    other = F.coalesce(_named_month(value), F.try_to_date(value, "M/d/yyyy"))
    return (
        F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value)
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}T"), head(value, 10))
        .otherwise(F.date_format(F.coalesce(rfc, other, as_of.cast("date")), "yyyy-MM-dd"))
    )


def payment_method(text: Column, chars: int | None = None) -> Column:
    """First payment method in rule order whose words occur in the text, or in its first ``chars`` characters; NULL without one."""
    return let(head(F.lower(text_or_empty(text)), chars), _payment_method)


def _payment_method(early: Column) -> Column:
    rules = None
    for name, groups in R.PAYMENT_METHODS:
        hit = None
        for words in groups:
            every = None
            for word in words:
                every = early.contains(word) if every is None else every & early.contains(word)
            hit = every if hit is None else hit | every
        rules = F.when(hit, F.lit(name)) if rules is None else rules.when(hit, F.lit(name))
    return rules


def summary_merchant(sender: Column, email: Column) -> Column:
    """Display name, else the domain label in title case, else 'Unknown'."""
    label = F.regexp_extract(email, r"(?U)@([\w\-]+)\.", 1)
    titled = F.initcap(F.replace(label, F.lit("-"), F.lit(" ")))
    return (
        F.when((text_or_empty(sender) != "") & ~sender.eqNullSafe(email), sender)
        .when(label != "", titled)
        .otherwise(F.lit("Unknown"))
    )


def dollar_strings(text: Column) -> Column:
    return all_groups(text_or_empty(text), R.DOLLARS, group=0, flags="(?U)")


def quick_merchant(subject: Column, body: Column) -> Column:
    """First word after a merchant cue in the body, else after 'at ' or 'to ' in the subject."""

    def first_word(text: Column) -> Column:
        return F.regexp_extract(text, r"(?U)^\s*(\S+)", 1)

    cue = None
    for word in ("Merchant:", "merchant:", "payment to", "at "):
        after = F.substr(body, F.instr(body, word) + F.lit(len(word)))
        line = F.substring_index(after, "\n", 1)
        hit = body.contains(word)
        cue = F.when(hit, first_word(line)) if cue is None else cue.when(hit, first_word(line))
    fallback = F.when(subject.contains("at "), first_word(F.substring_index(subject, "at ", -1))).when(
        subject.contains("to "), first_word(F.substring_index(subject, "to ", -1))
    )
    return F.coalesce(F.nullif(cue, F.lit("")), F.nullif(fallback, F.lit("")))


def quick_amount(subject: Column, body: Column) -> Column:
    """First dollar amount of subject and body."""
    text = F.concat(subject, F.lit(" "), body)
    digits = F.regexp_extract(text, r"\$(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)", 1)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")
