"""Small text helpers shared by the rule functions; all return a Column."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TESTS = 128  # longer word lists are one regex, which keeps the plan small
IGNORE_CASE = "(?iUd)"  # ignore case, Unicode classes, "." stops only at \n


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once and written once into the expression."""
    return F.get(F.transform(F.array(value), use), 0)


def quoted_alternation(words: Iterable[str]) -> str:
    """Regex that matches any of the words literally."""
    return "|".join(rf"\Q{w}\E" for w in words)


def sql_literal(text: str) -> str:
    """``text`` as a raw SQL string literal, so that regexes keep their backslashes."""
    return f"r'{text}'" if "'" not in text else f'r"{text}"'


def any_word(text: Column, words: Iterable[str]) -> Column:
    """True where one of the words stands in the text; substring tests cost far less than one regex of all words."""
    return reduce(or_, [text.contains(w) for w in words])


def contains_any(text: Column, words: Iterable[str]) -> Column:
    words = tuple(words)
    return let(text, lambda t: any_word(t, words)) if 0 < len(words) <= MAX_TESTS else text.rlike(quoted_alternation(words))


def matches_any(text: Column, patterns: Iterable[str], flags: str = IGNORE_CASE) -> Column:
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def group1(text: Column, pattern: str, flags: str = IGNORE_CASE) -> Column:
    """First group of the first match, '' without one."""
    return F.regexp_extract(text, flags + pattern, 1)


def all_groups(text: Column, pattern: str, group: int = 1, flags: str = IGNORE_CASE) -> Column:
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))


def folded(text: Column) -> Column:
    """Lower case, with the two letters that only case-folding regexes see as s and i."""
    return F.replace(F.replace(F.lower(text), F.lit("\u017f"), F.lit("s")), F.lit("\u0131"), F.lit("i"))


def searchable(text: Column) -> Column:
    """Text in which the words of case-folding regexes are looked up by substring: ``folded``, the dotted capital I as i."""
    return F.replace(folded(text), F.lit("i\u0307"), F.lit("i"))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def head(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters; ``None`` keeps the whole text."""
    return text if chars is None else F.left(text, F.lit(chars))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def first_long_enough(candidates: Iterable[Column], longer_than: int, cut: int | None = None) -> Column:
    """First candidate with more than ``longer_than`` characters, cut to ``cut`` if given; NULL without one."""
    return F.coalesce(*[F.when(F.length(c) > longer_than, head(c, cut)) for c in candidates])


def money(amount: Column) -> Column:
    return F.format_string("%.2f", amount)


def money_sum(amount: Column) -> Column:
    """Sum of a DOUBLE amount, added up exactly.

    Floating sums depend on the order of the rows, so a repeated task could give
    another last digit; decimals do not.
    """
    return F.sum(amount.cast("decimal(20,4)")).cast("double")
