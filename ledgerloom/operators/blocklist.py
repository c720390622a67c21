"""Blocklist filter: exact sender, exact domain, subject phrase; first hit wins."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_any, text_or_empty
from ..rules import blocklist as R
from ..schemas import BLOCKLIST
from .shaping import is_small, salted_join

MAX_LITERALS = 2_000  # above this many entries the list is joined, not written into the plan


class Blocklist(NamedTuple):
    senders: tuple[str, ...]
    domains: tuple[str, ...]
    subjects: tuple[str, ...]

    @classmethod
    def default(cls) -> Blocklist:
        return cls(*(tuple(v.lower() for v in group) for group in (R.SENDERS, R.DOMAINS, R.SUBJECTS)))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [("sender", v) for v in self.senders] + [("domain", v) for v in self.domains]
        rows += [("subject", v) for v in self.subjects]
        return spark.createDataFrame(rows, BLOCKLIST)


def sender_domain(sender: Column) -> Column:
    """Lower-case domain behind the last @ inside the last <; NULL without an @."""
    low = F.lower(sender)
    address = F.regexp_replace(F.substring_index(low, "<", -1), r"^>+|>+$", "")
    return F.when(low.contains("@"), F.trim(F.substring_index(address, "@", -1)))


def block_reason(sender: Column, subject: Column, rules: Blocklist | None = None) -> Column:
    """'sender', 'domain', 'subject' or ''; one row-local expression for lists of config size."""
    rules = Blocklist.default() if rules is None else rules
    sender, subject = text_or_empty(sender), text_or_empty(subject)
    reason = F.when(F.lower(sender).isin(*rules.senders), F.lit("sender"))
    reason = reason.when(F.coalesce(sender_domain(sender).isin(*rules.domains), F.lit(False)), F.lit("domain"))
    if rules.subjects:
        reason = reason.when(contains_any(F.lower(subject), rules.subjects), F.lit("subject"))
    return reason.otherwise(F.lit(""))


GRAM = 3  # characters by which the words at a phrase's edges are looked up in tokens


def _phrase_keys(asked: DataFrame, phrases: DataFrame) -> DataFrame:
    """(token, phrase): for each phrase the tokens of subjects under which it is looked up.

    Subjects and phrases are cut at blanks. A phrase stands in a subject when its
    inner words are tokens there, its first one ends a token and its last one starts
    one; a single word lies anywhere in a token. So a word stands for the tokens that
    it can be, or be a part of, found by three of its letters. Of a phrase's words
    the one whose tokens stand in the fewest subjects is its key. A phrase with a
    word that is in no token stands in no subject.
    """
    tokens = asked.groupBy("token").agg(F.count("*").alias("df")).where("token <> ''")
    words = phrases.select("phrase", F.split("phrase", " ").alias("w")).select("phrase", "w", F.posexplode("w").alias("at", "word")).where("word <> ''")
    last = F.size("w") - 1
    kind = F.when(last == 0, "only").when(F.col("at") == 0, "first").when(F.col("at") == last, "last").otherwise("inner")
    words = words.select("phrase", "at", "word", kind.alias("kind"))
    size = F.least(F.length("word"), F.lit(GRAM))
    gram = F.when(F.col("kind") == "inner", F.col("word")).when(F.col("kind") == "first", F.right("word", size)).otherwise(F.left("word", size))
    listed = words.select("kind", "word").distinct().withColumn("gram", gram)

    def grams(kind: str, texts: Column) -> Column:
        return F.transform(F.array_distinct(texts), lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram")))

    sizes = F.sequence(F.lit(1), F.lit(GRAM))
    starts = F.sequence(F.lit(1), F.length("token"))
    ends = F.transform(sizes, lambda n: F.right("token", n))
    fronts = F.transform(sizes, lambda n: F.left("token", n))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(sizes, lambda n: F.substr("token", i, n))))
    pieces = tokens.select("token", "df", F.inline(F.concat(grams("inner", F.array("token")), grams("first", ends), grams("last", fronts), grams("only", parts))))
    token, word = F.col("token"), F.col("word")
    fits = F.when(F.col("kind") == "inner", token == word).when(F.col("kind") == "first", token.endswith(word)).when(F.col("kind") == "last", token.startswith(word)).otherwise(token.contains(word))
    found = listed.join(pieces, ["kind", "gram"]).where(fits).select("kind", "word", "token", "df")
    cost = found.groupBy("kind", "word").agg(F.sum("df").alias("cost"))
    rarest = words.join(cost, ["kind", "word"], "left").groupBy("phrase").agg(
        F.min_by(F.struct("kind", "word"), F.struct("cost", "at")).alias("key"), F.count_if(F.col("cost").isNull()).alias("absent")
    )
    keys = rarest.where("absent = 0").select("phrase", "key.kind", "key.word")
    return keys.join(found, ["kind", "word"]).select("token", "phrase")


def subjects_with_phrase(subjects: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """Keys of the rows (``key``, ``subject`` in lower case) in which one of the phrases stands.

    An inverted index: each phrase waits under its rarest word, each subject asks
    once for each of its distinct words, and a hit is verified in the whole subject.
    Frequent words are salted. Phrases of blanks alone are one test, for the shortest.
    """
    blank = phrases.where("trim(phrase) = ''").agg(F.min(F.length("phrase")))
    rest = phrases.where("trim(phrase) <> ''")
    asked = subjects.select(key, F.explode(F.array_distinct(F.split("subject", " "))).alias("token"))
    candidates = salted_join(asked, _phrase_keys(asked, rest), ["token"], key).select(key, "phrase").distinct()
    hits = candidates.join(subjects, key).where(F.col("subject").contains(F.col("phrase"))).select(key)
    shortest = blank.first()[0]
    if shortest is not None:
        hits = hits.unionByName(subjects.where(F.col("subject").contains(" " * shortest)).select(key))
    return hits.distinct()


def block_reason_join(mail: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """``mail`` plus ``reason`` for a blocklist table (kind, value) of any size.

    Senders and domains are equi-joins, phrases inside subjects an inverted index
    (``subjects_with_phrase``). A sender that sends a third of all mail is one key
    with one list row, so the list side is salted unless it is small enough to
    broadcast. Only keys, senders and subjects are shuffled for the look-ups, and
    keys with a reason travel back to the mail.
    """
    rules = rules.select("kind", F.lower("value").alias("value")).distinct()
    fixed = F.array(
        F.struct(F.lit("sender").alias("kind"), F.lower("sender").alias("value")),
        F.struct(F.lit("domain").alias("kind"), sender_domain(F.col("sender")).alias("value")),
    )
    asked = mail.select(key, F.inline(fixed))
    addresses = rules.where("kind <> 'subject'")
    if is_small(addresses, MAX_LITERALS):
        hits = asked.join(F.broadcast(addresses), ["kind", "value"])
    else:
        hits = salted_join(asked, addresses, ["kind", "value"], key)
    subjects = mail.select(key, F.lower(text_or_empty(F.col("subject"))).alias("subject"))
    phrases = rules.where("kind = 'subject'").select(F.col("value").alias("phrase"))
    hits = hits.select(key, "kind").unionByName(subjects_with_phrase(subjects, phrases, key).withColumn("kind", F.lit("subject")))
    rank = F.when(F.col("kind") == "sender", 1).when(F.col("kind") == "domain", 2).otherwise(3)
    first = hits.groupBy(key).agg(F.min_by("kind", rank).alias("reason"))
    return mail.join(first, key, "left").withColumn("reason", text_or_empty(F.col("reason")))


def with_reason(mail: DataFrame, rules: Blocklist | DataFrame | None = None, key: str = "id") -> DataFrame:
    """``mail`` plus ``reason``: row by row for literal rules, joined for a table of rules; ``None`` takes the built-in list."""
    if isinstance(rules, DataFrame):
        return block_reason_join(mail, rules, key)
    return mail.withColumn("reason", block_reason(F.col("sender"), F.col("subject"), rules))


def drop_blocked(mail: DataFrame, rules: Blocklist | DataFrame | None = None) -> DataFrame:
    return with_reason(mail, rules).where("reason = ''").drop("reason")


def blocklist_stats(reasons: DataFrame) -> DataFrame:
    """One row: checks, blocked, blocked by sender, domain and subject, rate in percent."""
    blocked = F.count_if(F.col("reason") != "")
    return reasons.agg(
        F.count("*").alias("total_checks"),
        blocked.alias("blocked_count"),
        *[F.count_if(F.col("reason") == kind).alias(f"blocked_by_{kind}") for kind in ("sender", "domain", "subject")],
        F.coalesce(F.round(blocked * 100.0 / F.nullif(F.count("*"), F.lit(0)), 1), F.lit(0.0)).alias("block_rate"),
    )
