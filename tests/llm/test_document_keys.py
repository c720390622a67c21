"""Different texts without an id whose hashes agree in their last 20 bits are different documents."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import near_dedup, phrase_dedup, suffix_dedup

WORDS = [a + b for a in "ba ke lo mi nu pa re so ti vu".split() for b in "x yn zor wel dat fim gos".split()]
SCHEMA = "doc_id long, text string, copy string"


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def alike(spark):
    """Two texts that begin with the same passage and share 20 bits of their hash."""
    texts = spark.createDataFrame([(prose(40, 1) + " " + prose(60, 10 + i),) for i in range(5000)], "text string")
    bits = F.xxhash64("text").bitwiseAND((1 << 20) - 1).alias("bits")
    pairs = texts.groupBy(bits).agg(F.sort_array(F.collect_set("text")).alias("t")).where(F.size("t") > 1)
    return pairs.orderBy("bits").first()["t"][:2]


def test_a_repeat_at_equal_places_is_seen(spark, alike):
    docs = spark.createDataFrame([(None, t, None) for t in alike], SCHEMA).repartition(2)
    cut = {r["kept"].decode(): r["n_removed"] for r in suffix_dedup.dedup_substrings(docs).collect()}
    passage = len(prose(40, 1)) + 1
    assert sorted(cut.values())[0] == 0 and sorted(cut.values())[1] >= passage
    assert len(set(alike) & set(cut)) == 1
    words = phrase_dedup.remove_recurring(docs).collect()
    assert sorted(r["kept"] for r in words) == sorted(" ".join(t.split()[40:]) for t in alike)


def test_near_copies_of_both_are_found(spark, alike):
    copies = [(i, t + " more", "yes") for i, t in enumerate(alike)]
    docs = spark.createDataFrame([(None, t, None) for t in alike] + copies, SCHEMA).repartition(2)
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r["text"], r["kept"]) for r in got) == sorted([(t, True) for t in alike] + [(t, False) for _, t, _ in copies])
