"""Edited copies of a benchmark item that stand in many documents."""

import random

from pyspark.sql import functions as F

from ledgerloom.llm import decontamination

WORDS = [a + b for a in "ba ke lo mi nu pa re so ti vu".split() for b in "x yn zor wel dat fim gos".split()]


def prose(n, seed):
    rng = random.Random(seed)
    return [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]


def test_common_edited_copies_are_found(spark):
    items = {i: prose(16 + 11 * i, 500 + i) for i in range(3)}
    rows = []
    for i in range(120):
        copy = [f"other{j}" if j % 8 == 3 else w for j, w in enumerate(items[i % 3])]
        rows.append((i, " ".join(prose(40, 8000 + i) + copy + prose(40, 9000 + i))))
    rows += [(1000 + i, " ".join(prose(100, 100 + i))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = decontamination.find_leaks(docs, bench).select("doc_id", F.inline("leaks")).collect()
    assert {(r["doc_id"], r["item"]) for r in got} == {(i, i % 3) for i in range(120)}
    assert all(r["score"] > 0.7 for r in got)


def test_large_inputs_in_parts_give_the_same(spark, monkeypatch):
    item = prose(30, 1)
    docs = spark.createDataFrame([(i, " ".join(prose(20, 50 + i) + item[: 10 + i % 20])) for i in range(60)], "doc_id long, text string").repartition(1)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:20]))], "item_id long, text string")
    want = sorted(map(str, decontamination.find_leaks(docs, bench).collect()))
    texts = [r["text"].encode() for r in docs.collect()]
    items = decontamination._items([(1, " ".join(item)), (2, " ".join(item[:20]))])
    (_, _, words, at, places, hashes), = decontamination._hits(texts, items.grams)
    whole = sorted(decontamination._matches(words, at, places, hashes, items, 0.5, 50))
    monkeypatch.setattr(decontamination, "PART", 40)
    assert sorted(decontamination._matches(words, at, places, hashes, items, 0.5, 50)) == whole and len(want) == 60
